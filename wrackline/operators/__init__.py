"""Operators over tables of blocks, records, entries and files."""
