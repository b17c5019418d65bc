"""Operators that turn raw crawled or collected text into training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`wrackline.llm.queries` derives from
them the thin digest queries that the entry module registers.
"""
