"""Queries over the driver's tables, and their SQL.

The tables hold no disk data, so each query runs an operator on an analog that
is built from their rows; its docstring says which.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wrackline.plans import blocks, catalogue, content, damage, disk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (blocks, catalogue, content, damage, disk):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
