"""Column expressions over binary data; offsets count from zero.

Everything here is built from Spark's own functions, so it stays inside
generated code and can stand before any decoder that runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(data: Column, offset: int | Column, length: int) -> Column:
    """``length`` bytes at ``offset``."""
    start = offset + 1 if isinstance(offset, Column) else F.lit(offset + 1)
    return F.substring(data, start, F.lit(length))


def be(data: Column, offset: int | Column, length: int) -> Column:
    """Unsigned big-endian integer of up to 7 bytes."""
    return F.conv(F.hex(cut(data, offset, length)), 16, 10).cast("bigint")


def le(data: Column, offset: int | Column, length: int) -> Column:
    """Unsigned little-endian integer of up to 7 bytes.

    Bytes are turned around one by one, as ``reverse`` goes by characters.
    """
    return F.conv(F.concat(*[F.hex(cut(data, offset + i, 1)) for i in reversed(range(length))]), 16, 10).cast("bigint")


def le_signed(data: Column, offset: int | Column, length: int) -> Column:
    """Signed little-endian integer of up to 7 bytes."""
    value, full = le(data, offset, length), 1 << (8 * length)
    return F.when(value >= full // 2, value - full).otherwise(value)


def has(data: Column, offset: int, magic: bytes) -> Column:
    """Whether ``magic`` stands at ``offset``."""
    return cut(data, offset, len(magic)) == F.lit(bytearray(magic))


def contains_bytes(data: Column, needle: bytes) -> Column:
    """Whether ASCII ``needle`` occurs; bytes are read as Latin-1 so that none is lost."""
    return F.contains(F.decode(data, "ISO-8859-1"), F.lit(needle.decode("latin-1")))


def latin(data: Column, offset: int | Column, length: int) -> Column:
    return F.decode(cut(data, offset, length), "ISO-8859-1")


def filetime_to_unix(ticks: Column) -> Column:
    """Seconds since 1970 from 100-nanosecond ticks since 1601, rounded down."""
    return F.call_function("div", ticks, F.lit(10_000_000)) - 11_644_473_600


def unix_to_filetime(seconds: Column) -> Column:
    return (seconds + 11_644_473_600) * 10_000_000
