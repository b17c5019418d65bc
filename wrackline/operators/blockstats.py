"""What blocks hold, in numbers, and maps of an image drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.operators.signatures import sector_signature

BUFFER = 8 << 20
SECTOR = 512
MAP_LIMIT = 2 << 30
#: Characters of the map by the low five bits.
_ALPHABET = "0123456789ABCDEF@abcdefghijklmno"


def is_uniform(data: Column, size: int = SECTOR) -> Column:
    """Whether the first four bytes repeat to the end, which takes any such pattern for empty."""
    return data == F.unhex(F.repeat(F.hex(F.substring(data, 1, 4)), size // 4))


def buffer_stats(sectors: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Per image and buffer: signature flags or-ed together, sectors, and sectors in use.

    Partial aggregates reduce a buffer to one row where it is read.
    """
    data = F.col("data")
    rows = sectors.select("image", "fpos", sector_signature(data)["flag"].alias("flag"), F.when(is_uniform(F.substring(data, 1, SECTOR)), 0).otherwise(1).alias("used"))
    out = rows.groupBy("image", F.call_function("div", F.col("fpos"), F.lit(buffer)).alias("buffer"))
    return out.agg(F.bit_or("flag").alias("flags"), F.count(F.lit(1)).alias("sectors"), F.sum("used").alias("used"))


def buffer_char(flags: Column, used: Column, sectors: Column) -> Column:
    found = F.when(flags.bitwiseAND(F.lit(128)) != 0, "M").when(flags.bitwiseAND(F.lit(64)) != 0, "I").when(flags.bitwiseAND(F.lit(1)) != 0, "~").when(flags.bitwiseAND(F.lit(2)) != 0, "#")
    return found.when(used == 0, "0").when(used == sectors, "*").otherwise(".")


def heat_map(stats: DataFrame, columns: int = 128, whole: int | None = BUFFER // SECTOR, buffer: int = BUFFER) -> DataFrame:
    """image, row, label and map: a character per buffer of ``buffer`` bytes, 128 to a row.

    With ``whole`` given, a buffer of fewer sectors than that is left out.  A
    row of the map is bounded by ``columns``.
    """
    rows = stats.filter(F.col("sectors") == whole) if whole else stats
    row = F.call_function("div", F.col("buffer"), F.lit(columns))
    cells = rows.select("image", row.alias("row"), F.struct("buffer", buffer_char(F.col("flags"), F.col("used"), F.col("sectors")).alias("c")).alias("cell"))
    lines = cells.groupBy("image", "row").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    label = F.call_function("div", F.col("row") * columns * buffer, F.lit(1 << 30))
    return lines.select("image", "row", F.concat(label.cast("string"), F.lit(" GB")).alias("label"), F.array_join(F.transform("cells", lambda x: x["c"]), "").alias("map"))


def usage(stats: DataFrame) -> DataFrame:
    """Per image: bytes, sectors, sectors in use and their share in percent (null for none)."""
    out = stats.groupBy("image").agg((F.sum("sectors") * SECTOR).alias("bytes"), F.sum("sectors").alias("sectors"), F.sum("used").alias("used"))
    return out.withColumn("used_percent", F.round(100.0 * F.col("used") / F.nullif("sectors", F.lit(0)), 2))


def byte_xor(data: Column) -> Column:
    """Exclusive or of all bytes but 0 and 255."""

    @F.pandas_udf("int")
    def run(column):
        import numpy as np
        import pandas as pd

        def one(d) -> int:
            v = np.frombuffer(d or b"", np.uint8)
            return int(np.bitwise_xor.reduce(v[(v != 0) & (v != 255)], initial=0))

        return pd.Series([one(d) for d in column], dtype="int32")

    return run(data)


def fingerprint_char(data: Column) -> Column:
    """``.`` for zeros only, ``*`` for 255 only, else a letter for the low five bits of the xor."""
    text = F.hex(data)
    letter = F.substring(F.lit(_ALPHABET), byte_xor(data).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.when(F.replace(text, F.lit("00"), F.lit("")) == "", ".").when(F.replace(text, F.lit("FF"), F.lit("")) == "", "*").otherwise(letter)


def xor_map(blocks: DataFrame, block: int = 4096, columns: int = 128, limit: int | None = MAP_LIMIT) -> DataFrame:
    """image, fpos and map: a character per block up to ``limit``, 128 to a row."""
    rows = blocks.filter(F.col("fpos") <= limit) if limit is not None else blocks
    width = block * columns
    cells = rows.select("image", (F.call_function("div", F.col("fpos"), F.lit(width)) * width).alias("row"), F.struct("fpos", fingerprint_char(F.col("data")).alias("c")).alias("cell"))
    lines = cells.groupBy("image", "row").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return lines.select("image", F.col("row").alias("fpos"), F.array_join(F.transform("cells", lambda x: x["c"]), "").alias("map"))
