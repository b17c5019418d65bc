"""Tables of recovered files, of catalogues and of small dimension files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def recovered(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """path, mtime (unix seconds), size, content of files; ``content`` is read only if it is used.

    A whole file is one row, so this is for recovered files and not for images.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(paths))
    return files.select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Entries that :func:`write_catalogue` wrote."""
    return spark.read.parquet(path)


def write_catalogue(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(path)


def carve_list(spark: SparkSession, path: str) -> DataFrame:
    """fpos, size and name of a carver's text list: hex offset, size, three more fields, name."""
    parts = F.split(F.trim("value"), " ", 6)
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 6)
    return rows.select(F.conv(F.regexp_replace(F.get("p", 0), "^0[xX]|:$", ""), 16, 10).cast("bigint").alias("fpos"), F.get("p", 1).try_cast("bigint").alias("size"), F.get("p", 5).alias("name"))


def tag_names(spark: SparkSession, path: str) -> DataFrame:
    """tag, name of a tab-separated dictionary (decimal, hex, name); rows without a number are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.trim(F.get(parts, 0)).try_cast("int").alias("tag"), F.trim(F.get(parts, 2)).alias("name"))
    return rows.filter("tag IS NOT NULL AND name IS NOT NULL")


def with_tag_names(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Tags with their names; the number itself where the dictionary has none.

    Tag numbers have 16 bits, which bounds the dictionary, so it is broadcast.
    """
    named = names.groupBy("tag").agg(F.first("name").alias("name"))
    return tags.join(F.broadcast(named), "tag", "left").withColumn("name", F.coalesce("name", F.col("tag").cast("string")))
