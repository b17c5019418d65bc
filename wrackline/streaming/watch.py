"""Verdicts and signatures over folders that files keep arriving in, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrackline.operators.signatures import block_type
from wrackline.operators.validate import verdicts

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """path, mtime, size, content of files as they arrive."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)
    return stream.select("path", F.col("modificationTime").alias("at"), F.col("length").alias("size"), "content")


def arriving_verdicts(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """path, ext, errcnt, status; stateless, so any sink and trigger fits."""
    return verdicts(arriving(spark, folder, per_trigger))


def arriving_kinds(spark: SparkSession, folder: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """window, kind, n: files of each type per window of their time, closed by a watermark."""
    rows = arriving(spark, folder).withWatermark("at", late)
    return rows.groupBy(F.window("at", window), F.coalesce(block_type(F.substring("content", 1, 4096)), F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
