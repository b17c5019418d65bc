"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows of at most some ten numbers up to which a side of a join is broadcast, counted first.
BROADCAST_ROWS = 500_000
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    A text without multi-byte characters takes the quick built-in; the others
    go through ``translate``, which leaves every letter outside A-Z alone.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    One of our own is set only where that is unset and driver and executors are
    one machine, as in tests.
    """
    context = spark.sparkContext._jsc.sc()
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not context.getCheckpointDir().isDefined():
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wrackline-checkpoint-"))
    return context.getCheckpointDir().get()


def small_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches of texts to ARROW_BYTES where the session has Spark's own bound.

    A worker and the buffers beside it hold a few batches at a time, so this
    bounds what long texts cost in memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(key, str(ARROW_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def doc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of all training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def row_key(docs: DataFrame) -> Column:
    """A row's name for operators that bring verdicts back to it: a hash of id and text."""
    return F.xxhash64(docs["doc_id"], docs["text"].cast("string"))


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has few enough and else joined by a shuffle."""
    return F.broadcast(small) if small.count() <= limit else small


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``lost`` (doc_id, row_key).

    Rows of one id with other texts stay, and so do those without an id.
    """
    names = {c.lower() for c in docs.columns}
    fresh = lambda n: n if n not in names else fresh(n + "_")
    key, gone_key, gone_id = fresh("row_key"), fresh("gone_key"), fresh("gone_id")
    gone = sized(checkpointed(lost.select(F.col("row_key").alias(gone_key), F.col("doc_id").alias(gone_id)).distinct()))
    marked = docs.withColumn(key, row_key(docs))
    return marked.join(gone, (marked[key] == gone[gone_key]) & marked["doc_id"].eqNullSafe(gone[gone_id]), "left_anti").drop(key)


def keep_one(docs: DataFrame, judged: DataFrame, group: str) -> DataFrame:
    """``docs`` with one row of each group that ``judged`` (doc_id, row_key, kept, ``group``) has; kept rows come first.

    Rows that repeat id and text have one name, so the one that stays of them
    is taken from the rows themselves.
    """
    judged = checkpointed(judged)
    many = judged.filter("kept").groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("row_key").alias("first")).filter("n > 1")
    many = checkpointed(many.select(group, "first"))
    lost = judged.filter("not kept").select("doc_id", "row_key")
    if many.isEmpty():
        return without(docs, lost)
    named = checkpointed(judged.filter("kept").join(many, group).select("doc_id", "row_key", "first"))
    again = sized(checkpointed(named.filter("row_key = first").select(F.col("doc_id").alias("again_id"), F.col("row_key").alias("again_key")).distinct()))
    whole = docs.select(row_key(docs).alias("again_row"), docs["doc_id"].alias("again_of"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("again_doc"))
    picked = whole.join(again, (F.col("again_row") == F.col("again_key")) & F.col("again_of").eqNullSafe(F.col("again_id")))
    picked = picked.groupBy("again_id", "again_key").agg(F.first("again_doc").alias("again_doc")).select("again_doc.*")
    return without(docs, lost.union(named.select("doc_id", "row_key"))).unionByName(picked)
