"""Exact dedup by progressive refinement, with DataFrame functions only.

Documents are compared after lower-casing A-Z.  Three keys of growing cost
narrow the candidates: byte length, a hash of a short prefix, and SHA-256 of
the whole normalised text.  Only rows whose cheaper keys collide take part in
the grouping by the next one, so a unique document never reaches it.

:func:`drop_copies` reads whole texts of such rows alone.  :func:`exact_dedup`
returns every row's SHA-256, so it takes it in the scan of the cheap keys, in
which the text is at hand; its decisions use that of surviving rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.llm.common import checkpointed, keep_one, lower_ascii, row_key, sized

PREFIX_CHARS = 64


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def cheap_keys(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> tuple[Column, Column]:
    """n_bytes and prefix_hash; the hash holds the length."""
    text = text_of(docs)
    n_bytes = F.octet_length(text)
    return n_bytes.alias("n_bytes"), F.xxhash64(n_bytes, lower_ascii(F.substring(text, 1, prefix_chars))).alias("prefix_hash")


def full_hash(docs: DataFrame) -> Column:
    return F.unhex(F.sha2(lower_ascii(text_of(docs)).cast("binary"), 256)).alias("digest")


def shared_prefixes(keys: DataFrame) -> DataFrame:
    """The prefix_hash values that two or more rows of ``keys`` (n_bytes, prefix_hash) have.

    Each level counts with map-side partial aggregates, so a length or a prefix
    that a third of the rows share costs one row per task.  A level's counts
    are written before rows are joined to them, so each join stands between
    exchanges of its own and Spark may split its large partitions.
    """
    lengths = checkpointed(keys.groupBy("n_bytes").count().filter("count > 1").select("n_bytes"))
    level1 = keys.join(lengths, "n_bytes", "left_semi")
    return checkpointed(level1.groupBy("prefix_hash").count().filter("count > 1").select("prefix_hash"))


def groups_of(survivors: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: digest, keep_id, group_size."""
    groups = survivors.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return checkpointed(groups.filter("group_size > 1"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays.  A null doc_id is
    smaller than any other and stays only if its whole group has none; rows
    that repeat both id and text share one verdict.  An empty table gives an
    empty result.  Further columns of ``docs`` are ignored.
    """
    # About 60 bytes a row, written once, so the documents are scanned a single time whatever the number of levels.
    keys = checkpointed(docs.select("doc_id", *cheap_keys(docs), full_hash(docs)))
    survivors = keys.join(shared_prefixes(keys), "prefix_hash", "left_semi")
    found = keys.join(groups_of(survivors), "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, of the largest doc_id.

    Of rows that repeat id and text one stays.  A null text counts as empty, a
    null doc_id as the smallest; an empty table stays empty, and other columns
    are carried along whatever their names.
    """
    prefixes = shared_prefixes(checkpointed(docs.select(*cheap_keys(docs))))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), cheap_keys(docs)[1])
    survivors = rows.join(sized(prefixes), "prefix_hash", "left_semi")
    survivors = checkpointed(survivors.select("doc_id", row_key(survivors).alias("row_key"), full_hash(survivors)))
    judged = survivors.join(groups_of(survivors), "digest")
    return keep_one(docs, judged.select("doc_id", "row_key", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"), "digest")
