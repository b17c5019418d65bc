"""Helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of ids for a task that makes a file or record of each: fewest and most.
LEAST_ROWS, MOST_ROWS = 1_000, 20_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``rows`` dealt out evenly, at most ``most`` to a task and fewer where that leaves cores idle.

    A table of ids is one small file, which a single task would read and then
    do all the work on; the number of tasks here grows with the rows.
    """
    n = rows.count()
    even = n // (4 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, -(-n // min(most, max(LEAST_ROWS, even)))))


def made_files(ids: DataFrame, make: Callable[[int], bytes]) -> DataFrame:
    """path and content of the file that ``make`` gives for each id, the first column, in batches of bounded size."""
    small_batches(ids.sparkSession)
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, contents, held = [], [], 0
            for i in b.column(0).to_pylist():
                paths.append(str(i))
                contents.append(make(i))
                held += len(contents[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=schema)
                    paths, contents, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=schema)

    return spread(ids).mapInArrow(run, "path string, content binary")


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores, if their files have fewer parts than that."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(4 * cores) if docs.rdd.getNumPartitions() < cores else docs


def turned(docs: DataFrame, turn: Callable[..., tuple], ddl: str) -> DataFrame:
    """Columns ``ddl`` of what ``turn`` gives for each row of (doc_id, text): doc_id first, then a tuple.

    Rows go through one by one and batches are bounded in bytes, so that a
    worker holds a few MB whatever the texts and the table have.
    """
    small_batches(docs.sparkSession)
    schema = to_arrow_schema(_parse_datatype_string(f"doc_id bigint, {ddl}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for i, d in zip(b.column(0).to_pylist(), b.column(1)):
                rows.append((i, *turn(i, d.as_py())))
                held += 100 + sum(len(v) for v in rows[-1] if isinstance(v, bytes))
                if held >= BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    return dealt(docs).select(F.col("doc_id").cast("bigint"), text_bytes(F.col("text"))).mapInArrow(run, f"doc_id bigint, {ddl}")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES`` where the session has Spark's own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(key, str(BATCH_BYTES))


def text_bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def day(c: Column) -> Column:
    """Days since 1970."""
    return F.unix_date(F.to_date(c)).cast("bigint")


def registered(queries: dict, oracles: dict) -> Callable:
    """Decorator that registers a query with its SQL."""

    def with_sql(sql: str) -> Callable:
        def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            queries[f.__name__] = f
            oracles[f.__name__] = sql
            return f

        return add

    return with_sql
