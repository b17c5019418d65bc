"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are exact 64-bit SimHashes over word shingles (XXH64, seed 42).
Links of at most ``radius`` differing bits are found in two steps.

* Distribution: a fingerprint is cut into ``radius + 1`` blocks.  Two
  fingerprints within the radius agree in at least one of them, so the first
  bits of each block are a key and every link shows up under some key.
* Search inside the keys' buckets, by :mod:`wrackline.llm.grayindex`.

Copies collapse to one row per fingerprint before any of this.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.llm.common import checkpointed, sized, small_batches
from wrackline.llm.components import components
from wrackline.llm.grayindex import GrayForest, bucket_links

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Rows of a bucket that the index searches as one tree, and the multiple of it that is split.
BUCKET, HOT = 2048, 8
_PIECE = 8192
_STEP = 1 << 15


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in more than half of the 64-bit hashes, which come in parts."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; 0 where it has no words.

    A bit is 1 if it is set in more than half of the shingle hashes.  Fewer
    words than a shingle make one shingle of what there is.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    steps = range(0, len(a), _STEP)
    return majority(np.array([digest(flat[x:y], SEED) for x, y in zip(a[at : at + _STEP], b[at : at + _STEP])], dtype="<u8") for at in steps)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


# ---- links ---------------------------------------------------------------------


def block_masks(used: int, parts: int, bits: int) -> list[int]:
    """Masks of up to ``bits`` bits of each of ``parts`` blocks of the bits not in ``used``.

    Fingerprints that agree in ``used`` and differ in fewer than ``parts`` bits
    agree under one of the masks.
    """
    free = [b for b in range(64) if not used >> b & 1]
    edges = np.linspace(0, len(free), parts + 1).round().astype(int)
    return [used | sum(1 << b for b in free[lo : min(lo + bits, hi)]) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _searched(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, GrayForest]]:
    """Links of all buckets of a partition that comes sorted by bucket (path, key, fp, node)."""

    def work(path: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, GrayForest]]:
        bucket = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (path[1:] != path[:-1]))))
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        size = np.diff(np.append(start, len(key)))
        many = np.repeat(size > 1, size)
        bucket, fp, node = bucket[many], fp[many].view(np.uint64), node[many]
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
        cut = [0, *start[np.flatnonzero(np.diff(start // _PIECE)) + 1].tolist(), len(bucket)]
        for lo, hi in zip(cut, cut[1:]):
            if lo < hi:
                yield bucket_links(bucket[lo:hi], fp[lo:hi], radius, node[lo:hi])

    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c.to_numpy() for c in b.columns])
        path, key = held[-1][:2]
        if (path[-1], key[-1]) == (held[0][0][0], held[0][1][0]):
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        path, key = columns[:2]
        last = int(np.flatnonzero((key != key[-1]) | (path != path[-1]))[-1]) + 1
        yield from work(*(c[:last] for c in columns))
        held = [[c[last:] for c in columns]]
    if held:
        yield from work(*(np.concatenate(x) for x in zip(*held)))


def keyed(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """path, key, fp, node: every two rows within the radius share a path and key.

    Keys have as many bits as give buckets of about ``bucket`` rows.  A bucket
    that is over HOT times that, as of a large group of near copies, is keyed
    again by blocks of the bits in which its members may still differ, until
    none is left.
    """
    n = fps.count()
    parts = radius + 1
    bits = min(64 // parts, max(0, math.ceil(math.log2(max(1, n) / bucket))))
    masks = dict(enumerate(block_masks(0, parts, bits))) if bits else {0: 0}
    entries = F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in masks.items()])
    rows = fps.select("fp", "node", F.explode(entries).alias("e")).select("e.path", "e.key", "fp", "node")
    done, fresh = None, list(masks)
    while True:
        open_paths = [p for p in fresh if 64 - masks[p].bit_count() >= parts]
        sizes = rows.filter(F.col("path").isin(open_paths)).groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT * bucket)
        hot = checkpointed(sizes.select("path", "key"))
        if hot.isEmpty():
            break
        hot = sized(hot)  # one row stands for over HOT * bucket
        cold = rows.join(hot, ["path", "key"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        steps, fresh = [], []
        for (path,) in hot.select("path").distinct().collect():  # at most as many as masks
            for m in block_masks(masks[path], parts, 8):
                fresh.append(len(masks))
                steps.append((path, len(masks), _signed(m)))
                masks[len(masks)] = m
        wider = fps.sparkSession.createDataFrame(steps, "path int, wider int, mask long")
        rows = rows.join(hot, ["path", "key"], "left_semi").join(F.broadcast(wider), "path")
        rows = checkpointed(rows.select(F.col("wider").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node"))
    return rows if done is None else done.unionByName(rows)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links u, v that connect all rows of ``fps`` (fp, node) within the radius of one another."""
    rows = keyed(fps, radius, bucket).repartition("path", "key").sortWithinPartitions("path", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v, _ in _searched(batches, radius):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _named(marked: DataFrame, fps: DataFrame, links: DataFrame) -> DataFrame:
    """The columns of ``marked`` but node, component_id and root, from the links of the nodes in ``fps`` (node, least_id)."""
    found = components(links).withColumnRenamed("node", "at")
    rooted = fps.join(found, fps["node"] == found["at"], "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    # Written first, so that the join has an exchange on either side and a large component's rows can be split.
    named = checkpointed(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    by_node = rooted.join(named, "root").select("node", "component_id", "root")
    own = [c for c in marked.columns if c != "node"]
    return marked.join(by_node, "node").select(*own, "component_id", "root")


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row.

    ``component_id`` is the smallest doc_id that links reach, the row's own
    included.  Null and empty texts have fingerprint zero and link like any
    other.  A null doc_id never names a component unless no row in it has an
    id.  Repeated rows come out as often as they went in.
    """
    marked = checkpointed(fingerprints(docs, shingle).withColumn("node", F.col("fp")))
    fps = checkpointed(marked.groupBy("fp", "node").agg(F.min("doc_id").alias("least_id")))
    return _named(marked, fps, fingerprint_links(fps, radius)).drop("root")


def fingerprint_text(fp: Column) -> Column:
    """16 lowercase hex digits of the unsigned fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, see :mod:`wrackline.llm.near_copies`."""
    from wrackline.llm import near_copies

    return near_copies.drop_near_copies(docs)
