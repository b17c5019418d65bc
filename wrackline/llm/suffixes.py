"""Repeated passages across documents, by a sparse suffix array.

A passage of ``PASSAGE`` (50) or more words that also stands in another
document is found wherever it lies, with whole extent on either side.  Equal
means equal hashes: of 64 bits for runs of words, of 32 for the single words
beside them.

* Sparse suffixes: only those are kept that start at a minimiser, the least
  hash of 8 words among 19 neighbours.  Every run of 50 words has one within
  its first 19 places, followed by 32 more words of the run.
* Candidates: the hash of those 32 words has to occur in two documents.  Most
  suffixes fall here, at the cost of one number each; texts of the others'
  documents are read again for their surroundings.
* Sort and compare: suffixes of one hash are sorted by the 18 words that
  follow and then by the 18 before.  Equal neighbours from two documents
  settle a suffix: the passage runs through all of its surroundings.
* Extension: for the others, the match is extended left and right, a word at
  a time: all ways of sharing the missing 18 words between both sides are
  compared within the hash's group, so none is lost to the sort order.

A hash's group is worked on by one task if it has up to ``GROUP_ROWS`` rows.
A larger one takes the same comparisons as distributed aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.llm.common import checkpointed, sized, small_batches
from wrackline.llm.wordhash import grams, mix, words

PASSAGE = 50
GRAM = 8
WINDOW = 19
ANCHOR = PASSAGE - WINDOW + 1  # words from a minimiser that stay inside the passage
SIDE = PASSAGE - ANCHOR  # words that are missing to a passage
GROUP_ROWS = 200_000
_FLUSH = 60_000


def minimisers(h: np.ndarray) -> np.ndarray:
    """Places of the words at which a sparse suffix starts."""
    g = grams(h, GRAM)
    if len(g) < WINDOW:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    step = 1 << 16
    at = [view[i : i + step].argmin(axis=1) + np.arange(i, min(i + step, len(view))) for i in range(0, len(view), step)]
    return np.unique(np.concatenate(at))


def _anchors(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, places of suffixes with enough words after them, and their anchor hashes."""
    h = words(text)[0]
    if len(h) < PASSAGE:
        return h, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a = grams(h, ANCHOR)
    at = minimisers(h)
    at = at[at < len(a)]
    return h, at, a[at]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text")).select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")


def anchors(keyed: DataFrame) -> DataFrame:
    """anchor, row_key, pos of every sparse suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_anchors(t.as_py()) for t in b.column(1)]
            key = np.repeat(b.column(0).to_numpy(), [len(at) for _, at, _ in found])
            a = np.concatenate([x for *_, x in found]) if found else np.zeros(0, np.uint64)
            pos = np.concatenate([at for _, at, _ in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(key), pa.array(pos.astype(np.int32))], names=["anchor", "row_key", "pos"])

    return keyed.select("row_key", "text").mapInArrow(run, "anchor long, row_key long, pos int")


def surroundings(candidates: DataFrame) -> DataFrame:
    """Suffix rows of documents with a list of places: the words after the anchor and before it."""
    kind = dict(candidates.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h = words(b.column(2)[i].as_py())[0]
                at = np.unique(np.asarray(b.column(3)[i].as_py(), dtype=np.int64))
                a = grams(h, ANCHOR)[at].view(np.int64)
                short = np.concatenate((np.zeros(SIDE, np.uint32), h.astype(np.uint32), np.zeros(SIDE, np.uint32)))
                steps = np.arange(SIDE)
                right = short[at[:, None] + SIDE + ANCHOR + steps]
                left = short[at[:, None] + SIDE - 1 - steps]
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a),
                        pa.array([r.tobytes() for r in right], pa.binary()),
                        pa.array([r.tobytes() for r in left], pa.binary()),
                        pa.array(np.minimum(SIDE, len(h) - at - ANCHOR).astype(np.int32)),
                        pa.array(np.minimum(SIDE, at).astype(np.int32)),
                        pa.array(np.full(n, b.column(0)[i].as_py())),
                        pa.array([b.column(1)[i].as_py()] * n, b.column(1).type),
                        pa.array(at.astype(np.int32)),
                    ],
                    names=["anchor", "right", "left", "n_right", "n_left", "row_key", "doc_id", "pos"],
                )

    schema = f"anchor long, right binary, left binary, n_right int, n_left int, row_key long, doc_id {kind}, pos int"
    return candidates.select("row_key", "doc_id", "text", "places").mapInArrow(run, schema)


def _prefix_hashes(side: np.ndarray) -> list[np.ndarray]:
    """Hash of the first j words of each row, j from 0 to SIDE."""
    out = [np.zeros(len(side), np.uint64)]
    for j in range(SIDE):
        out.append(mix(out[-1] + side[:, j].astype(np.uint64) + np.uint64(j + 1)))
    return out


def side_keys(anchor: np.ndarray, right: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
    """For l from 0 to SIDE, the hash of a suffix's l words before and SIDE - l after its anchor."""
    r, lft = _prefix_hashes(right), _prefix_hashes(left)
    for n in range(SIDE + 1):
        yield mix(mix(anchor.view(np.uint64) + np.uint64(n)) + lft[n] * np.uint64(3) + r[SIDE - n])


def _shared(key: np.ndarray, row_key: np.ndarray) -> np.ndarray:
    """Which rows have a key that rows of another document have too."""
    order = np.lexsort((row_key, key))
    k, r = key[order], row_key[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.append(new, len(k)))
    several = r[new] != r[new + size - 1]
    out = np.empty(len(key), bool)
    out[order] = np.repeat(several, size)
    return out


def extents(anchor: np.ndarray, right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, row_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most and fewest words before the anchor in a repeated passage (-1: there is none).

    Rows come sorted by anchor, right and left, each anchor's whole.
    """
    same = (anchor[1:] == anchor[:-1]) & (right[1:] == right[:-1]).all(axis=1) & (left[1:] == left[:-1]).all(axis=1)
    run = np.cumsum(np.concatenate(([0], ~same)))
    full = (n_right == SIDE) & (n_left == SIDE) & _shared(run, row_key)
    most, fewest = np.where(full, SIDE, -1), np.where(full, 0, -1)
    group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
    todo = np.flatnonzero(np.bincount(group, ~full)[group] > 0)
    if len(todo):
        for n, key in enumerate(side_keys(anchor[todo], right[todo], left[todo])):
            fits = (n_left[todo] >= n) & (n_right[todo] >= SIDE - n)
            rows = todo[fits]
            hit = rows[_shared(key[fits], row_key[rows])] if len(rows) else rows
            fewest[hit] = np.where(most[hit] < 0, n, np.minimum(fewest[hit], n))
            most[hit] = np.maximum(most[hit], n)
    return most, fewest


def _compared(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Repeated word ranges from suffix rows that come sorted, each anchor's in one partition."""

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIDE)

    def work(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        c = {n: t.column(n).combine_chunks() for n in t.column_names}
        plain = {n: c[n].to_numpy(zero_copy_only=False) for n in ("anchor", "n_right", "n_left", "row_key", "pos")}
        most, fewest = extents(plain["anchor"], matrix(c["right"]), matrix(c["left"]), plain["n_right"], plain["n_left"], plain["row_key"])
        hit = most >= 0
        pos = plain["pos"][hit]
        arrays = [pa.array(plain["row_key"][hit]), c["doc_id"].filter(pa.array(hit)), pa.array((pos - most[hit]).astype(np.int32)), pa.array((pos + PASSAGE - fewest[hit]).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < _FLUSH:
            continue
        t = pa.Table.from_batches(held)
        a = t.column("anchor").to_numpy()
        last = int(np.searchsorted(a, a[-1]))
        if last:
            yield work(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
            rows = t.num_rows - last
    if rows:
        yield work(pa.Table.from_batches(held))


def _compared_widely(rows: DataFrame) -> DataFrame:
    """The same ranges for groups of any size: one row per suffix and side key, counted by aggregates."""
    kind = dict(rows.dtypes)["doc_id"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n) for n in b.schema.names}
            num = {n: c[n].to_numpy() for n in ("anchor", "n_right", "n_left", "pos")}
            sides = [np.frombuffer(b"".join(c[n].to_pylist()), np.uint32).reshape(-1, SIDE) for n in ("right", "left")]
            for n, key in enumerate(side_keys(num["anchor"], *sides)):
                fits = (num["n_left"] >= n) & (num["n_right"] >= SIDE - n)
                m = pa.array(fits)
                start = (num["pos"][fits] - n).astype(np.int32)
                arrays = [pa.array(key[fits].view(np.int64)), c["row_key"].filter(m), c["doc_id"].filter(m), pa.array(start), pa.array(start + np.int32(PASSAGE))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "row_key", "doc_id", "start", "end"])

    keyed = rows.mapInArrow(keys, f"key long, row_key long, doc_id {kind}, start int, end int")
    several = keyed.groupBy("key").agg(F.min("row_key").alias("a"), F.max("row_key").alias("b")).filter("a <> b").select("key")
    several = checkpointed(several)  # so that the join has an exchange on either side and a common key's rows can be split
    return keyed.join(several, "key", "left_semi").select("row_key", "doc_id", "start", "end")


def _merged(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per document from ranges sorted by document and start."""
    done: list[tuple] = []
    key = doc = None
    ranges: list[list[int]] = []

    def row() -> tuple:
        return doc, len(ranges), sum(e - s for s, e in ranges), ",".join(f"{s}:{e}" for s, e in ranges)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    for b in batches:
        for k, d, s, e in zip(*(c.to_pylist() for c in b.columns)):
            if k != key or not ranges:
                if ranges:
                    done.append(row())
                key, doc, ranges = k, d, [[s, e]]
            elif s <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], e)
            else:
                ranges.append([s, e])
        if len(done) >= 5000:
            yield batch()
            done = []
    if ranges:
        done.append(row())
    if done:
        yield batch()


def repeated_passages(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_spans, repeated_words, spans of each document that shares a passage with another.

    ``spans`` are word ranges ``start:end`` (end exclusive), disjoint and in
    order, that together are all words of all runs of 50 words which another
    document has as well.  Documents without any are not returned.  Rows that
    repeat both id and text count as one document; a null text has no words.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    kind = dict(docs.dtypes)["doc_id"]
    ranges = f"row_key long, doc_id {kind}, start int, end int"
    result = f"doc_id {kind}, n_spans long, repeated_words long, spans string"
    schemas = {x: to_arrow_schema(_parse_datatype_string(x)) for x in (ranges, result)}

    found = checkpointed(anchors(keyed))  # 20 bytes a suffix, and read twice
    several = found.groupBy("anchor").agg(F.min("row_key").alias("a"), F.max("row_key").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b")
    several = checkpointed(several.select("anchor", "n"))  # a small part of the anchors, and read three times
    places = checkpointed(found.join(several, "anchor").groupBy("row_key").agg(F.collect_list("pos").alias("places")))
    # Only texts with a candidate are shuffled, as long as these are few enough to be told apart where texts are read.
    texts = keyed.join(sized(checkpointed(places.select("row_key"))), "row_key", "left_semi")
    rows = surroundings(texts.join(places, "row_key"))
    if several.filter(F.col("n") > group_rows).isEmpty():
        small, wide = rows, None
    else:
        rows = checkpointed(rows)
        large = several.filter(F.col("n") > group_rows).select("anchor")
        small, wide = rows.join(large, "anchor", "left_anti"), _compared_widely(rows.join(large, "anchor", "left_semi"))
    ordered = small.repartition("anchor").sortWithinPartitions("anchor", "right", "left")
    spans = ordered.mapInArrow(lambda it: _compared(it, schemas[ranges]), ranges)
    if wide is not None:
        spans = spans.union(wide)
    spans = spans.repartition("row_key").sortWithinPartitions("row_key", "start")
    return spans.mapInArrow(lambda it: _merged(it, schemas[result]), result)
