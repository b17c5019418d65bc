"""Quality classifier: a byte-level convolutional network in numpy.

The text's UTF-8 bytes are one-hot inputs of learned filters of a few bytes'
width.  Chunks overlap by half and cover the whole document; each is
max-pooled to one value per filter.  A document's features are, per filter,
the largest and the mean value over its chunks, and a logistic layer combines
them into one probability.

A convolution over one-hot bytes is a sum of table rows, one table per
position in the filter, so scoring gathers rows and adds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrackline.llm.common import checkpointed, doc_fold, small_batches

WIDTH = 6
FILTERS = 24
HALF = 128
#: Bounds of the sample that the network is fitted on: labelled documents, and bytes of all their texts.
FIT_DOCS, FIT_BYTES = 3000, 10_000_000
EPOCHS = 10
BATCH_HALVES = 1 << 12
THRESHOLD = 0.3


@dataclass
class ByteCnn:
    """tables: WIDTH x 256 x FILTERS; bias: FILTERS; weights: 2 FILTERS; offset."""

    tables: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    @classmethod
    def blank(cls, rng: np.random.Generator) -> "ByteCnn":
        return cls(
            rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
            np.full(FILTERS, -0.2, np.float32),
            rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
            1.0,
        )

    def halves(self, data: np.ndarray) -> np.ndarray:
        """Largest filter value in each half chunk; the tail is a half of its own."""
        n = max(1, len(data) - WIDTH + 1)
        if len(data) < WIDTH:
            data = np.concatenate((data, np.zeros(WIDTH - len(data), np.uint8)))
        out = np.empty((-(-n // HALF), FILTERS), np.float32)
        for at in range(0, n, 64 * HALF):
            m = min(64 * HALF, n - at)
            z = self.tables[0][data[at : at + m]]
            for j in range(1, WIDTH):
                z += self.tables[j][data[at + j : at + j + m]]
            out[at // HALF : at // HALF + -(-m // HALF)] = np.maximum.reduceat(z, np.arange(0, m, HALF), axis=0)
        return out

    def peaks(self, halves: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter value in each half chunk (a row of bytes), and its place."""
        z = self.tables[0][halves[:, :HALF]]
        for j in range(1, WIDTH):
            z += self.tables[j][halves[:, j : j + HALF]]
        z[np.arange(HALF) >= filled[:, None]] = -1e9
        win = z.argmax(axis=1)
        return np.take_along_axis(z, win[:, None, :], 1)[:, 0], win

    def score(self, text: str | None) -> float:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        half = self.halves(data)
        chunk = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
        chunk = np.maximum(chunk + self.bias, 0)
        z = np.concatenate((chunk.max(axis=0), chunk.mean(axis=0))) @ self.weights + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _halves(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All half chunks of a text, padded, and how many places of each count."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data) - WIDTH + 1)
    starts = np.arange(0, n, HALF)
    padded = np.concatenate((data, np.zeros(starts[-1] + HALF + WIDTH - 1 - len(data), np.uint8))) if starts[-1] + HALF + WIDTH - 1 > len(data) else data
    return np.lib.stride_tricks.sliding_window_view(padded, HALF + WIDTH - 1)[starts], np.minimum(HALF, n - starts)


def _batches(sizes: np.ndarray, order: np.ndarray, batch: int) -> list[np.ndarray]:
    """Runs of documents of at most ``batch`` documents and BATCH_HALVES half chunks, or of one."""
    out, part, held = [], [], 0
    for d in order:
        if part and (len(part) == batch or held + sizes[d] > BATCH_HALVES):
            out.append(np.array(part))
            part, held = [], 0
        part.append(d)
        held += sizes[d]
    return [*out, np.array(part)] if part else out


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, batch: int = 16) -> ByteCnn:
    """Adam over the log loss of whole texts; gradients pass through the winning position of each pool."""
    rng = np.random.default_rng(seed)
    net = ByteCnn.blank(rng)
    if not len(texts) or labels.min() == labels.max():
        net.weights[:] = 0
        net.offset = 0.0 if not len(texts) else float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
        return net
    halves, filled = zip(*[_halves(t) for t in texts])
    sizes = np.array([len(h) for h in halves])
    rate = float(labels.mean())
    net.offset = float(np.log(rate / (1 - rate)))
    params = [net.tables, net.bias, net.weights]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        lr = 0.01 * (1 - epoch / epochs) + 0.001
        for docs in _batches(sizes, rng.permutation(len(texts)), batch):
            data = np.concatenate([halves[d] for d in docs])
            top, win = net.peaks(data, np.concatenate([filled[d] for d in docs]))
            # Chunks are two halves that lie side by side; one half alone is a chunk.
            end = np.cumsum(sizes[docs])
            left = np.arange(len(data))
            left = left[(left + 1 < len(data)) & ~np.isin(left, end - 1) | np.isin(left, (end - 1)[sizes[docs] == 1])]
            right = np.where(np.isin(left, end - 1), left, left + 1)
            owner = np.searchsorted(end, left, side="right")
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.bincount(owner)[:, None]
            source = np.where(top[right] > top[left], right[:, None], left[:, None])
            pooled = np.take_along_axis(top, source, 0) + net.bias
            act = np.maximum(pooled, 0)
            peak, mean = np.maximum.reduceat(act, first), np.add.reduceat(act, first) / count
            feats = np.concatenate((peak, mean), axis=1)
            p = 1 / (1 + np.exp(-np.clip(feats @ net.weights + net.offset, -30, 30)))
            err = ((p - labels[docs]) / len(docs)).astype(np.float32)
            back = err[:, None] * net.weights
            tied = (act == peak[owner]) & (act > 0)
            g_pool = (tied * back[owner, :FILTERS] + back[owner, FILTERS:] / count[owner]) * (pooled > 0)
            g_half = np.zeros_like(top)
            np.add.at(g_half, (source, np.arange(FILTERS)), g_pool)
            g_tables = np.zeros_like(net.tables)
            rows, cols = np.nonzero(g_half)
            where = win[rows, cols]
            for j in range(WIDTH):
                np.add.at(g_tables[j], (data[rows, where + j], cols), g_half[rows, cols])
            grads = [g_tables + 1e-5 * net.tables, g_pool.sum(0), feats.T @ err + 1e-4 * net.weights]
            step += 1
            for p_, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p_ -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            net.offset -= 0.1 * lr * float(err.sum()) * len(docs)
    return net


def fit_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int, most_bytes: int | None = None) -> DataFrame:
    """A fixed sample of at most ``limit`` labelled documents outside fold 0: doc_id, text, label.

    Ids are taken in the order of a hash, one row for each (that of the least
    text), and with ``most_bytes`` as long as their whole texts add up to no
    more; the sample is written once.
    """
    known = labels.filter(F.col(column).isin(0, 1) & (doc_fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(column).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = checkpointed(rows)
    if most_bytes is None:
        return rows
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of `limit` rows at most
    return rows.withColumn("upto", upto).filter(F.col("upto") <= most_bytes).drop("upto")


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> ByteCnn:
    """Fit on the whole texts of a bounded sample of labelled documents, on the driver."""
    rows = fit_sample(docs, labels, "quality", limit, most_bytes)
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in got], np.array([r.label for r in got], dtype=np.float32))


def score_quality(docs: DataFrame, net: ByteCnn, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row, from its whole text alone.

    Null and empty texts get the score of an empty one.  One narrow pass; the
    network (some 40,000 numbers) goes out once per executor.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((net.tables, net.bias, net.weights, net.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteCnn(*sent.value)
        for b in batches:
            score = np.array([model.score(t.as_py()) for t in b.column(1)], dtype=np.float64)
            predicted = (score >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(predicted)], names=["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, net: ByteCnn, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below the threshold, in one narrow pass."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((net.tables, net.bias, net.weights, net.offset))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteCnn(*sent.value)
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) >= threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
