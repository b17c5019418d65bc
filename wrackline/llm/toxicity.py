"""Toxicity: a factorization machine over hashed terms.

A document is the set of its terms, hashed to 2**20 buckets: words in lower
case, and stems, the first STEM bytes of longer words, once more if two or more
different words of the text have them.  The machine adds a weight per term and,
for every pair of terms, the product of their factor vectors, so that two terms
may say together what neither says alone; the pair sum is taken in one pass
over the terms.

Constants of the fit were chosen by cross-validation over folds 1 to 4 of the
labels alone (see the README); fold 0 had no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.llm.common import small_batches

from wrackline.llm.bytecnn import fit_sample
from wrackline.llm.wordhash import mix, stems, words

BITS = 20
FACTORS = 6
STEM = 4
#: Bounds of the sample that is fitted on: labelled documents, terms kept, and common terms whose pairs are looked at.
FIT_DOCS = 8000
FIT_TERMS = 4096
PAIR_TERMS = 1024
TERM_SCORE, PAIR_SCORE = 2.5, 8.0
THRESHOLD = 0.5


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's terms, all of them."""
    stem, count = stems(text, STEM)
    several = mix(stem[count > 1] + np.uint64(1))
    return np.unique(np.concatenate((words(text)[0], stem, several)) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class FactorMachine:
    """``place`` maps a bucket to a row of ``weights`` and ``factors``; row 0 is for unknown terms and zero."""

    place: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def margin(self, rows: np.ndarray) -> float:
        rows = rows[rows > 0]
        v = self.factors[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.place[terms(text)]), -30, 30))))


def _apart(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Signed root of chi-squared of counts in two classes, without its sign."""
    p = (pos + neg + 1) / (n1 + n0 + 2)
    return np.abs(pos / n1 - neg / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def select_terms(docs: list[np.ndarray], labels: np.ndarray, limit: int) -> np.ndarray:
    """The buckets that tell the classes apart best, alone or with another.

    Of the PAIR_TERMS most common buckets those of a pair that tells the
    classes apart are taken as well, though neither does alone.
    """
    size = 1 << BITS
    pos, neg = np.zeros(size), np.zeros(size)
    for t, y in zip(docs, labels):
        (pos if y else neg)[t] += 1
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    z = _apart(pos, neg, n1, n0)
    z[pos + neg < 3] = 0
    common = np.argsort(-(pos + neg), kind="stable")[:PAIR_TERMS]
    place = np.full(size, -1)
    place[common] = np.arange(len(common))
    both = np.zeros((2, len(common), len(common)), np.float32)
    for y in (0, 1):
        own = [t for t, label in zip(docs, labels) if (label > 0) == y]
        for at in range(0, len(own), 1024):
            part = own[at : at + 1024]
            has = np.zeros((len(part), len(common)), np.float32)
            for row, t in zip(has, part):
                row[place[t][place[t] >= 0]] = 1
            both[y] += has.T @ has
    pair = _apart(both[1], both[0], n1, n0)
    np.fill_diagonal(pair, 0)
    # A pair is of use if it says more than either term.
    pair[pair < 1.5 * np.maximum(z[common][:, None], z[common][None, :])] = 0
    best_pair = pair.max(axis=1, initial=0)
    z[common] = np.maximum(z[common], np.where(best_pair > PAIR_SCORE, best_pair, 0))
    best = np.argsort(-z, kind="stable")[:limit]
    return best[z[best] > TERM_SCORE]


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 20, seed: int = 11) -> FactorMachine:
    """Adagrad over the log loss, one document at a time.

    The rarer class counts more, by the fourth root of how much rarer it is.
    """
    rng = np.random.default_rng(seed)
    chosen = select_terms(docs, labels, FIT_TERMS) if len(docs) else np.zeros(0, np.int64)
    place = np.zeros(1 << BITS, np.int32)
    place[chosen] = 1 + np.arange(len(chosen))
    rate = float(labels.mean()) if len(labels) else 0.5
    fm = FactorMachine(place, np.zeros(len(chosen) + 1), rng.normal(0, 0.02, (len(chosen) + 1, FACTORS)), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    fm.factors[0] = 0
    odds = (1 - rate) / rate if 0 < rate < 1 else 1.0
    weight = np.where(labels == 1, max(1.0, odds**0.25), max(1.0, odds**-0.25))
    gw, gv = np.full_like(fm.weights, 1e-2), np.full_like(fm.factors, 1e-2)
    rows = [r[r > 0] for r in (place[t] for t in docs)]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = fm.factors[r]
            total = v.sum(axis=0)
            z = fm.bias + fm.weights[r].sum() + 0.5 * (total @ total - (v * v).sum())
            err = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
            fm.bias -= 0.01 * err
            if not len(r):
                continue
            dw, dv = err + 2e-4 * fm.weights[r], err * (total - v) + 2e-3 * v
            gw[r] += dw * dw
            gv[r] += dv * dv
            fm.weights[r] -= 0.4 * dw / np.sqrt(gw[r])
            fm.factors[r] -= 0.08 * dv / np.sqrt(gv[r])
    return fm


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> FactorMachine:
    """Fit on the terms of at most ``limit`` labelled documents; terms are taken on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([terms(t.as_py()).astype("<i4").tobytes() for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), found, b.column(2)], names=["doc_id", "terms", "label"])

    sample = fit_sample(docs, labels, "toxic", limit)
    kinds = dict(sample.dtypes)
    rows = sample.mapInArrow(run, f"doc_id {kinds['doc_id']}, terms binary, label {kinds['label']}").toArrow()
    got = sorted(zip(*(c.to_pylist() for c in rows.columns)), key=lambda r: (r[0], r[1]))
    return fit([np.frombuffer(t, "<i4") for _, t, _ in got], np.array([y for _, _, y in got], dtype=np.float64))


def score_toxicity(docs: DataFrame, fm: FactorMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row, from the set of all its terms.

    Null and empty texts score as texts without known terms.  One narrow pass.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((fm.place, fm.weights, fm.factors, fm.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FactorMachine(*sent.value)
        for b in batches:
            score = np.array([model.score(t.as_py()) for t in b.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
