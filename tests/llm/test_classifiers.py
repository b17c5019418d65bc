"""op5 and op7: held-out accuracy, folds, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from wrackline.llm import bytecnn, queries, toxicity, wordhash
from wrackline.llm.common import doc_fold

BIG = {"quality": "/root/testdata/sf0.01", "toxic": "/root/testdata/sf0.1"}  # 70 and 825 held-out labels


def auc(score, label) -> float:
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query,column,threshold,least", [(queries.op5_quality, "quality", 0.3, 0.9), (queries.op7_toxicity, "toxic", 0.5, 0.9)])
def test_held_out(spark, query, column, threshold, least):
    rows = {r.doc_id: r for r in query(spark, BIG[column]).collect()}
    docs = spark.read.parquet(f"{BIG[column]}/documents.parquet")
    assert len(rows) == docs.select("doc_id").distinct().count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows.values())
    known = [(rows[r.doc_id].score, r[column]) for r in spark.read.parquet(f"{BIG[column]}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out and r[column] is not None]
    score, label = map(np.array, zip(*known))
    assert auc(score, label) >= least


def test_labels_of_fold_zero_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", bytecnn.F.when(doc_fold(bytecnn.F.col("doc_id")) == 0, 1 - bytecnn.F.col("toxic")).otherwise(bytecnn.F.col("toxic")))
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs, other)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.factors, b.factors)


def test_pairs_say_what_terms_alone_do_not():
    rng = np.random.default_rng(1)
    a, b = 100, 200
    docs, y = [], []
    for _ in range(1200):
        has_a, has_b = rng.random(2) < 0.5
        noise = rng.integers(1000, 1200, 6)
        docs.append(np.unique(np.concatenate(([a] if has_a else [], [b] if has_b else [], noise)).astype(np.int64)))
        y.append(float(has_a and has_b))
    fm = toxicity.fit(docs, np.array(y), epochs=30)
    margin = lambda *t: fm.margin(fm.place[np.array(t)])
    assert margin(a, b) > 0 > max(margin(a), margin(b))


def test_terms_that_matter_in_pairs_only_are_taken():
    rng = np.random.default_rng(4)
    docs, y = [], []
    for i in range(2000):
        toxic = i % 4 == 0
        pair = [100, 200] if toxic and rng.random() < 0.5 else []
        # Clean documents have either term as often as toxic ones, but never both.
        one = [] if toxic else ([100] if i % 2 else []) if rng.random() < 0.5 else ([200] if i % 3 else [])
        docs.append(np.unique(np.array([*pair, *one, *rng.integers(1000, 1400, 8)], dtype=np.int64)))
        y.append(float(toxic))
    chosen = toxicity.select_terms(docs, np.array(y), 100)
    assert {100, 200} <= set(chosen.tolist())


def test_terms_and_margin_against_brute_force():
    rng = np.random.default_rng(5)
    text = "Abcdefg abcdxyz abcd ABCDq, x\u00e9x\u00e9x\u00e9 " * 3 + "alone"
    got = toxicity.terms(text)
    low = text.lower().replace(",", "").split()

    def bucket(h: int) -> int:
        return h >> (64 - toxicity.BITS)

    def hashed(piece: bytes) -> int:
        return sum(x * pow(wordhash.BASE, i, 1 << 64) for i, x in enumerate(piece)) % (1 << 64)

    def mixed(h: int) -> int:
        return int(wordhash.mix(np.array([h % (1 << 64)], np.uint64))[0])

    want = {bucket(mixed(hashed(w.encode()))) for w in low}
    by_stem: dict[bytes, set[str]] = {}
    for w in low:
        if len(w.encode()) > toxicity.STEM:
            by_stem.setdefault(w.encode()[: toxicity.STEM], set()).add(w)
    for stem, own in by_stem.items():
        h = mixed(hashed(stem) + toxicity.STEM)
        want.add(bucket(h))
        if len(own) > 1:
            want.add(bucket(mixed(h + 1)))
    assert got.tolist() == sorted(want)
    fm = toxicity.FactorMachine(np.zeros(1 << toxicity.BITS, np.int32), rng.normal(size=9), rng.normal(size=(9, 6)), -0.3)
    fm.place[got[:8]] = np.arange(1, 1 + len(got[:8]))
    rows = [int(x) for x in fm.place[got] if x]
    slow = fm.bias + sum(fm.weights[i] for i in rows) + sum(float(fm.factors[i] @ fm.factors[j]) for a, i in enumerate(rows) for j in rows[a + 1 :])
    assert abs(fm.margin(fm.place[got]) - slow) < 1e-9
    assert toxicity.terms(None).size == toxicity.terms("").size == 0


def test_network_is_a_pool_over_all_places():
    rng = np.random.default_rng(2)
    net = bytecnn.ByteCnn.blank(rng)
    data = rng.integers(32, 127, 40_000).astype(np.uint8)
    half = net.halves(data)
    z = sum(net.tables[j][data[j : j + len(data) - bytecnn.WIDTH + 1]] for j in range(bytecnn.WIDTH))
    slow = np.stack([z[i : i + bytecnn.HALF].max(axis=0) for i in range(0, len(z), bytecnn.HALF)])
    assert np.allclose(half, slow)


def test_fit_pools_as_scoring_does():
    rng = np.random.default_rng(3)
    net = bytecnn.ByteCnn.blank(rng)
    for n in (0, 1, 5, 6, 133, 134, 261, 262, 1000):
        text = "".join(map(chr, rng.integers(32, 127, n)))
        top, win = net.peaks(*bytecnn._halves(text))
        assert np.allclose(top, net.halves(np.frombuffer(text.encode(), np.uint8)))
        assert (win < np.maximum(1, bytecnn._halves(text)[1])[:, None]).all()


def test_sample_is_bounded_by_ids_and_bytes(spark):
    docs = spark.createDataFrame([(i % 400, "x" * 100) for i in range(1200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, quality int")
    rows = bytecnn.fit_sample(docs, labels, "quality", 150, 5000).collect()
    assert len(rows) == 50 == len({r.doc_id for r in rows})
    assert bytecnn.fit_sample(docs, labels, "quality", 150).count() == 150
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_odd_rows_and_empty_tables(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(7, 1, 0), (14, 0, 1), (16, 1, None), (999, 0, 1), (None, 1, 1), (1, 0, 0), (1, 1, 1)], "doc_id bigint, quality int, toxic int")
    none = labels.limit(0)
    for given in (labels, none):
        net, fm = bytecnn.fit_quality(odd_docs, given), toxicity.fit_toxicity(odd_docs, given)
        for scored in (bytecnn.score_quality(odd_docs, net), toxicity.score_toxicity(odd_docs, fm)):
            got = scored.collect()
            assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
        assert bytecnn.score_quality(no_docs, net).collect() == [] and toxicity.score_toxicity(no_docs, fm).collect() == []
    bytecnn.fit_quality(no_docs, labels), toxicity.fit_toxicity(no_docs, labels)
    kept = bytecnn.keep_good(odd_docs, net)
    assert kept.columns == odd_docs.columns and kept.count() in (0, len(odd_rows))
