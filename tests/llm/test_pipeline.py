"""The pipeline against stages in plain Python where they have a brute-force form."""

from __future__ import annotations

from test_decontaminate import brute as leaks
from test_exact_dedup import TABLE
from test_near_copies import brute as near_brute

import corpus_pipeline
from wrackline.llm import bytecnn


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := str(tmp_path / str(i)))
        out = spark.read.parquet(path)
        if i < 4:
            assert out.columns == docs.columns
        seen[name] = out
        docs = out
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in seen.items()}
    quality, exact, near, clean, packed = (ids[n] for n, _ in corpus_pipeline.STAGES)
    net = bytecnn.fit_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert quality == {d for d, t in rows.items() if net.score(t) >= bytecnn.THRESHOLD}
    best = {}
    for d in quality:
        t = (rows[d] or "").translate(TABLE)
        best[t] = max(best.get(t, d), d)
    assert exact == set(best.values())
    copies = near_brute([(d, rows[d]) for d in sorted(exact)])
    assert near == {d for d, c in copies.items() if d == c}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean == near - {d for d, _ in leaks([(d, rows[d]) for d in near], items)}
    assert packed == clean
    again = corpus_pipeline.run(spark, sf_dir)
    digest = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert digest(again) == digest(seen["packing"])


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        count = docs.count()
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            assert i == 4 or out.columns == docs.columns
            out.write.parquet(path := str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(path)
            assert i == 4 or docs.count() <= count
            count = docs.count()
        # What is left once is packed, each row by itself.
        last = spark.read.parquet(str(tmp_path / f"{name}3"))
        assert docs.filter("start = 0").count() == last.count()
        assert last.select("doc_id", "text").distinct().count() == last.count()
