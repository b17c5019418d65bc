"""op10 against a grouping in Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from wrackline.llm import exact_dedup, queries
from wrackline.llm.common import LOWER, UPPER

TABLE = str.maketrans(UPPER, LOWER)


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(TABLE)].append(d)
    out = []
    for d, t in rows:
        norm = (t or "").translate(TABLE)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_query_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op10_exact_dedup(spark, sf_dir)) == brute(rows)


def test_odd_rows_and_empty_table(odd_docs, odd_rows, no_docs):
    assert rows_of(exact_dedup.exact_dedup(odd_docs)) == brute(odd_rows)
    assert rows_of(exact_dedup.exact_dedup(no_docs)) == []


def test_colliding_cheap_keys(spark):
    rows = [(i, "a" * 64 + c) for i, c in enumerate("xyxzé"[:4] * 3)] + [(90, "ab"), (91, "ba")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(exact_dedup.exact_dedup(docs)) == brute(rows)


def test_drop_copies_keeps_one_of_each(odd_docs, odd_rows):
    left = exact_dedup.drop_copies(odd_docs)
    assert left.columns == odd_docs.columns
    texts = {(t or "").translate(TABLE) for _, t in odd_rows}
    assert {(r.text or "").translate(TABLE) for r in left.collect()} == texts
