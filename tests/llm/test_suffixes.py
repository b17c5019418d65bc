"""op4 against every run of 50 words in a dictionary."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from conftest import prose

from wrackline.llm import queries, suffixes


def words(text) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


def brute(rows):
    docs = {}
    for d, t in rows:
        docs[(d, t)] = words(t)
    seen = defaultdict(set)
    for key, w in docs.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(key)
    out = []
    for key, w in docs.items():
        ranges = []
        for i in range(len(w) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                if ranges and i <= ranges[-1][1]:
                    ranges[-1][1] = i + 50
                else:
                    ranges.append([i, i + 50])
        if ranges:
            out.append((key[0], len(ranges), sum(e - s for s, e in ranges), ",".join(f"{s}:{e}" for s, e in ranges)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_spans, r.repeated_words, r.spans) for r in df.collect()), key=str)


def test_query_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op4_suffix_dedup(spark, sf_dir)) == brute(rows)


def test_odd_rows_and_empty_table(odd_docs, odd_rows, no_docs):
    assert rows_of(suffixes.repeated_passages(odd_docs)) == brute(odd_rows)
    assert rows_of(suffixes.repeated_passages(no_docs)) == []


@pytest.mark.parametrize("group_rows", [suffixes.GROUP_ROWS, 3])
def test_passages_around_the_limit(spark, group_rows):
    rng = random.Random(9)
    rows = []
    for n in (48, 49, 50, 51, 52, 60, 75, 100, 300):
        passage = prose(rng, n)
        for _ in range(3):
            before, after = prose(rng, rng.randint(0, 40)), prose(rng, rng.randint(0, 40))
            rows.append((len(rows), f"{before} {passage} {after}"))
    shared = prose(rng, 55)
    rows += [(900 + i, prose(rng, 20) + " " + shared + ", " + prose(rng, 20) + " " + shared.upper()) for i in range(12)]
    rows += [(950, "same " * 200), (951, "same " * 120), (952, "same " * 49)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(suffixes.repeated_passages(docs, group_rows=group_rows)) == brute(rows)
