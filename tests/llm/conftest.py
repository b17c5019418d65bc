"""Documents with everything that real tables hold."""

from __future__ import annotations

import random

import pytest

LONG = 60_000


def prose(rng: random.Random, n: int) -> str:
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "za", "pre", "sto", "gle"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, repeated rows, ties."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(rng, 70)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "one"), (6, "ONE"), (7, base), (8, base.upper()), (9, " ".join(near))]
    rows += [(10, base), (10, base), (11, None), (12, "naïve Ünïcode ÀÉ 😀 text"), (13, "NAÏVE Ünïcode ÀÉ 😀 text")]
    rows += [(None, base), (None, "only without an id"), (14, prose(rng, 30) + " " + passage + " " + prose(rng, 30)), (15, passage + " " + prose(rng, 9))]
    rows += [(16, prose(rng, LONG)), (17, "x" * 300_000), (18, "a " * 50_000)]
    rows += [(100 + i, prose(rng, rng.randint(1, 200))) for i in range(40)]
    return rows


#: Columns that operators use inside, here with other contents.
CLASHES = ("fp", "node", "digest", "keep_id", "kept", "count", "row_key", "words", "length", "start", "score", "label", "found", "lost_id", "text_sha256", "n_bytes", "item_id", "pos", "key", "lang")


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, "doc_id bigint, text string").repartition(5)
    return docs.select("doc_id", "text", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
