"""op3 against a comparison of every window with every item."""

from __future__ import annotations

import random
from collections import Counter

import regex
from conftest import prose

from wrackline.llm import decontaminate, queries

GAP = regex.compile(r"[^\p{L}\p{N}]+")


def words(text) -> list[str]:
    return [w for w in GAP.split((text or "").lower()) if w]


def grams(w, k=5):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    """(doc_id, item_id) with a window of the item's size and a similarity of 0.8 or more."""
    out = set()
    for d, text in docs:
        w = words(text)
        for item, t in items:
            v = words(t)
            if not v:
                continue
            k = min(5, len(v))
            want, n = grams(v, k), len(v)
            total = sum(want.values())
            here = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            if not want.keys() & set(here):
                continue
            for s in range(max(1, len(w) - n + 1)):
                got = Counter(here[s : s + n - k + 1])
                if sum((got & want).values()) >= 0.8 * total - 1e-9:
                    out.add((d, item))
                    break
    return out


def test_query_on_whole_table(spark, sf_dir):
    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()]
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = queries.op3_decontamination(spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.similarity >= 0.8 for r in got)


def test_planted_and_clean(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(12, 60)).capitalize() + ".") for i in range(30)] + [(98, None), (99, "..."), (97, "two words")]
    docs = [(i, prose(rng, 300)) for i in range(40)]
    for i in range(30):
        w = prose(rng, 200).split()
        passage = items[i][1].upper().replace(" ", " - ").split() if i % 3 == 0 else items[i][1].split()
        at = rng.randint(0, 200)
        docs.append((100 + i, " ".join(w[:at] + passage + w[at:])))
        changed = items[i][1].split()
        changed[len(changed) // 2] = "altered"
        docs.append((200 + i, " ".join(w[:at] + changed + w[at:])))
        docs.append((300 + i, items[i][1]))
    docs += [(400, None), (401, ""), (402, "well two words here"), (402, "well two words here"), (None, items[3][1]), (403, items[5][1] + " " + items[5][1] + " " + items[6][1])]
    table = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id bigint, text string, item_id string, length int")
    bench = spark.createDataFrame([(*r, 2) for r in items], "item_id bigint, text string, doc_id int")
    got = decontaminate.find_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    left = {r.doc_id for r in decontaminate.drop_leaks(table, bench).collect()}
    assert left == {d for d, _ in docs} - {r.doc_id for r in got}


def test_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id bigint, text string")
    assert decontaminate.find_leaks(no_docs, bench).collect() == []
    assert decontaminate.find_leaks(odd_docs, bench.limit(0)).collect() == []
    assert decontaminate.find_leaks(odd_docs, bench).collect() == []


def test_no_leak_is_lost_for_its_fingerprint(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(12, 60))) for i in range(120)]
    docs = []
    for i, text in items:
        w = text.split()
        for j in range(4):
            n = max(1, int((0.16, 0.19)[j % 2] * (len(w) - 4)))
            new = [rng.choice(("zeta", "zq", "ox"))] * n if j < 2 else prose(rng, n).split()
            docs.append((10 * i + j, " ".join(prose(rng, 30).split() + new + w[n:] + prose(rng, 30).split())))
            docs.append((10 * i + j + 5, " ".join(prose(rng, 30).split() + w[:-n] + new + prose(rng, 30).split())))
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontaminate.find_leaks(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert max(r.hamming for r in got) > 15
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
