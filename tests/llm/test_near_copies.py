"""The near-dedup stage against exact five-word shingle similarity of all pairs."""

from __future__ import annotations

import random

from conftest import prose

import corpus_pipeline
from wrackline.llm import exact_dedup, near_copies
from wrackline.llm.wordhash import words


def shingles(text) -> frozenset:
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset([text or ""])


def brute(rows, similarity=0.8):
    """doc_id to the least one that links reach."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-9:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def edited(rng, words, kind, share):
    """A copy whose edits of a kind take about a share of the words."""
    n = max(1, int(share * len(words)))
    at = rng.randrange(len(words) - n)
    if kind == "appended":
        return words + prose(rng, n).split()
    if kind == "cut":
        return words[:-n]
    if kind == "block":
        return words[:at] + prose(rng, n).split() + words[at + n :]
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, n // 5)):
        out[i] = "zq" + str(rng.randint(0, 999))
    return out


def corpus(kinds, shares, groups=12, seed=3):
    rng = random.Random(seed)
    rows = []
    for kind in kinds:
        for share in shares:
            for _ in range(groups):
                words = prose(rng, rng.randint(60, 400)).split()
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited(rng, words, kind, share)))]
    return rows


def components(spark, rows):
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return {r.doc_id: r.component_id for r in found}


def test_no_copy_is_lost_whatever_the_edit(spark):
    rows = corpus(("appended", "cut", "block", "scattered"), (0.02, 0.07, 0.1, 0.15, 0.18))
    want = brute(rows)
    assert sum(d != c for d, c in want.items()) > 100
    assert {d: c for d, c in components(spark, rows).items() if want[d] != d} == {d: c for d, c in want.items() if c != d}


def test_documents_below_the_similarity_stay(spark):
    rows = corpus(("appended", "cut", "block", "scattered"), (0.21, 0.24, 0.28, 0.35), seed=4)
    want = brute(rows)
    assert sum(d == c for d, c in want.items()) > 300
    assert components(spark, rows) == want


def test_a_large_component_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "GROUP_DOCS", 20)
    rng = random.Random(5)
    words = prose(rng, 150).split()
    rows = [(i, " ".join(edited(rng, words, "scattered", rng.choice((0.04, 0.1, 0.16, 0.2))))) for i in range(150)]
    assert components(spark, rows) == brute(rows)


def test_a_dense_group_needs_no_tiles_and_stragglers_meet_all(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "GROUP_DOCS", 10)
    rng = random.Random(9)
    words = prose(rng, 200).split()
    # 80 copies that are close to one another, and some that are near only few of them.
    rows = [(i, " ".join(edited(rng, words, "scattered", 0.03))) for i in range(80)]
    far = words
    for i in range(80, 110):
        far = edited(rng, far if i % 3 else rows[rng.randrange(80)][1].split(), "block", 0.12)
        rows.append((i, " ".join(far)))
    want = brute(rows)
    assert len(set(want.values())) > 1
    assert components(spark, rows) == want
    tiles = []
    monkeypatch.setattr(near_copies, "_tiles", lambda nodes, make=near_copies._tiles: tiles.append(nodes.count()) or make(nodes))
    assert components(spark, rows[:80]) == {i: 0 for i in range(80)}
    assert tiles == [0]


def test_common_shingles_are_kept_apart(spark, monkeypatch):
    rows = corpus(("appended", "block", "scattered"), (0.05, 0.15, 0.25), groups=6, seed=11)
    rng = random.Random(12)
    shared = prose(rng, 40)
    rows = [(i, f"{shared} {t} {shared}" if i % 3 else t) for i, t in rows]
    want = brute(rows)
    monkeypatch.setattr(near_copies, "HOT_IN_BATCH", 2)
    seen = []
    links = near_copies.copy_links
    monkeypatch.setattr(near_copies, "copy_links", lambda t, s, common: seen.append(len(common)) or links(t, s, common))
    for least, most in ((10**9, 10), (10, 10**6), (2, 10**6), (2, 7)):
        monkeypatch.setattr(near_copies, "HOT_ROWS", least)
        monkeypatch.setattr(near_copies, "HOT_MOST", most)
        assert components(spark, rows) == want
    assert seen[0] == 0 and 0 < seen[1] < seen[2] and seen[3] == 7


def test_stage_on_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    left = sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect())
    assert left == sorted(d for d, c in brute(rows).items() if d == c)


def test_wordless_texts_are_told_apart(spark):
    rows = [(1, "..."), (2, "***"), (3, "..."), (4, None), (5, ""), (6, "* * *")]
    assert components(spark, rows) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6}


def test_one_of_repeated_rows_stays_in_either_stage(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b), (None, c), (None, c), (None, c.upper()), (4, "alone"), (None, "by itself")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, `row.key` string").repartition(4)
    for stage, id_of_a in ((exact_dedup.drop_copies, 2), (near_copies.drop_near_copies, 1)):
        out = stage(docs)
        assert out.columns == docs.columns
        got = sorted(((r.doc_id, r.text.lower()) for r in out.collect()), key=str)
        assert got == sorted([(id_of_a, a), (3, b), (None, c), (4, "alone"), (None, "by itself")], key=str)


def test_fingerprint_is_the_simhash_of_the_pairs_of_words():
    h = words("One two, three TWO three one")[0]
    pairs = {int(g) for g in near_copies.grams(h, 2)}
    assert len(pairs) == 4  # "two three" counts once
    assert near_copies.copy_fingerprint(h) == sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in pairs) > 4)
    assert near_copies.copy_fingerprint(words("one")[0]) == int(near_copies.grams(words("one")[0], 1)[0])
    assert near_copies.copy_fingerprint(words("...")[0]) == 0


def test_stage_links_by_simhash_and_the_gray_index_first(spark, sf_dir, monkeypatch):
    rows = corpus(("appended", "scattered"), (0.005, 0.01, 0.02), seed=21)
    want = brute(rows)
    searched, compared = [], []
    links, checked = near_copies.fingerprint_links, near_copies._checked

    def seen(edges, own, similarity):
        out = near_copies.checkpointed(checked(edges, own, similarity))
        compared.append((edges.count(), out.count()))
        return out

    monkeypatch.setattr(near_copies, "fingerprint_links", lambda fps, radius: searched.append(fps.count()) or links(fps, radius))
    monkeypatch.setattr(near_copies, "_checked", seen)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id for r in corpus_pipeline.near(spark, docs, sf_dir).collect()}
    assert left == {d for d, c in want.items() if d == c}
    gone = len(rows) - len(left)
    assert len(searched) == 1 and searched[0] > gone
    (_, by_simhash), (others, _) = compared
    # What SimHash linked is not compared again.
    assert by_simhash >= 0.9 * gone > 50 and others <= gone - by_simhash


def test_the_simhash_decides_no_link_and_loses_none(spark, monkeypatch):
    rows = corpus(("appended", "block", "scattered"), (0.05, 0.15, 0.25), groups=6, seed=22)
    want = brute(rows)
    for radius in (0, 14):
        monkeypatch.setattr(near_copies, "FP_RADIUS", radius)
        assert components(spark, rows) == want
    monkeypatch.setattr(near_copies, "copy_fingerprint", lambda h: 0)
    assert components(spark, rows) == want
