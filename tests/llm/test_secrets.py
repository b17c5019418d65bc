"""op2: base patterns against Python's, and the randomness battery."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

from wrackline.llm import queries, secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def written(found) -> str:
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)


def check(rows, got) -> None:
    assert len(got) == len(rows)
    want = sorted(((d, *[sum(k == i for _, k, _ in brute(t or "")) for i in range(3)], hashlib.sha256(written(brute(t or "")).encode()).hexdigest()) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=str) == want


def test_query_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op2_secret_scan(spark, sf_dir).collect()
    check(rows, got)
    by = {}
    for d, t in rows:
        by.setdefault(d, set()).update(written([x]) for x in brute(t or ""))
    assert all(by[r.doc_id] <= set(r.spans.split(",")) for r in got if by[r.doc_id])


def test_odd_rows_and_empty_table(spark, odd_docs, odd_rows, no_docs):
    check(odd_rows, secrets.digests(odd_docs).collect())
    assert secrets.digests(no_docs).collect() == []


def test_patterns_at_their_edges(spark):
    rng = random.Random(2)
    bits = ["password", "PassWD", "api_key", "apikey", "Token", "secret", '"', "'", " ", ":", "=", "abc", "a1B2c3", "AKIA", "AKIA" + "Q" * 15, "AKIA" + "Z9" * 8, "deadbeef" * 3, "f" * 23, "\n", "é", "😀", "ſecret=abcdefg", "toKen=abcdefgh", "-_./+="]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    check(rows, secrets.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_many_matches_in_one_text(spark):
    text = "token=abcdefgh é " * 30_000
    row = secrets.digests(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.n_assign == 30_000
    assert row.base_sha256 == hashlib.sha256(written(brute(text)).encode()).hexdigest()


def test_battery_tells_keys_from_words(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(60)]
    plain = [f"my-long-identifier-name-{i}-of-a-file-path" for i in range(60)] + ["abcabcabc1" * 4, "a1" * 25, "0123456789abcdefghijklmnopqrstuvwxyz"] * 5
    rows = [(i, f"see {t} there") for i, t in enumerate(keys + plain)]
    got = {r.doc_id: r.n_random for r in secrets.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i] for i in range(60)) >= 50
    assert sum(got[i] for i in range(60, len(rows))) <= 2


def phi(z: float) -> float:
    z = max(min(z, 12.0), -12.0)
    return 1 / (1 + math.exp(-1.5976 * z - 0.07056 * z**3))


def slow_battery(token: str) -> tuple[float, float]:
    """p_random and p_text of a token, from the definitions of the three tests."""
    alphabet, excess = next((a, e) for p, a, e in secrets.ENCODINGS if re.search(p, token))
    n, k = len(token), len(alphabet)
    expected = n / k
    chi = sum((token.count(c) - expected) ** 2 / expected for c in alphabet)
    uneven = phi(-(chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [alphabet.index(c) >= k // 2 for c in token]
    ones = sum(high)
    mean = 1 + 2 * ones * (n - ones) / n
    spread = math.sqrt(max(0.0, (mean - 1) * (mean - 2) / (n - 1)))
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    by_runs = 2 * phi(-abs((runs - mean) / spread)) if spread > 0 else 0.0
    x = [alphabet.index(c) + 1.0 for c in token]
    m = sum(x) / n
    var = sum(v * v for v in x) - n * m * m
    r = sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / var if var > 0 else 0
    serial = 2 * phi(-abs((r + 1 / n) * math.sqrt(n))) if var > 0 else 0.0
    text = phi((chi - (k - 1 + (n - 1) * excess)) / math.sqrt(2 * (k - 1) + 4 * (n - 1) * excess))
    return min(1.0, 3 * min(uneven, by_runs, serial)), text


def slow_random(text: str) -> list[tuple[int, int, int]]:
    found = list(re.finditer(secrets.TOKEN, text))
    if not found:
        return []
    mixed = lambda t: re.search("[0-9]", t) and re.search("[A-Za-z]", t)
    p = [slow_battery(m[0]) if mixed(m[0]) else (0.0, 1.0) for m in found]
    mean = sum(len(m[0]) for m in found) / len(found)
    w = [b * mean / len(m[0]) for (_, b), m in zip(p, found)]
    limit = max([x for i, x in enumerate(sorted(w)) if x <= secrets.FALSE_SHARE * (i + 1) / len(w)], default=-1.0)
    return [(m.start(), 3, m.end()) for m, x, (a, _) in zip(found, w, p) if x <= limit and a >= secrets.REJECT_RANDOM]


def test_random_spans_against_brute_force(spark, sf_dir):
    rng = random.Random(8)
    alphabets = [string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits + "-_"]
    rows = [(i, " ".join("".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.05 else a) for _ in range(rng.randint(15, 70))) for a in rng.choices(alphabets, k=rng.randint(0, 5)))) for i in range(300)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.spans for r in secrets.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    off = [d for d, t in rows if [s for s in got[d].split(",") if s.startswith("random")] != written(slow_random(t or "")).split(",") and (slow_random(t or "") or "random" in got[d])]
    assert off == []


def test_share_of_random_keys_that_are_found(spark):
    """Of keys over letters and digits: most of 32 characters, nearly all of 40 and more; no path or identifier."""
    rng = random.Random(9)
    sizes, each = (20, 24, 32, 40, 64), 300
    rows = [(1000 * n + i, "key " + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))) for n in sizes for i in range(each)]
    words = ["service", "billing", "report", "module", "handler", "default", "2023", "v2", "config", "north", "user", "item"]
    rows += [(i, "see " + rng.choice("-_/").join(rng.choice(words) for _ in range(6))) for i in range(900)]
    got = {r.doc_id: r.n_random for r in secrets.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    share = {n: sum(got[1000 * n + i] for i in range(each)) / each for n in sizes}
    print(share, sum(got[i] for i in range(900)))
    assert share[32] >= 0.9 and share[40] >= 0.97 and share[64] >= 0.97
    assert sum(got[i] for i in range(900)) <= 9
