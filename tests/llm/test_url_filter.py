"""op6: rules, vocabulary and odd URLs."""

from __future__ import annotations

from wrackline.llm import queries, url_filter
from wrackline.llm.url_filter import UrlPolicy

CASES = [
    ("http://Sub.Example.NET/en/x?casino", "sub.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("https://notexample.com/de/a", "notexample.com", "/de/a", None, "allow"),
    ("https://a.example.com/de/a#x", "a.example.com", "/de/a", "example.com/de/", "block"),
    ("https://example.com/de", "example.com", "/de", None, "allow"),
    ("http://wiki.org/fr/casino", "wiki.org", "/fr/casino", "org/fr/", "allow"),
    ("http://net", "net", "", None, "allow"),
    ("http://planet/", "planet", "/", None, "allow"),
    ("a://b.com?x=://c", "b.com", "", None, "allow"),
    ("no scheme casino", "", "", None, "block"),
    ("http://x.com/casinos", "x.com", "/casinos", None, "allow"),
    ("http://x.com/free-CHEAP", "x.com", "/free-CHEAP", None, "block"),
    ("http://x.com/free/free/free", "x.com", "/free/free/free", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄB.com/ü", "Äb.com".replace("b", "b"), "/ü", None, "allow"),
]


def test_cases(spark):
    pages = spark.createDataFrame([(i, c[0], "h", "r") for i, c in enumerate(CASES)], "page_id bigint, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}
    assert url_filter.judge_urls(pages.limit(0)).collect() == []


def test_terms_against_a_scan():
    policy = UrlPolicy(strict=("bad", "ad"), soft={"free": 1.0, "reef": 1.0, "ee": 1.0})
    for url in ("bad", "badad", "x.bad/ad-free", "free.reef-ee", "freereef ee", "3bad", "bad_é", "", "x" * 100_000 + "/bad"):
        text = url.lower()
        ok = lambda i, t: not (i and text[i - 1].isascii() and text[i - 1].isalnum()) and not (i + len(t) < len(text) and text[i + len(t)].isascii() and text[i + len(t)].isalnum())
        at = lambda t: [i for i in range(len(text)) if text.startswith(t, i) and ok(i, t)] if t in text else []
        assert policy.terms(url) == (sum(len(at(t)) for t in policy.strict), {t for t in policy.soft if at(t)})


def test_query_on_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = queries.op6_url_filter(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(r.page_id for r in pages.select("page_id").collect())
    policy = UrlPolicy()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert all((r.host, r.path, r.rule, r.verdict) == policy.judge(urls[r.page_id])[:4] for r in got)


def test_policy_from_a_table_and_repeated_rows(spark):
    terms = spark.createDataFrame([("Bad", None), ("so", 1.0), ("la", 1.5), ("", 1.0), (None, 1.0)], "term string, weight double")
    policy = url_filter.policy_from(terms)
    assert policy.strict == ("bad",) and policy.soft == {"so": 1.0, "la": 1.5}
    pages = spark.createDataFrame([(1, "http://a.io/so-la"), (1, "http://a.io/so-la"), (2, "http://a.io/so"), (3, "http://bad.io"), (None, None)], "page_id bigint, url string")
    got = sorted(((r.page_id, r.verdict) for r in url_filter.judge_urls(pages, policy).collect()), key=str)
    assert got == [(1, "block"), (1, "block"), (2, "allow"), (3, "block"), (None, "allow")]
