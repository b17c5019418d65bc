"""URL filter: host and path rules first, then a weighted vocabulary.

The vocabulary is matched with one Aho-Corasick automaton over the URL in
lower case.  A hit counts only between boundaries: the characters on either
side, if any, are no ASCII letters or digits.  One strict term rejects; soft
terms reject when distinct ones together weigh at least ``soft_limit``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

#: Default vocabulary, by subject; a caller's own goes into :class:`UrlPolicy` or comes from a table.
STRICT = (
    "casino", "roulette", "blackjack", "slots", "jackpot",
    "viagra", "cialis", "pills", "levitra", "steroids",
    "porn", "porno", "xxx", "hentai", "escort", "camgirls", "milf", "nsfw",
    "phishing", "malware", "warez", "keygen", "crackz", "serialz", "torrentz", "botnet",
)
SOFT = {
    "win": 1.0, "winner": 1.0, "prize": 1.0, "bonus": 1.0, "bet": 1.0, "betting": 1.0, "poker": 1.0, "lottery": 1.0,
    "cheap": 1.0, "discount": 0.5, "offer": 0.5, "deal": 0.5, "coupon": 0.5, "replica": 1.0, "wholesale": 0.5,
    "ads": 1.0, "adserver": 1.0, "track": 1.0, "tracker": 1.0, "popup": 1.0, "affiliate": 1.0, "click": 0.5, "redirect": 0.5,
    "free": 1.0, "download": 0.5, "crack": 1.0, "torrent": 1.0, "hack": 1.0,
    "loan": 1.0, "payday": 1.0, "credit": 0.5, "crypto": 0.5, "forex": 1.0,
    "adult": 1.0, "sexy": 1.0, "dating": 1.0, "nude": 1.0, "webcam": 0.5,
}
SOFT_LIMIT = 2.0
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


_TYPES = {"host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string(), "strict_hits": pa.int64(), "soft_weight": pa.float64()}


@dataclass
class UrlPolicy:
    """``rules``: (host with path, verdict); ``strict`` and ``soft`` terms in lower case.

    The tables are plain data sent with the function; rules and terms are a
    configuration of the caller, not taken from the corpus.
    """

    rules: tuple[tuple[str, str], ...] = RULES
    strict: tuple[str, ...] = STRICT
    soft: dict[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_limit: float = SOFT_LIMIT

    def __post_init__(self) -> None:
        self._by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in self.rules:
            host, slash, rest = rule.partition("/")
            self._by_host.setdefault(host, []).append((slash + rest, rule, verdict))
        for found in self._by_host.values():
            found.sort(key=lambda x: -len(x[0]))
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term in {*self.strict, *self.soft}:
                self._automaton.add_word(term, term)
            self._automaton.make_automaton()
        return self._automaton

    def rule_for(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits: every suffix of the host at a dot is looked up."""
        best: tuple[str, str] | None = None
        start = 0
        while True:
            for prefix, rule, verdict in self._by_host.get(host[start:], ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            dot = host.find(".", start)
            if dot < 0:
                return best
            start = dot + 1

    def terms(self, url: str) -> tuple[int, set[str]]:
        """Count of strict hits and the distinct soft terms of a URL."""
        text = url.translate(_TO_LOWER)
        strict, soft = 0, set()
        for end, term in self.automaton().iter(text):
            before, after = end - len(term), end + 1
            if (before >= 0 and text[before] in _WORD) or (after < len(text) and text[after] in _WORD):
                continue
            if term in self.soft:
                soft.add(term)
            if term in self.strict:
                strict += 1
        return strict, soft

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, float]:
        url = url or ""
        found = _PARTS.search(url)
        host, path = (found[1].translate(_TO_LOWER), found[2]) if found else ("", "")
        strict, soft = self.terms(url)
        weight = float(sum(self.soft[x] for x in soft))
        verdict = "block" if strict or weight >= self.soft_limit else "allow"
        rule = self.rule_for(host, path)
        return host, path, rule[0] if rule else None, rule[1] if rule else verdict, strict, weight


def policy_from(terms: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, soft_limit: float = SOFT_LIMIT) -> UrlPolicy:
    """A policy from a table of terms (term, weight): those without a weight are strict.

    The table is a configuration that a caller keeps, not a product of the corpus, and comes to the driver whole.
    """
    rows = terms.select(F.lower("term").alias("term"), F.col("weight").cast("double").alias("weight")).filter("term <> ''").collect()
    strict = tuple(sorted({r.term for r in rows if r.weight is None}))
    return UrlPolicy(rules, strict, {r.term: r.weight for r in rows if r.weight is not None}, soft_limit)


def judge_urls(pages: DataFrame, policy: UrlPolicy | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_weight of every page.

    A null URL or one without ``://`` has an empty host and path; its terms
    still count.  Rows are judged one by one, so repeated rows come out as often
    as they went in, and an empty table gives an empty result.  One narrow pass:
    no shuffle, and no column but the two read.
    """
    policy = policy or UrlPolicy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(policy.judge(u) for u in b.column(1).to_pylist()))) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, _TYPES.values())]], names=["page_id", *_TYPES])

    kind = dict(pages.dtypes)["page_id"]
    schema = f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits long, soft_weight double"
    return pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(run, schema)
