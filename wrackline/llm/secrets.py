r"""Secret scan with DataFrame functions only.

Base patterns (assignments, access keys, long hex strings) are matched
leftmost and without overlap.  On top of them a battery of randomness tests
looks at every long token of an encoding that keys come in:

* chi-squared of the character counts against a uniform alphabet,
* Wald-Wolfowitz runs over the lower and upper half of the alphabet,
* lag-one serial correlation of the characters' places in it.

The alphabet is that of the encoding inferred from the token's characters.  A
token is reported if no test rejects randomness (Bonferroni over the three)
and if the hypothesis that it is structured text is rejected: its chi-squared
lies too low for the uneven letters of words and identifiers.  How far apart
the two hypotheses lie grows with the length, so short tokens need more.  A
Benjamini-Hochberg step over all tokens of the document, weighted by length,
bounds the share of false discoveries.

Spans come from the lengths of what stands between matches, so no position is
searched twice, and every step works on a whole text inside its own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 6

_UP, _LOW, _NUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: (pattern of the whole token, alphabet, excess of the chi-squared per character in structured text)
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef", 0.6),
    ("^[0-9A-F]+$", "0123456789ABCDEF", 0.6),
    ("^[A-Z2-7]+$", _UP + "234567", 1.1),
    ("^[a-z0-9]+$", _LOW + _NUM, 1.3),
    ("^[A-Z0-9]+$", _UP + _NUM, 1.3),
    ("^[A-Za-z0-9]+$", _UP + _LOW + _NUM, 2.7),
    ("^[A-Za-z0-9+/]+$", _UP + _LOW + _NUM + "+/", 2.8),
    ("^[A-Za-z0-9_-]+$", _UP + _LOW + _NUM + "-_", 2.8),
    ("^", _UP + _LOW + _NUM + "+/-_", 3.0),
)
FALSE_SHARE = 0.05
REJECT_RANDOM = 0.001
_BLOCK = 512
_FOUND = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def running_starts(gaps: Column, lengths: Column) -> Column:
    """Start of each match, from what stands before each and their lengths.

    The sum runs in blocks, each appended as a whole, so a text with a great
    many matches doesn't copy the list of starts for each of them.
    """
    empty = "struct<at:int,out:array<int>>"
    pairs = F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("gap"), n.alias("len")))

    def blocks(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK)))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + x["gap"]
        return F.struct((at + x["len"]).alias("at"), F.concat(a["out"], F.array(at)).alias("out")).cast(empty)

    def one(done: Column, block: Column) -> Column:
        zero = F.struct(F.element_at(done, -1)["at"].alias("at"), F.array().cast("array<int>").alias("out")).cast(empty)
        return F.concat(done, F.array(F.aggregate(block, zero, step)))

    first = F.array(F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast(empty))
    return F.flatten(F.transform(F.aggregate(let(pairs, blocks), first, one), lambda d: d["out"]))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, F.char_length)


def spans_of(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """Spans (start, kind, end) of the matches; ``keep`` gets text and spans' matches and returns flags."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(m: Column) -> Column:
        lengths = _lengths(m)
        gaps = F.slice(_lengths(F.split(text, pattern, -1)), 1, F.size(m))
        found = F.zip_with(running_starts(gaps, lengths), lengths, lambda s, n: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + n).alias("end")))
        if keep is None:
            return found.cast(_FOUND)
        flagged = F.zip_with(found, keep(text, m), lambda f, k: F.struct(f.alias("f"), k.alias("k")))
        return F.transform(F.filter(flagged, lambda x: x["k"]), lambda x: x["f"]).cast(_FOUND)

    return let(matches, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(F.array().cast(_FOUND)))


def _long_values(text: Column, matches: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda v: F.char_length(v) >= MIN_VALUE)


# ---- randomness battery -------------------------------------------------------


def normal_cdf(z: Column) -> Column:
    """Phi(z), to within 2e-4."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _with_alphabet(token: Column, alphabet: str, excess: float) -> Column:
    """p_random and p_text of a token over one alphabet."""
    k = len(alphabet)
    n = F.char_length(token).cast("double")
    counts = F.transform(F.array(*map(F.lit, alphabet)), lambda c: (n - F.char_length(F.replace(token, c, F.lit("")))).cast("double"))
    chi = _total(F.transform(counts, lambda c: c * c)) * k / n - n
    uneven = normal_cdf(-(chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n))
    level = k - 1 + (n - 1) * excess
    text_like = normal_cdf((chi - level) / F.sqrt(2.0 * (k - 1) + 4.0 * (n - 1) * excess))

    bits = F.translate(token, alphabet, "0" * (k // 2) + "1" * (k - k // 2))

    def runs_p(b: Column) -> Column:
        ones = n - F.char_length(F.replace(b, F.lit("1"), F.lit("")))
        mean = 1 + 2.0 * ones * (n - ones) / n
        changes = 2 * n - F.char_length(F.replace(b, F.lit("01"), F.lit("0"))) - F.char_length(F.replace(b, F.lit("10"), F.lit("1")))
        spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        return F.when(spread > 0, 2 * normal_cdf(-F.abs((changes + 1 - mean) / spread))).otherwise(F.lit(0.0))

    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))

    def serial_p(x: Column) -> Column:
        mean = _total(x) / n
        variance = _total(F.transform(x, lambda v: v * v)) - n * mean * mean
        ahead = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - mean) * (b - mean))
        r = _total(ahead) / variance
        return F.when(variance > 0, 2 * normal_cdf(-F.abs((r + 1 / n) * F.sqrt(n)))).otherwise(F.lit(0.0))

    def both(p: Column) -> Column:
        return F.struct(F.least(F.lit(1.0), 3 * F.array_min(p)).alias("p_random"), text_like.alias("p_text"))

    return let(F.array(uneven, let(bits, runs_p), let(places, serial_p)), both)


def battery(token: Column) -> Column:
    """Struct of p_random and p_text; the encoding is the narrowest that fits."""
    out: Column | None = None
    for pattern, alphabet, excess in ENCODINGS:
        case = _with_alphabet(token, alphabet, excess)
        out = F.when(token.rlike(pattern), case) if out is None else out.when(token.rlike(pattern), case)
    return out


def _random_tokens(text: Column, tokens: Column) -> Column:
    """Flags of the tokens that the battery reports."""
    mixed = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    none = F.struct(F.lit(0.0).alias("p_random"), F.lit(1.0).alias("p_text"))
    tested = F.transform(tokens, lambda t: F.when(mixed(t), battery(t)).otherwise(none))
    mean = _total(F.transform(tokens, lambda t: F.char_length(t).cast("double"))) / F.size(tokens)

    def decide(scored: Column) -> Column:
        weighted = F.zip_with(scored, tokens, lambda s, t: s["p_text"] * mean / F.char_length(t))

        def cut(w: Column) -> Column:
            ranked = F.transform(F.array_sort(w), lambda p, i: F.when(p <= FALSE_SHARE * (i + 1) / F.size(w), p))
            limit = F.coalesce(F.array_max(ranked), F.lit(-1.0))
            return let(limit, lambda top: F.zip_with(scored, w, lambda s, p: (p <= top) & (s["p_random"] >= REJECT_RANDOM)))

        return let(weighted, cut)

    return let(tested, decide)


# ---- the operator -------------------------------------------------------------


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (start, kind, end) by start, then kind.

    Offsets count code points, the end is exclusive, ``kind`` is an index of
    :data:`KINDS`.  A null text counts as empty and has no spans.  Rows are
    independent; other columns of ``docs`` are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def every(t: Column) -> Column:
        return F.concat(
            spans_of(t, ASSIGN, 0, _long_values),
            F.when(F.contains(t, F.lit("AKIA")), spans_of(t, ACCESS, 1)).otherwise(F.array().cast(_FOUND)),
            spans_of(t, HEX, 2),
            spans_of(t, TOKEN, 3, _random_tokens),
        )

    return rows.select("doc_id", F.array_sort(every(F.col("text"))).alias("found"))


def written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < 3)
    return scan(docs).select(
        "doc_id",
        *[count(i).alias(f"n_{name}") for i, name in enumerate(KINDS)],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
