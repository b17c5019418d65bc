r"""Benchmark decontamination with DataFrame functions only.

A document is contaminated by an item if some window of it, as many words
long as the item, has a weighted shingle similarity to it of at least 0.8.

1. Anchors: a window with any similarity holds a shingle of the item, so only
   places where a document has one are looked at.  This is a join of shingle
   hashes with those of the benchmark, on the map side when the benchmark is
   small (its rows are counted first) and shuffled when it is not.
2. Windows: each anchor fixes one window of the item's size, at the offset
   that lines the two shingles up.
3. Pairs: a similarity of s leaves out at most 1 - s of an item's shingles, so
   among the item's rarest ones that make up more than this there is one that
   the document has.  Windows are compared with the items of which it has one;
   no pair is lost.
4. Verification: similarity is the weight of common shingles, each weighted
   by how often it occurs, over that of the item's.

Words are runs of letters and digits in lower case, so punctuation, spacing
and case don't hide a passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrackline.llm.common import BROADCAST_ROWS, checkpointed, row_key, sized, without

SHINGLE = 5
SIMILARITY = 0.8
_GAP = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _GAP), lambda w: w != "")


def shingle_hashes(words: Column, k: int) -> Column:
    """Hash of every run of k words; none where there are fewer."""

    def over(w: Column) -> Column:
        last = F.size(w) - k
        one = lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), over).getItem(0)


def word_simhash(words: Column) -> Column:
    """64-bit SimHash of a bag of words: a bit is 1 if set in over half of the hashes."""

    def over(h: Column) -> Column:
        def bit(i: int) -> Column:
            ones = F.aggregate(h, F.lit(0), lambda a, x: a + F.shiftrightunsigned(x, i).bitwiseAND(F.lit(1)).cast("int"))
            return F.when(2 * ones > F.size(h), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

        bits = F.array(*[bit(i) for i in range(64)])
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), over).getItem(0)


def common_weight(a: Column, b: Column) -> Column:
    """Total over distinct shingles of the lesser of their counts in a and in b."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A benchmark-side table of at most ``rows`` words or shingles, broadcast if these are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """row_key, doc_id, item_id, start, length, n_windows, hamming, similarity of each leak.

    One row for each document text and item, with the best window (the first
    of equal ones, in words).  An item shorter than a shingle is one shingle
    of all its words; one without words, or a null text, matches nothing.  Rows
    that repeat both id and text give one row; a null doc_id is kept.  Either
    table may be empty.  Columns beyond those read are ignored.
    """
    bench = items.select("item_id", words_of(F.col("text")).alias("words"))
    bench = bench.select("item_id", "words", F.size("words").alias("length")).filter("length > 0").dropDuplicates(["item_id", "words"])
    bench = checkpointed(bench.select("*", F.xxhash64("item_id", "words").alias("variant"), word_simhash(F.col("words")).alias("item_fp")))
    sizes = [r[0] for r in bench.select(F.least("length", F.lit(shingle)).alias("k")).distinct().collect()]  # at most `shingle` values
    total = bench.agg(F.sum("length")).first()[0] or 0

    named = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    named = named.select("doc_id", "text", row_key(named).alias("row_key"))

    def by_k(make) -> DataFrame:
        parts = [make(k) for k in sizes or [shingle]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def item_grams(k: int) -> DataFrame:
        own = bench.filter(F.least("length", F.lit(shingle)) == k)
        return own.select("variant", "length", F.posexplode(shingle_hashes(F.col("words"), k)).alias("at", "gram"))

    def doc_grams(k: int) -> DataFrame:
        return named.select("row_key", F.posexplode(shingle_hashes(words_of(F.col("text")), k)).alias("pos", "gram"))

    in_items = checkpointed(by_k(item_grams))
    counted = in_items.groupBy("variant", "length", "gram").agg(F.count(F.lit(1)).alias("weight"))
    counted = counted.join(counted.groupBy("gram").agg(F.count(F.lit(1)).alias("items")), "gram")
    before = Window.partitionBy("variant", "length").orderBy("items", "gram").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    left_out = (1 - similarity) * (F.col("length") - F.least("length", F.lit(shingle)) + 1)
    rare = checkpointed(ranked.filter(F.col("before") <= left_out + 1e-9).select("variant", "length", "gram"))

    anchors = by_k(doc_grams).join(_small(in_items.select("length", "at", "gram").distinct(), total), "gram")
    found = checkpointed(anchors.select("row_key", "gram", (F.col("pos") - F.col("at")).alias("start"), "length").distinct())
    hits, places = found.select("row_key", "gram").distinct(), checkpointed(found.select("row_key", "start", "length").distinct())
    pairs = hits.join(_small(rare, total), "gram").select("row_key", "variant", "length").distinct()

    # Only texts with an anchor are cut into words again; they are shuffled only where the places are many.
    texts = named.join(sized(checkpointed(places.select("row_key").distinct())), "row_key", "left_semi").select("row_key", "doc_id", words_of(F.col("text")).alias("words"))
    one = texts.join(sized(places), "row_key")
    first = F.greatest(F.lit(0), F.least(F.col("start"), F.size("words") - F.col("length")))
    cut = one.select("row_key", "doc_id", first.alias("start"), "length", F.slice("words", first + 1, F.col("length")).alias("window")).distinct()
    near = cut.join(pairs, ["row_key", "length"]).join(_small(bench, total), ["variant", "length"])

    k = F.least("length", F.lit(shingle))
    grams = lambda c: F.coalesce(*[F.when(k == n, shingle_hashes(F.col(c), n)) for n in sizes or [shingle]])
    both = near.select("row_key", "doc_id", "item_id", "start", "length", "window", "item_fp", grams("window").alias("a"), grams("words").alias("b"))
    scored = both.select("*", (common_weight(F.col("a"), F.col("b")) / F.size("b")).alias("similarity")).filter(F.col("similarity") >= similarity)
    apart = F.bit_count(word_simhash(F.col("window")).bitwiseXOR(F.col("item_fp")))
    scored = scored.select("row_key", "doc_id", "item_id", "start", "length", apart.alias("hamming"), "similarity")
    best = scored.distinct().groupBy("row_key", "doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("hamming")).alias("near"), "length")).alias("best"),
        F.countDistinct("start", "length").alias("n_windows"),
    )
    return best.select(
        "row_key", "doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.length").cast("long").alias("length"),
        "n_windows", (-F.col("best.near")).cast("long").alias("hamming"), F.round("best.similarity", 6).alias("similarity"),
    )


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The leaks, by doc_id and item_id."""
    return leaks(docs, items).drop("row_key")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones.

    Rows without an id or with null or empty text, and repeated rows, are judged
    each by its own text; with an empty benchmark all stay.  Other columns are
    carried along whatever their names.
    """
    return without(docs, leaks(docs, items))
