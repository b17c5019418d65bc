"""Near copies: documents whose shingle sets are alike, found by SimHash and decided on the whole sets.

Copies are taken from the Gray index over SimHashes first.  A SimHash tells a
similarity by chance only, so links that it doesn't show are found by the rare
shingles that sets have in common, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.llm.common import checkpointed, keep_one, row_key, small_batches
from wrackline.llm.components import components
from wrackline.llm.grayindex import Sets
from wrackline.llm.simhash import _STEP, SEED, _named, fingerprint_links, majority
from wrackline.llm.wordhash import grams, words

COPY_SHINGLE = 5
COPY_SIMILARITY = 0.8
#: Words of a shingle of the SimHash, and bits in which those of candidates differ at most.  Any choice gives the same
#: links; an edit of one word changes two shingles of two words and five of five.
FP_SHINGLE, FP_RADIUS = 2, 6
#: Sets of a group that are compared in one tile.
GROUP_DOCS = 128
#: Bits of a shingle's hash that are kept.  Two unlike shingles of a pair of documents with 1,000 words each coincide
#: once in 10**8 pairs, and shuffles are a sixth smaller than with all bits.
GRAM_BITS = 48
DF_MOST = (1 << 63 - GRAM_BITS) - 1
#: A shingle is common if batches of BATCH_TEXTS texts that have it HOT_IN_BATCH times and more have it HOT_ROWS times
#: together; at most HOT_MOST such are kept apart.  Any choice gives the same links.
BATCH_TEXTS, HOT_IN_BATCH, HOT_ROWS, HOT_MOST = 2_000, 8, 5_000, 500_000
_FLUSH = 200_000
_COLUMNS = 1 << 12


def copy_shingles(text: str | None, h: np.ndarray | None = None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles, fewer words being one shingle, as is a text without words.

    ``h`` has the hashes of the text's words where they are known.
    """
    h = words(text)[0] if h is None else h
    if len(h):
        return np.unique(grams(h, min(COPY_SHINGLE, len(h))) >> np.uint64(64 - GRAM_BITS))
    import xxhash

    return np.array([xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), SEED) >> 64 - GRAM_BITS], np.uint64)


def copy_fingerprint(h: np.ndarray) -> int:
    """SimHash of the distinct shingles of FP_SHINGLE words, from the words' hashes; 0 without words."""
    g = np.unique(grams(h, min(FP_SHINGLE, len(h)))) if len(h) else h
    return majority(g[at : at + _STEP] for at in range(0, len(g), _STEP))


def copy_node(shingles: np.ndarray) -> int:
    """Name of a set of shingles, of 63 bits."""
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) >> 1


def _shingle_rows(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """deal and other of every shingle of the texts in the only column.

    They are shingle and node, and for common shingles -1 - node and shingle,
    so that rows dealt by the first never gather where a shingle is common.
    """
    deal: list[np.ndarray] = []
    other: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(deal)), pa.array(np.concatenate(other))], names=["deal", "other"])

    for b in batches:
        for t in b.column(0):
            g = copy_shingles(t.as_py())
            node = copy_node(g)
            g = g.view(np.int64)
            common = np.isin(g, hot, assume_unique=True) if len(hot) else np.zeros(len(g), bool)
            deal.append(np.where(common, -1 - node, g))
            other.append(np.where(common, g, node))
            held += len(g)
            if held >= _FLUSH:
                yield flush()
                deal, other, held = [], [], 0
    if held:
        yield flush()


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and key of the shingles that are common or that two or more nodes have; rows come sorted by deal and other.

    A key is the number of nodes, the same for all common shingles, before the
    shingle's bits, so keys in order are shingles from the rarest on.
    """

    def batch(node: np.ndarray, df: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(df << GRAM_BITS | gram)], names=["node", "key"])

    def work(gram: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])))
        gram, node = gram[new], node[new]
        at = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        size = np.diff(np.append(at, len(gram)))
        df = np.repeat(size, size)
        many = df > 1
        if many.any():
            yield batch(node[many], np.minimum(df[many], DF_MOST - 1), gram[many])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        deal, other = b.column(0).to_numpy(), b.column(1).to_numpy()
        common = int(np.searchsorted(deal, 0))
        if common:
            yield batch(-1 - deal[:common], np.full(common, DF_MOST), other[:common])
        deal, other = deal[common:], other[common:]
        if not len(deal):
            continue
        held.append((deal, other))
        if deal[-1] == held[0][0][0]:
            continue
        gram, node = (np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(gram, gram[-1]))
        yield from work(gram[:last], node[:last])
        held = [(gram[last:], node[last:])]
    if held:
        yield from work(*(np.concatenate(x) for x in zip(*held)))


def set_links(node: np.ndarray, size: np.ndarray, own: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, least node) of the sets that links of a Jaccard similarity of at least ``similarity`` connect.

    ``own`` has the elements of each set that others may share, ``size`` the
    number of all its elements.
    """
    row = np.repeat(np.arange(len(node)), [len(x) for x in own])
    _, column, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    both = count[column] > 1
    row, column = row[both], column[both]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    common = np.zeros((len(node), len(node)), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
        here, place = np.unique(row[a:b], return_inverse=True)
        hit = np.zeros((len(here), min(_COLUMNS, int(column[b - 1]) - lo + 1)), np.float32)
        hit[place, column[a:b] - lo] = 1
        common[np.ix_(here, here)] += (hit @ hit.T).astype(np.int64)
    u, v = np.nonzero(np.triu(common * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-9, 1))
    sets = Sets(len(node))
    sets.merge(u, v)
    root = sets.roots(np.arange(len(node)))
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, root, node)
    linked = node != least[root]
    return node[linked], least[root][linked]


def _alike(common: Column, n: Column, m: Column, similarity: float) -> Column:
    return common * (1 + similarity) >= similarity * (n + m) - 1e-9


def _checked(edges: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The rows u, v of ``edges`` whose sets in ``own`` (node, n, grams) are alike."""
    side = lambda k: own.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("grams").alias(f"grams_{k}"))
    both = edges.join(side("u"), "u").join(side("v"), "v")
    return both.filter(_alike(F.size(F.array_intersect("grams_u", "grams_v")), F.col("n_u"), F.col("n_v"), similarity)).select("u", "v")


def _fingerprint_pairs(own: DataFrame) -> DataFrame:
    """u, v: every set of ``own`` (node, fp) with the least of those that SimHash links within FP_RADIUS connect to it under a key."""
    # Written first, so that the join has an exchange on either side and a common fingerprint's rows can be split.
    least = checkpointed(own.groupBy("fp").agg(F.min("node").alias("v")))
    equal = own.select("node", "fp").join(least, "fp").select(F.col("node").alias("u"), "v").filter("u <> v")
    return equal.unionByName(fingerprint_links(least.select("fp", F.col("v").alias("node")), FP_RADIUS)).distinct()


def _open_lists(keys: DataFrame) -> DataFrame:
    """gram, v, of: the least node and its cluster of every list of ``keys`` (node, cluster, gram) that has two clusters or more."""
    least = (F.min("node").alias("v"), F.min_by("cluster", "node").alias("of"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    # Written first, so that joins have an exchange on either side and a common shingle's rows can be split.
    return checkpointed(keys.groupBy("gram").agg(*least).filter("low <> high").select("gram", "v", "of"))


def _with_roots(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``nodes`` (node, ...) with the least node of the component that ``links`` put it in."""
    found = components(links).select(F.col("node").alias("at"), F.col("root").alias(name))
    return nodes.join(found, nodes["node"] == found["at"], "left").withColumn(name, F.coalesce(name, "node")).drop("at")


def _tiles(open_nodes: DataFrame) -> DataFrame:
    """root, node, a, b: the tiles (a, b) of its group that a node (root, node, cluster) is compared in.

    A group of up to GROUP_DOCS nodes is one tile.  In a larger one the nodes
    of its largest cluster and the others are dealt into parts of that size;
    any two parts meet but two of the largest cluster.
    """
    sizes = checkpointed(open_nodes.groupBy("root", "cluster").agg(F.count(F.lit(1)).alias("n")))
    groups = sizes.groupBy("root").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    groups = checkpointed(groups)
    dealt = open_nodes.join(groups, "root").withColumn("hash", F.xxhash64("node"))
    main = F.col("cluster") == F.col("main")
    first, rest = (F.ceil(c / GROUP_DOCS).cast("int") for c in (F.col("n_main"), F.col("n") - F.col("n_main")))
    dealt = dealt.select("root", "node", (F.col("n") <= GROUP_DOCS).alias("whole"), main.alias("main"), first.alias("first"), rest.alias("rest"), "hash")
    mine = F.when(F.col("whole"), 0).when(F.col("main"), F.pmod("hash", "first")).otherwise(F.col("first") + F.pmod("hash", "rest")).cast("int")
    all_parts, others = (F.sequence(x, F.col("first") + F.col("rest") - 1) for x in (F.lit(0), F.col("first")))
    met = F.when(F.col("whole"), F.array(F.lit(0))).when(F.col("main"), others).otherwise(all_parts)
    rows = dealt.withColumn("mine", mine).withColumn("other", F.explode(met)).filter("whole OR mine <> other")
    return rows.select("root", "node", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))


def copy_links(texts: DataFrame, sizes: DataFrame, common: np.ndarray, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """Links u, v that connect all nodes whose shingle sets have a Jaccard similarity of at least ``similarity``.

    ``texts`` has the text alone, ``sizes`` node, n and fp of each shingle set,
    ``common`` shingles (sorted) that are too frequent to be counted in one
    place; they count as the most frequent ones.  No step loses a pair.

    * A set of n links only if ``similarity`` * n of its shingles stand in other
      sets; the rest of the sets fall away.
    * Sets whose SimHashes the Gray index joins within FP_RADIUS bits are compared,
      each with the least one.  What links makes clusters.
    * Links that SimHash doesn't show are found exactly.  Sets that link have one
      shingle in common among the n - ceil(similarity * n) + 1 rarest of each
      (prefix filter).  Each such shingle has a list of sets; lists that lie in one
      cluster are done.
    * Every set of another list is compared with the least one unless they are of
      one cluster already, so a group of copies costs its size and not its square.
    * Of the lists that are open still, those that hang together make a group, in
      which sets of different clusters are compared, by one task up to GROUP_DOCS
      sets and else in parts of that size.
    """
    sent = texts.sparkSession.sparkContext.broadcast(common)
    rows = texts.mapInArrow(lambda it: _shingle_rows(it, sent.value), "deal long, other long").repartition("deal").sortWithinPartitions("deal", "other")
    shared = rows.mapInArrow(_shared_rows, "node long, key long")
    own = shared.groupBy("node").agg(F.collect_set("key").alias("own"))
    need = F.ceil(F.lit(similarity) * F.col("n") - 1e-9)
    own = own.join(sizes, "node").filter(F.size("own") >= need)
    # Shingles of no other set are the rarest and take the first places.
    places = (F.size("own") - need + 1).cast("int")
    bare = F.transform(F.sort_array("own"), lambda k: k.bitwiseAND(F.lit((1 << GRAM_BITS) - 1)))
    own = checkpointed(own.select("node", "n", "fp", bare.alias("grams"), places.alias("places")))

    linked = checkpointed(_checked(_fingerprint_pairs(own), own, similarity))
    heads = _with_roots(own.select("node", F.slice("grams", F.lit(1), F.col("places")).alias("head")), linked, "cluster")
    keys = checkpointed(heads.select("node", "cluster", F.explode("head").alias("gram")))

    rest = checkpointed(keys.join(_open_lists(keys), "gram"))
    stars = rest.filter("cluster <> of").select(F.col("node").alias("u"), "v").distinct()
    linked = checkpointed(linked.unionByName(_checked(stars, own, similarity)))
    keys = checkpointed(_with_roots(rest.select("node", "gram"), linked, "cluster"))
    still_open = checkpointed(keys.join(_open_lists(keys), "gram"))
    groups = still_open.select(F.col("node").alias("u"), "v").filter("u <> v").distinct()
    nodes = checkpointed(_with_roots(still_open.select("node", "cluster").distinct(), groups, "root"))
    sets = own.select("node", "n", "grams").join(_tiles(nodes), "node").select("root", "a", "b", "node", "n", "grams")
    sets = sets.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(part: list[tuple]) -> pa.RecordBatch:
            node, size = (np.array([r[i] for r in part], np.int64) for i in (0, 1))
            u, v = set_links(node, size, [r[2] for r in part], similarity)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        key, part = None, []
        for b in batches:
            which = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            for i, (k, node, n) in enumerate(zip(which, b.column(3).to_pylist(), b.column(4).to_pylist())):
                if k != key and part:
                    yield work(part)
                    part = []
                key = k
                part.append((node, n, b.column(5)[i].values.to_numpy()))
        if part:
            yield work(part)

    return linked.unionByName(sets.mapInArrow(run, "u long, v long"))


def near_copies(docs: DataFrame, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """doc_id, row_key, component_id and root, the component's own name, where links are near copies.

    Two documents link if the Jaccard similarity of their sets of five-word
    shingles is at least ``similarity``: by SimHash first, the rest found by
    shared shingles, and all decided on the sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, BATCH_TEXTS) for b in batches for at in range(0, b.num_rows, BATCH_TEXTS)):
            marks = []
            for t in b.column(2):
                h = words(t.as_py())[0]
                marks.append((copy_shingles(t.as_py(), h), copy_fingerprint(h)))
            sets, fp = [g for g, _ in marks], np.array([x for _, x in marks], np.uint64).view(np.int64)
            n = len(sets)
            gram, times = np.unique(np.concatenate(sets), return_counts=True) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = times >= HOT_IN_BATCH
            arrays = [*b.columns[:2], pa.array([copy_node(g) for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array(fp), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            k = int(often.sum())
            if k:
                arrays = [pa.nulls(k, b.column(0).type), pa.nulls(k, pa.int64()), pa.array(gram[often].view(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(times[often].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "row_key", "node", "n", "fp", "times"]
    text = F.col("text").cast("string").alias("text")
    marked = checkpointed(docs.select("doc_id", row_key(docs).alias("row_key"), text).mapInArrow(run, f"doc_id {kind}, row_key long, node long, n long, fp long, times long"))
    # A row with `times` is no document but a shingle that its batch had so often.
    often = marked.filter("times IS NOT NULL").groupBy("node").agg(F.sum("times").alias("times")).filter(F.col("times") >= HOT_ROWS)
    most = often.orderBy(F.desc("times"), "node").limit(HOT_MOST).select("node").toArrow()  # 8 bytes each
    common = np.sort(most.column(0).to_numpy().astype(np.int64))
    marked = marked.filter("times IS NULL").drop("times")
    fps = checkpointed(marked.groupBy("node", "n").agg(F.min("doc_id").alias("least_id"), F.min("fp").alias("fp")))
    return _named(marked.select("doc_id", "row_key", "node"), fps, copy_links(docs.select(text), fps.select("node", "n", "fp"), common))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, of the smallest doc_id.

    Null and empty texts are copies of one another, as are rows that repeat;
    texts without words are told apart by themselves.  A group without any id
    keeps one row; an empty table stays empty, and other columns are carried
    along whatever their names.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return keep_one(docs, near_copies(docs).withColumn("kept", kept), "root")
