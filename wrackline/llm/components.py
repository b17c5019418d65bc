"""Connected components of a link table, by one task or by alternating star contractions.

Up to ALONE links are joined by one task.  A round of contractions is six
exchanges, and each of their tasks leaves files, so over few links rounds cost
far more disk and time than the links are worth.

Of more links, every round does one large-star and one small-star step (Kiveris et al.,
"Connected Components in MapReduce and Beyond"), each an aggregate with partial
sums and a join, so no node's links are ever gathered in one list.  Links of a
node that very many share meet its least neighbour, one row, in a join that
Spark may split where adaptive execution handles skew.  Rounds grow with the
logarithm of the component size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.llm.common import checkpointed
from wrackline.llm.grayindex import Sets

#: Different links up to which one task joins them, 8 MB.  Any choice gives the same components.
ALONE = 500_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all links u, v, which come in one partition."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
    node, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    sets = Sets(len(node))
    sets.merge(place[: len(u)], place[len(u) :])
    # The least place of a set is its root, and places are in the order of nodes.
    root = node[sets.up]
    linked = node != root
    yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(root[linked])], names=["node", "root"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (u, v) but the roots themselves.

    ``root`` is the least node of the component.  Links of a node to itself
    are ignored; an empty table has no components.
    """
    stars = checkpointed(links.filter("u <> v").select("u", "v").distinct())
    if stars.count() <= ALONE:
        return stars.coalesce(1).mapInArrow(_joined, "node long, root long")
    seen = None
    for _ in range(max_rounds):
        stars = checkpointed(_small_star(_large_star(stars)))
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
