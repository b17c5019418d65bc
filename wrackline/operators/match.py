"""Names for recovered files: the catalogue entry of equal size and extension with the nearest time.

The nearest entry is found with windows over a group's times, not by pairing
all files of a size with all its entries, so the work stays linear where one
size is very common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrackline.operators.catalogue import _cut


def extension(name: Column, catalogue: bool = False) -> Column:
    """Lower-case text after the last dot; a catalogue's ``pps`` counts as ``ppt``."""
    ext = F.lower(F.substring_index(name, ".", -1))
    return F.when(ext == "pps", "ppt").otherwise(ext) if catalogue else ext


def _missing(targets: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Targets that are not there yet."""
    return targets if existing is None else targets.join(existing.select(F.col("path").alias("target")).distinct(), "target", "left_anti")


def candidates(named: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """size, target, mtime, ord, ext of entries (with paths) that a file may be given."""
    rows = named.select("size", F.col("path").alias("target"), "mtime", "ord", "name", extension(F.col("name"), True).alias("ext"))
    return _missing(rows.filter(~F.col("name").startswith("~")), existing)


#: Distinct times of one size and extension up to which they are one window.
WINDOW_TIMES = 1_000_000


def _neighbours(times: DataFrame, *by: str) -> DataFrame:
    """``times`` (size, ext, mtime, e) with the entries at or before and at or after each time, among rows of equal ``by``."""
    found = F.when(F.col("e").isNotNull(), F.struct("mtime", "e"))
    near = times
    for name, order in (("before", F.col("mtime").asc()), ("after", F.col("mtime").desc())):
        span = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        near = near.withColumn(name, F.last(found, ignorenulls=True).over(span))
    return near


def _neighbours_in_parts(times: DataFrame, groups: DataFrame, each: int) -> DataFrame:
    """The same for groups (size, ext, n, low, high) of very many times, cut into ranges that carry their ends over."""
    key = ["size", "ext", "part"]
    share = (F.col("mtime") - F.col("low")) / (F.col("high") - F.col("low") + 1)
    cut = times.join(F.broadcast(groups), ["size", "ext"]).withColumn("part", F.floor(share * F.ceil(F.col("n") / each)))
    cut = _cut(cut.select(*key, "mtime", "e"))
    found = F.when(F.col("e").isNotNull(), F.struct("mtime", "e"))
    ends = cut.groupBy(*key).agg(F.max_by(found, F.when(F.col("e").isNotNull(), F.col("mtime"))).alias("last"), F.min_by(found, F.when(F.col("e").isNotNull(), F.col("mtime"))).alias("first"))
    parts = Window.partitionBy("size", "ext").orderBy("part")
    ends = ends.select(
        *key,
        F.last("last", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    near = _neighbours(cut, *key).join(ends, key)
    return near.select("size", "ext", "mtime", "e", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))


def match_nearest(files: DataFrame, named: DataFrame, existing: DataFrame | None = None, window_times: int = WINDOW_TIMES) -> DataFrame:
    """path, status, best, dist, n_names, n_absent, n_total, conflict of each file.

    ``files`` has path, size, mtime, ext; ``named`` has size, name, path,
    mtime, ord.  UNKNOWN: no entry of that size; BAD: none that fits; OK: the
    fitting one with the nearest time, of equal ones the first by ``ord``.
    ``conflict`` marks a name that more files than one would get.

    Files and entries of one size, extension and time count as one row while
    neighbours are looked for; a size and extension with over ``window_times``
    times is cut into ranges of time.
    """
    fit = candidates(named, existing)
    counts = named.select("size", F.lit(1).alias("t"), F.lit(0).alias("a")).unionAll(fit.select("size", F.lit(0), F.lit(1)))
    counts = counts.groupBy("size").agg(F.sum("t").alias("n_total"), F.sum("a").alias("n_absent"))
    names = fit.groupBy("size", "ext").agg(F.countDistinct("target").alias("n_names"))
    spots = fit.select("size", "ext", "mtime", F.struct("target", "ord").alias("e"))
    asked = files.select("size", "ext", "mtime", F.lit(None).cast(spots.schema["e"].dataType).alias("e"))
    # An asked time has no entry and no order, which min_by passes over.
    times = _cut(spots.unionByName(asked).groupBy("size", "ext", "mtime").agg(F.min_by("e", F.col("e")["ord"]).alias("e")))

    groups = times.groupBy("size", "ext").agg(F.count(F.lit(1)).alias("n"), F.min("mtime").alias("low"), F.max("mtime").alias("high")).filter(F.col("n") > window_times)
    groups = _cut(groups)  # few: each stands for as many rows
    if groups.isEmpty():
        near = _neighbours(times, "size", "ext")
    else:
        few = times.join(F.broadcast(groups.select("size", "ext")), ["size", "ext"], "left_anti")
        near = _neighbours(few, "size", "ext").unionByName(_neighbours_in_parts(times, groups, window_times))

    def option(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["mtime"] - F.col("mtime")).alias("dist"), F.col(c)["e"]["ord"].alias("ord"), F.col(c)["e"]["target"].alias("target")))

    best = near.select(F.col("size").alias("b_size"), F.col("ext").alias("b_ext"), F.col("mtime").alias("b_mtime"), F.array_min(F.filter(F.array(option("before"), option("after")), lambda x: x.isNotNull())).alias("b"))
    same = F.col("size").eqNullSafe(F.col("b_size")) & F.col("ext").eqNullSafe(F.col("b_ext")) & F.col("mtime").eqNullSafe(F.col("b_mtime"))
    out = files.select("path", "size", "ext", "mtime").join(best, same, "left").drop("b_size", "b_ext", "b_mtime").join(counts, "size", "left").join(names, ["size", "ext"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    known = F.coalesce("n_total", F.lit(0)) > 0
    out = out.select("path", F.when(~known, "UNKNOWN").when(F.col("b").isNull(), "BAD").otherwise("OK").alias("status"), F.col("b")["target"].alias("best"), F.col("b")["dist"].alias("dist"), zero("n_names").alias("n_names"), zero("n_absent").alias("n_absent"), zero("n_total").alias("n_total"))
    claims = out.filter("best IS NOT NULL").groupBy("best").agg(F.count(F.lit(1)).alias("claims"))
    return out.join(claims, "best", "left").select("path", "status", "best", "dist", "n_names", "n_absent", "n_total", (F.coalesce("claims", F.lit(0)) > 1).alias("conflict"))


def match_greedy(files: DataFrame, named: DataFrame, existing: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """path, pos, best, dist, where each name goes to one file only.

    ``files`` also has ``pos``.  The result is that of taking files in order of
    ``pos``, each getting the nearest free name.  It is computed in rounds:
    every file asks for its nearest name left, the one with the least ``pos``
    holds it, the others lose that name from their lists, until none does.
    """
    fit = candidates(named, existing).groupBy("size", "ext", "target").agg(F.collect_set(F.struct("mtime", "ord")).alias("times"))
    pairs = files.select("path", "pos", "size", "ext", F.col("mtime").alias("at")).join(fit, ["size", "ext"])
    score = F.array_min(F.transform("times", lambda t: F.struct(F.abs(t["mtime"] - F.col("at")).alias("dist"), t["ord"].alias("ord"))))
    alive = _cut(pairs.select("path", "pos", "target", score.alias("score")))
    for _ in range(max_rounds):
        asked = alive.groupBy("path", "pos").agg(F.min(F.struct("score", "target")).alias("a")).select("path", "pos", F.col("a")["target"].alias("target"), F.col("a")["score"]["dist"].alias("dist"))
        holders = asked.groupBy("target").agg(F.min("pos").alias("holder"))
        refused = _cut(asked.join(holders, "target").filter("pos > holder").select("path", "pos", "target"))
        if refused.isEmpty():
            return asked.select("path", "pos", F.col("target").alias("best"), "dist")
        alive = _cut(alive.join(refused, ["path", "pos", "target"], "left_anti"))
    raise RuntimeError(f"names were not settled in {max_rounds} rounds")


# ---- plans; nothing here is carried out -------------------------------------------------------


def rename_plan(matches: DataFrame) -> DataFrame:
    """action, source, target of every match."""
    return matches.filter("best IS NOT NULL").select(F.lit("rename").alias("action"), F.col("path").alias("source"), F.col("best").alias("target"))


def time_plan(named: DataFrame, existing: DataFrame) -> DataFrame:
    """action, path, mtime for files that are there under a catalogue name; the first entry of a path decides."""
    rows = named.filter(~F.col("orphan")).groupBy("path").agg(F.min_by("mtime", "ord").alias("mtime"))
    return rows.join(existing.select("path").distinct(), "path", "left_semi").select(F.lit("set_mtime").alias("action"), "path", "mtime")


def file_facts(recovered: DataFrame) -> DataFrame:
    """path, size, mtime, ext of recovered files, with the time that office documents carry inside.

    Only files that start like an archive or a compound file are looked into.
    """
    ext = extension(F.element_at(F.split("path", "/"), -1))
    return recovered.select("path", "size", F.coalesce(_inside(F.col("content")), F.col("mtime")).alias("mtime"), ext.alias("ext"))


def _inside(content: Column) -> Column:
    """The time that an office document carries."""
    from wrackline.functions.dates import document_time

    @F.pandas_udf("bigint")
    def inside(content):
        import pandas as pd

        return pd.Series([document_time(c) if c is not None else None for c in content], dtype="Int64")

    # A filter on the time must not ask for it a second time.
    return inside.asNondeterministic()(F.when(F.hex(F.substring(content, 1, 4)).isin("504B0304", "D0CF11E0"), content))


def document_time_plan(recovered: DataFrame) -> DataFrame:
    """action, path, mtime for archives of office documents, from the dates that they carry."""
    zips = recovered.filter(F.hex(F.substring("content", 1, 4)) == "504B0304")
    own = zips.select("path", "mtime", _inside(F.col("content")).alias("own")).filter("own <> mtime")
    return own.select(F.lit("set_mtime").alias("action"), "path", F.col("own").alias("mtime"))
