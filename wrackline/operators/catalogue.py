"""The catalogue of a file system, from decoded records and index entries.

Rows keep where they were found, as ``ord`` (pass, position, entry), so that
first-wins and last-wins rules are windows over data and not over the order in
which tasks happen to run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrackline.operators.ntfs import in_use, is_directory

MIN_SIZE = 1024
MAX_FILE = 1 << 30
ROOT = "."


def _order(step: int, fpos: str = "fpos", idx: Column | None = None) -> Column:
    return F.struct(F.lit(step).alias("pass"), F.col(fpos).alias("fpos"), (F.lit(0) if idx is None else idx).alias("idx"))


def entries(records: DataFrame, index: DataFrame) -> DataFrame:
    """Files of both passes: size, name, mtime, ref, parent, origin, fpos, ord; the same file usually twice."""
    a = records.filter(in_use(F.col("flags")) & ~is_directory(F.col("flags")) & F.col("name").isNotNull() & F.col("size").isNotNull())
    a = a.select("size", "name", "mtime", "ref", "parent", F.lit("MFT").alias("origin"), "fpos", _order(1).alias("ord"))
    b = index.filter("NOT is_dir").select("size", "name", "mtime", "ref", "parent", F.lit("INDX").alias("origin"), "fpos", _order(2, idx=F.col("idx")).alias("ord"))
    return a.unionByName(b)


def first_wins(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Per key the row found first, as an aggregate with map-side combining."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*rows.columns)


def last_wins(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Per key the row found last."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*rows.columns)


def directories(records: DataFrame, index: DataFrame) -> DataFrame:
    """ref, name, parent, origin: the last record of a directory, else its first index entry."""
    a = records.filter(in_use(F.col("flags")) & is_directory(F.col("flags")) & F.col("name").isNotNull())
    a = last_wins(a.select("ref", "name", "parent", _order(1).alias("ord")), "ref")
    b = first_wins(index.filter("is_dir").select("ref", "name", "parent", _order(2, idx=F.col("idx")).alias("ord")), "ref")
    both = a.select("ref", F.struct("name", "parent").alias("m")).join(b.select("ref", F.struct("name", "parent").alias("i")), "ref", "full_outer")
    taken = F.coalesce("m", "i")
    return both.select("ref", taken["name"].alias("name"), taken["parent"].alias("parent"), F.when(F.col("m").isNotNull(), "MFT").otherwise("INDX").alias("origin"))


def directory_conflicts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Index entries of directories that are already known under another name or parent.

    Known is the last record in use, else the first index entry.
    """
    a = directories(records, index).select("ref", F.col("name").alias("known_name"), F.col("parent").alias("known_parent"), F.col("origin").alias("known_from"))
    b = index.filter("is_dir").select("ref", F.col("name").alias("index_name"), F.col("parent").alias("index_parent"))
    return a.join(b, "ref").filter((F.col("known_name") != F.col("index_name")) | (F.col("known_parent") != F.col("index_parent"))).distinct()


def index_offsets(records: DataFrame, index: DataFrame) -> DataFrame:
    """ref, record_at, index_at, delta: where the index of a directory in use should lie and where it was found first."""
    own = records.filter(in_use(F.col("flags")) & F.col("index_at").isNotNull())
    a = last_wins(own.select("ref", F.col("index_at").alias("record_at"), _order(1).alias("ord")), "ref").drop("ord")
    b = first_wins(index.select(F.col("parent").alias("ref"), F.col("fpos").alias("index_at"), _order(2, idx=F.col("idx")).alias("ord")), "ref").drop("ord")
    return a.join(b, "ref").withColumn("delta", F.col("index_at") - F.col("record_at"))


def by_size(rows: DataFrame) -> DataFrame:
    """Catalogue grouped by size, each group in the order of finding."""
    return rows.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "mtime", "ref", "parent"))).alias("files"), F.count(F.lit(1)).alias("n"))


def listing(rows: DataFrame, least: int = MIN_SIZE) -> DataFrame:
    """Entries worth a name, by size and order of finding."""
    return rows.filter(F.col("size") >= least).orderBy("size", "ord")


def recoverable(records: DataFrame) -> DataFrame:
    """Plain files whose runs are whole: in use, named, not compressed, not empty, of less than 1 GiB on disk."""
    clusters = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["len"])
    keep = (F.col("flags") == 1) & F.col("name").isNotNull() & (F.col("compression") == 0) & (F.col("size") > 0) & (clusters * 4096 < MAX_FILE)
    whole = (clusters * 4096 == F.col("allocated")) & F.col("run_error").isNull()
    return last_wins(records.filter(keep & whole).select("ref", "name", "parent", "size", "mtime", "runs", _order(1).alias("ord")), "ref").drop("ord")


def paths(dirs: DataFrame, max_depth: int = 1024) -> DataFrame:
    """ref, path, depth, orphan of every directory, by doubling pointers.

    Each round joins every unfinished directory to the ancestor it points to
    and takes over that one's path, so depth d takes log2(d) rounds.  A
    directory that is its own parent is the root ``.``; a missing parent is
    named ``dir__<ref>``; a directory whose chain comes back to itself, or is
    deeper than ``max_depth``, ends at ``dir__<ref>`` of the place reached.
    """
    nodes = dirs.select("ref", "name", "parent").dropDuplicates(["ref"])
    known = nodes.select(F.col("ref").alias("p_ref"), F.lit(True).alias("found"))
    start = nodes.join(known, nodes["parent"] == known["p_ref"], "left")
    own = F.col("ref") == F.col("parent")
    lost = F.col("found").isNull() & ~F.coalesce(own, F.lit(False))
    label = F.concat(F.lit("dir__"), F.coalesce(F.col("parent").cast("string"), F.lit("null")))
    state = start.select(
        "ref",
        F.when(own, F.lit(ROOT)).when(lost, F.concat(label, F.lit("/"), "name")).otherwise(F.col("name")).alias("path"),
        F.when(own, 0).otherwise(1).alias("depth"),
        F.when(own | lost, F.lit(None)).otherwise(F.col("parent")).alias("up"),
        lost.alias("orphan"),
    )
    rounds = max(1, (max_depth - 1).bit_length())
    for _ in range(rounds):
        state = _cut(state)
        if state.filter("up IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("ref").alias("up"), F.col("path").alias("a_path"), F.col("depth").alias("a_depth"), F.col("up").alias("a_up"), F.col("orphan").alias("a_orphan"))
        joined = state.join(above, "up", "left")
        moved = F.col("up").isNotNull()
        long_enough = F.col("depth") + F.col("a_depth") <= max_depth
        state = joined.select(
            "ref",
            F.when(moved & long_enough, F.concat("a_path", F.lit("/"), "path")).otherwise(F.col("path")).alias("path"),
            F.when(moved & long_enough, F.col("depth") + F.col("a_depth")).otherwise(F.col("depth")).alias("depth"),
            F.when(moved & long_enough, F.col("a_up")).otherwise(F.col("up")).alias("up"),
            F.when(moved & long_enough, F.col("a_orphan")).otherwise(F.col("orphan")).alias("orphan"),
        )
    endless = F.col("up").isNotNull()
    path = F.when(endless, F.concat(F.lit("dir__"), F.col("up").cast("string"), F.lit("/"), "path")).otherwise(F.col("path"))
    return state.select("ref", path.alias("path"), "depth", (F.col("orphan") | endless).alias("orphan"))


def shared_folder(spark) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    One of our own is taken only where that is unset and both are one machine.
    """
    context = spark.sparkContext._jsc.sc()
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not context.getCheckpointDir().isDefined():
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wrackline-checkpoint-"))
    return context.getCheckpointDir().get()


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_paths(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entries with the path of their directory; an unknown one is ``dir__<ref>`` and flagged."""
    known = resolved.select(F.col("ref").alias("d_ref"), F.col("path").alias("dir"), F.col("orphan").alias("dir_orphan"))
    joined = rows.join(known, rows["parent"] == known["d_ref"], "left").drop("d_ref")
    missing = F.col("dir").isNull()
    return joined.withColumn("orphan", F.coalesce("dir_orphan", F.lit(False)) | missing).withColumn("dir", F.coalesce("dir", F.concat(F.lit("dir__"), F.coalesce(F.col("parent").cast("string"), F.lit("null"))))).drop("dir_orphan").withColumn("path", F.concat("dir", F.lit("/"), "name"))


def child_lists(records: DataFrame) -> DataFrame:
    """ref, children, n: records under each record that exists, by self-join on the parent."""
    own = records.select("ref").distinct()
    kids = records.filter((F.col("parent") > 0) & (F.col("parent") != F.col("ref"))).select(F.col("ref").alias("child"), F.col("parent").alias("ref"))
    return kids.join(own, "ref", "left_semi").groupBy("ref").agg(F.array_sort(F.collect_set("child")).alias("children"), F.countDistinct("child").alias("n"))


def with_extensions(records: DataFrame) -> DataFrame:
    """Base records without runs of their own get those of the records their attribute list names.

    Runs come in the order of the first cluster they stand for; sizes and
    units are the largest found.
    """
    base = records.select("*", F.posexplode_outer(F.when(F.size("runs") == 0, F.col("children"))).alias("child_at", "child"))
    parts = last_wins(records.select("ref", "runs", "size", "compression", F.coalesce("first_vcn", F.lit(0)).alias("first_vcn"), _order(1).alias("ord")), "ref")
    parts = parts.filter(F.size("runs") > 0).select(F.col("ref").alias("child"), F.col("runs").alias("c_runs"), F.col("size").alias("c_size"), F.col("compression").alias("c_comp"), F.col("first_vcn").alias("c_vcn"))
    joined = base.join(parts, "child", "left").filter("child IS NULL OR child <> ref")
    gathered = joined.groupBy("image", "fpos", "ref").agg(
        F.array_sort(F.collect_list(F.when(F.col("c_runs").isNotNull(), F.struct("c_vcn", "child_at", "c_runs")))).alias("parts"), F.max("c_size").alias("c_size"), F.max("c_comp").alias("c_comp")
    )
    out = records.join(gathered, ["image", "fpos", "ref"], "left")
    use = F.size(F.coalesce("parts", F.array())) > 0
    runs = F.flatten(F.transform("parts", lambda p: p["c_runs"]))
    return out.withColumn("runs", F.when(use, runs).otherwise(F.col("runs"))).withColumn("size", F.greatest("size", "c_size")).withColumn("compression", F.greatest("compression", F.coalesce("c_comp", F.lit(0)))).drop("parts", "c_size", "c_comp")


def lcn_from_deltas(runs: DataFrame) -> DataFrame:
    """ref, idx, lcn, vcn from run deltas (ref, idx, delta, len), as running sums."""
    before = Window.partitionBy("ref").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("ref").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return runs.select("ref", "idx", F.sum("delta").over(upto).alias("lcn"), F.coalesce(F.sum("len").over(before), F.lit(0)).alias("vcn"), "len")


def name_score(name: Column) -> Column:
    """How far a name looks like one that people gave: below zero for temporary and short forms."""
    letters = F.regexp_replace(name, "[^A-Za-z]", "")
    return (
        F.when(name.rlike("[^\\x00-\\x7f]"), 10)
        .when(name.rlike("~[0-9]"), -10)
        .when(F.contains(name, F.lit("~")), -5)
        .when((letters != "") & (letters == F.upper(letters)), -3)
        .otherwise(0)
    )
