"""Records, catalogue, paths and matching, on the relational tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrackline.functions import ntfs
from wrackline.operators import catalogue, match
from wrackline.operators import ntfs as records
from wrackline.plans.common import day, registered, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registered(QUERIES, ORACLE_SQL)


@query("SELECT coalesce(n_chars, 0) AS size, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1")
def size_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue by size, documents for files."""
    rows = table(spark, sf_dir, "documents").select(F.coalesce("n_chars", F.lit(0)).alias("size"), F.col("doc_id").alias("ref"), F.lit("f").alias("name"), F.lit(0).alias("mtime"), F.lit(5).alias("parent"), F.struct("doc_id").alias("ord"))
    return catalogue.by_size(rows).select("size", "n", F.element_at("files", 1)["ref"].alias("first_id"), F.element_at("files", -1)["ref"].alias("last_id"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '.x' AS t, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS d FROM lineitem),
o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS d FROM orders),
j AS (SELECT o_orderkey, t, abs(l.d - o.d) AS dist, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(l.d - o.d), l_linenumber, l_partkey, l_suppkey) AS rn FROM o JOIN l ON l_orderkey = o_orderkey),
n AS (SELECT o_orderkey, count(*) AS n_total, count(DISTINCT t) AS n_names FROM j GROUP BY o_orderkey)
SELECT o.o_orderkey::VARCHAR AS path, CASE WHEN t IS NULL THEN 'UNKNOWN' ELSE 'OK' END AS status, coalesce(t, '') AS best, coalesce(dist, -1) AS dist, coalesce(n_names, 0) AS n_names, coalesce(n_total, 0) AS n_total
FROM o LEFT JOIN (SELECT * FROM j WHERE rn = 1) j ON j.o_orderkey = o.o_orderkey LEFT JOIN n ON n.o_orderkey = o.o_orderkey""")
def size_match_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching by size and nearest time: orders for recovered files, line items for entries."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("size"), day(F.col("o_orderdate")).alias("mtime"), F.lit("x").alias("ext"))
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]), F.lit(".x"))
    named = lines.select(F.col("l_orderkey").alias("size"), name.alias("name"), name.alias("path"), day(F.col("l_shipdate")).alias("mtime"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    return match.match_nearest(files, named).select("path", "status", F.coalesce("best", F.lit("")).alias("best"), F.coalesce("dist", F.lit(-1)).alias("dist"), "n_names", "n_total")


_EXT = "CASE s_nationkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'pps' ELSE 'household' END"


@query(f"""
WITH f AS (SELECT c_name AS path, c_custkey % 97 AS size, CASE WHEN c_nationkey % 4 = 0 THEN 'ppt' ELSE lower(c_mktsegment) END AS ext FROM customer),
e AS (SELECT s_suppkey % 61 AS size, CASE WHEN s_suppkey % 10 = 0 THEN '~' ELSE '' END || 's' || s_suppkey || '.' || {_EXT} AS name FROM supplier),
k AS (SELECT size, name, CASE WHEN name LIKE '%.pps' THEN 'ppt' ELSE split_part(name, '.', 2) END AS ext FROM e WHERE name NOT LIKE '~%'),
t AS (SELECT size, count(*) AS n_total FROM e GROUP BY size), a AS (SELECT size, count(*) AS n_absent FROM k GROUP BY size), n AS (SELECT size, ext, count(DISTINCT name) AS n_names FROM k GROUP BY size, ext)
SELECT path, CASE WHEN n_total IS NULL THEN 'UNKNOWN' WHEN n_names IS NULL THEN 'BAD' ELSE 'OK' END AS status, coalesce(n_names, 0) AS n_names, coalesce(n_absent, 0) AS n_absent, coalesce(n_total, 0) AS n_total
FROM f LEFT JOIN t USING (size) LEFT JOIN a USING (size) LEFT JOIN n USING (size, ext)""")
def match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and counts of each file: customers for files, suppliers for entries."""
    files = table(spark, sf_dir, "customer").selectExpr("c_name AS path", "c_custkey % 97 AS size", "cast(c_custkey AS bigint) AS mtime", "CASE WHEN c_nationkey % 4 = 0 THEN 'ppt' ELSE lower(c_mktsegment) END AS ext")
    named = table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 61 AS size", f"concat(CASE WHEN s_suppkey % 10 = 0 THEN '~' ELSE '' END, 's', s_suppkey, '.', {_EXT}) AS name", "s_suppkey AS mtime", "struct(s_suppkey) AS ord").withColumn("path", F.col("name"))
    return match.match_nearest(files, named).select("path", "status", "n_names", "n_absent", "n_total")


def _urgent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as entries, and those with an urgent order as files that are there."""
    named = table(spark, sf_dir, "customer").select(F.lit(1).alias("size"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("path"), F.col("c_custkey").alias("mtime"), F.lit(0).alias("ord"), F.lit(False).alias("orphan"))
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%'")
    return named, orders.select(F.col("o_custkey").cast("string").alias("path"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def anti_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are not there yet: customers without an urgent order."""
    return match.candidates(*_urgent(spark, sf_dir)).select(F.col("target").cast("bigint").alias("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def semi_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are there: customers with an urgent order."""
    return match.time_plan(*_urgent(spark, sf_dir)).select(F.col("mtime").alias("c_custkey"))


def _tree(spark: SparkSession, sf_dir: str, lost_nation: int | None = None) -> DataFrame:
    """Root, regions, nations and customers as directories."""
    region = table(spark, sf_dir, "region").selectExpr("1000000 + r_regionkey AS ref", "r_name AS name", "cast(0 AS bigint) AS parent")
    nation = table(spark, sf_dir, "nation").selectExpr("2000000 + n_nationkey AS ref", "n_name AS name", "cast(1000000 + n_regionkey AS bigint) AS parent")
    if lost_nation is not None:
        nation = nation.filter(F.col("ref") != 2000000 + lost_nation)
    customer = table(spark, sf_dir, "customer").selectExpr("10000000 + c_custkey AS ref", "c_name AS name", "cast(2000000 + c_nationkey AS bigint) AS parent")
    root = spark.range(1).selectExpr("id AS ref", "'root' AS name", "id AS parent")
    cast = lambda df: df.selectExpr("cast(ref AS bigint) AS ref", "name", "parent")
    return cast(root).unionByName(cast(region)).unionByName(cast(nation)).unionByName(cast(customer))


def _tree_sql(lost: str) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT 0 AS ref, 'root' AS name, 0 AS parent UNION ALL SELECT 1000000 + r_regionkey, r_name, 0 FROM region
 UNION ALL SELECT 2000000 + n_nationkey, n_name, 1000000 + n_regionkey FROM nation WHERE {lost} UNION ALL SELECT 10000000 + c_custkey, c_name, 2000000 + c_nationkey FROM customer),
p AS (SELECT ref, '.' AS path, 0 AS depth, false AS orphan FROM d WHERE ref = parent
 UNION ALL SELECT d.ref, 'dir__' || d.parent || '/' || d.name, 1, true FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.ref = d.parent)
 UNION ALL SELECT d.ref, p.path || '/' || d.name, p.depth + 1, p.orphan FROM d JOIN p ON d.parent = p.ref WHERE d.ref <> d.parent)
SELECT ref::BIGINT AS ref, path, depth, orphan FROM p"""


@query(_tree_sql("true"))
def path_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from parent pointers: regions, nations and customers for directories."""
    return catalogue.paths(_tree(spark, sf_dir))


@query(_tree_sql("n_nationkey <> 7"))
def orphan_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one nation missing."""
    return catalogue.paths(_tree(spark, sf_dir, 7))


@query("""
WITH d AS (SELECT 1000000 + r_regionkey AS ref, 0 AS parent FROM region UNION ALL SELECT 2000000 + n_nationkey, 1000000 + n_regionkey FROM nation UNION ALL SELECT 10000000 + c_custkey, 2000000 + c_nationkey FROM customer)
SELECT parent::BIGINT AS ref, count(*) AS n, min(ref)::BIGINT AS first_child FROM d WHERE parent > 0 GROUP BY parent""")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of every record."""
    return catalogue.child_lists(_tree(spark, sf_dir)).select("ref", "n", F.element_at("children", 1).alias("first_child"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each key: events by user."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("ord"))
    return catalogue.first_wins(rows, "user_id").drop("ord")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each key: events by user."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("ord"))
    return catalogue.last_wins(rows, "user_id").drop("ord")


@query("""
SELECT 'MFT' AS origin, event_id AS ref, user_id AS parent, event_type AS name FROM events WHERE event_id % 2 = 1 AND event_id % 4 <> 3
UNION ALL SELECT 'INDX', event_id, user_id, event_type FROM events WHERE event_id % 5 <> 0""")
def union_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of both passes: events as records (flags by id) and as index entries."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("ref"), F.col("user_id").alias("parent"), F.col("event_type").alias("name"), F.col("event_id").alias("fpos"), F.lit(1).alias("size"), F.lit(0).alias("mtime"))
    found = catalogue.entries(events.withColumn("flags", (F.col("ref") % 4).cast("int")), events.withColumn("is_dir", F.col("ref") % 5 == 0).withColumn("idx", F.lit(0)))
    return found.select("origin", "ref", "parent", "name")


def _made(rows: DataFrame, make, ddl: str) -> DataFrame:
    """What ``make`` gives for each row of a table, dealt out over tasks."""
    schema = records._arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                yield pa.RecordBatch.from_pylist([make(r) for r in b.slice(at, 1000).to_pylist()], schema=schema)

    return spread(rows).mapInArrow(run, ddl)


@query("SELECT c_custkey AS ref, c_name AS name, c_nationkey::BIGINT AS parent, c_custkey * 100 + 17 AS size, 1500000000 + c_custkey AS mtime, 2 AS n_runs, c_custkey + 25 AS clusters FROM customer")
def mft_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as file records, encoded and decoded."""

    def make(r: dict) -> dict:
        key = ntfs.name_key(r["c_nationkey"], 1_500_000_000 + r["c_custkey"], 0, r["c_name"])
        short = ntfs.name_key(r["c_nationkey"], 1_500_000_000 + r["c_custkey"], 0, "SHORT~1", 2)
        data = ntfs.nonresident(ntfs.DATA, [(5000 + r["c_custkey"], 24), (77, r["c_custkey"] + 1)], r["c_custkey"] * 100 + 17)
        return {"image": "i", "fpos": 1024 * r["c_custkey"], "data": ntfs.make_record(r["c_custkey"], [ntfs.resident(ntfs.NAME, short), ntfs.resident(ntfs.NAME, key), data])}

    blocks = _made(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), make, "image string, fpos bigint, data binary")
    return records.file_records(blocks).select("ref", "name", "parent", "size", "mtime", F.size("runs").alias("n_runs"), F.col("run_total").alias("clusters"))


@query("""
SELECT o_orderkey AS ref, 'order ' || o_orderkey || ' ' || o_orderpriority AS name, o_custkey AS parent, (o_orderkey * 3)::BIGINT AS size, o_orderstatus = 'F' AS is_dir FROM orders
UNION ALL SELECT o_orderkey, 'Ø' || o_orderkey, o_custkey, 0::BIGINT, false FROM orders""")
def indx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as index blocks of two entries, encoded and decoded."""

    def make(r: dict) -> dict:
        flags = ntfs.DIRECTORY_KEY if r["o_orderstatus"] == "F" else 0
        long = ntfs.name_key(r["o_custkey"], 0, r["o_orderkey"] * 3, f"order {r['o_orderkey']} {r['o_orderpriority']}", 1, flags)
        return {"image": "i", "fpos": 4096 * r["o_orderkey"], "data": ntfs.make_index([(r["o_orderkey"], long), (r["o_orderkey"], ntfs.name_key(r["o_custkey"], 0, 0, f"Ø{r['o_orderkey']}"))])}

    blocks = _made(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), make, "image string, fpos bigint, data binary")
    return records.index_rows(blocks).select("ref", "name", "parent", "size", "is_dir")


_LINES = "SELECT l_orderkey AS ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, l_partkey * 10 + l_linenumber AS lcn, l_quantity::BIGINT AS len FROM lineitem"


@query(f"""
WITH l AS ({_LINES}), q AS (SELECT *, lag(lcn) OVER (PARTITION BY ref ORDER BY idx) AS before, sum(len) OVER (PARTITION BY ref ORDER BY idx) - len AS vcn FROM l)
SELECT ref, idx::INT AS idx, vcn::BIGINT AS vcn, CASE WHEN lcn = before THEN 0 ELSE lcn END AS lcn, len, coalesce(lcn = before, false) AS sparse FROM q""")
def runlist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as runs, encoded as one list and decoded; equal neighbours read as sparse."""
    lines = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity").cast("bigint"))
    lines = lines.repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "n")
    lines = lines.select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("lcn"), "n")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An order's rows follow one another, at times over the end of a batch."""
        ref, runs = None, []
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([raw for _, raw in rows], pa.binary())], names=["ref", "raw"])
        for b in batches:
            done = []
            for key, *run in zip(*(c.to_pylist() for c in b.columns)):
                if runs and key != ref:
                    done.append((ref, ntfs.encode_runs(runs)))
                    runs = []
                ref = key
                runs.append(run)
            if done:
                yield batch(done)
        if runs:
            yield batch([(ref, ntfs.encode_runs(runs))])

    made = lines.mapInArrow(encode, "ref bigint, raw binary")
    return records.decode_run_lists(made, "raw").select("ref", F.col("decoded.runs").alias("runs")).select("ref", F.inline("runs"))


@query(f"WITH l AS ({_LINES}) SELECT ref, idx::INT AS idx, (sum(lcn) OVER w)::BIGINT AS lcn, (sum(len) OVER w - len)::BIGINT AS vcn, len FROM l WINDOW w AS (PARTITION BY ref ORDER BY idx)")
def run_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster numbers from deltas by running sums, line items for runs."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref"), place.alias("idx"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("delta"), F.col("l_quantity").cast("bigint").alias("len"))
    return catalogue.lcn_from_deltas(runs)


@query("SELECT page_id, lower(split_part(url, '.', -1)) AS ext FROM pages")
def ext_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text after the last dot of every URL."""
    return table(spark, sf_dir, "pages").select("page_id", match.extension(F.col("url")).alias("ext"))


@query("SELECT n_nationkey AS tag, coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, n_nationkey::VARCHAR) AS name FROM nation")
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with names where the dictionary has them: nations for tags, two thirds of them known."""
    from wrackline.sources.files import with_tag_names

    nation = table(spark, sf_dir, "nation")
    names = nation.filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("tag"), F.col("n_name").alias("name"))
    return with_tag_names(nation.select(F.col("n_nationkey").alias("tag")), names).select("tag", "name")
