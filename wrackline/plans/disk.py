"""The engine's own path: an image with a file system, made of the documents, scanned and put together again.

The image is written to the shared folder by the tasks that hold the documents,
scanned through the block source, and deleted once a query has its result.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrackline.functions import codecs, ntfs
from wrackline.operators import blockstats, catalogue, recover, signatures
from wrackline.operators import ntfs as records
from wrackline.operators.catalogue import _cut, shared_folder
from wrackline.plans.blocks import _CASE, _HEADS, _N
from wrackline.plans.common import dealt, registered, small_batches, table, text_bytes
from wrackline.sources import files as tables
from wrackline.sources.rawblocks import blocks

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registered(QUERIES, ORACLE_SQL)

T0 = 1_600_000_000
MFT_AT = 16  # cluster of the first record
ROOT, LANGUAGE, FIRST = 5, 20, 1000
LANGUAGES = ("de", "en", "es", "fr")
C = ntfs.CLUSTER


def _scratch(spark: SparkSession) -> str:
    """A new file name in the shared folder, as a local path."""
    folder = shared_folder(spark)
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError("images of these queries are written to a folder that all machines mount")
    folder = folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/image-{uuid.uuid4().hex}"


def _written(rows: DataFrame, path: str, size: int, make: Callable[[dict], list[tuple[int, bytes]]]) -> None:
    """Write (offset, bytes) of every row into a file of ``size`` bytes."""
    small_batches(rows.sparkSession)
    with open(path, "wb") as f:
        f.truncate(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with open(path, "r+b") as f:
                for values in zip(*b.columns):
                    for at, data in make({k: v.as_py() for k, v in zip(b.schema.names, values)}):
                        f.seek(at)
                        f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _answer(found: DataFrame, *paths: str) -> DataFrame:
    """The written result, without the image that it was read from."""
    out = _cut(found)
    for p in paths:
        os.remove(p)
    return out


# ---- the file system ---------------------------------------------------------------------------------


def _name(parent: int, text: str, size: int, mtime: int, flags: int = 0) -> bytes:
    return ntfs.name_key(parent, mtime, size, text, 1, flags)


def _unit_runs(data: bytes, start: int) -> tuple[list[tuple[int | None, int]], bytes]:
    """Runs and bytes of a compressed file: each unit shorter than whole is followed by a sparse pad."""
    runs: list[tuple[int | None, int]] = []
    out = b""
    for at in range(0, len(data), codecs.UNIT):
        packed = codecs.lznt1_compress(data[at : at + codecs.UNIT])
        n = -(-len(packed) // C)
        runs += [(start + len(out) // C, n), (None, 16 - n)] if n < 16 else [(start + len(out) // C, 16)]
        out += (packed if n < 16 else data[at : at + codecs.UNIT]).ljust(n * C if n < 16 else codecs.UNIT, b"\0")
    return runs, out


def _piece(runs: list[tuple[int | None, int]], size: int, vcn: int = 0) -> bytes:
    raw = bytearray(ntfs.nonresident(ntfs.DATA, runs, size))
    last = vcn + sum(n for _, n in runs) - 1
    raw[16:24], raw[24:32] = vcn.to_bytes(8, "little"), last.to_bytes(8, "little")
    return bytes(raw)


def _listed(refs: list[int]) -> bytes:
    """An attribute list that names records with unnamed data."""
    rows = b"".join((0x80).to_bytes(4, "little") + (32).to_bytes(2, "little") + bytes(10) + r.to_bytes(8, "little") + bytes(8) for r in refs)
    return ntfs.resident(ntfs.ATTRIBUTE_LIST, rows)


def _document(r: dict, index_at: int) -> list[tuple[int, bytes]]:
    """Where the bytes of one document go: records, index block and data.

    The id modulo 4 tells how the data lies: in one run, in two that are
    swapped, compressed, or with runs in two further records.  Ids that end in
    9 are deleted.
    """
    ref, size, n, start, d = FIRST + 3 * r["doc_id"], len(r["b"]), r["n"], r["start"], r["b"]
    parent, mtime = LANGUAGE + LANGUAGES.index(r["lang"]), T0 + r["doc_id"]
    key = _name(parent, f"doc-{r['doc_id']}.txt", size, mtime)
    out: list[tuple[int, bytes]] = []
    attrs, children = [ntfs.resident(ntfs.NAME, key)], []
    kind, half = r["doc_id"] % 4, (n + 1) // 2
    if not n:
        attrs.append(ntfs.resident(ntfs.DATA, b""))
    elif kind == 0 or kind == 3 and n < 2:
        attrs.append(_piece([(start, n)], size))
        out.append((start * C, d))
    elif kind == 1:
        # The second half comes first on the disk, with a cluster between.
        runs = [(start + n - half + 1, half)] + ([(start, n - half)] if n > half else [])
        attrs.append(_piece(runs, size))
        out += [(runs[0][0] * C, d[: half * C]), (start * C, d[half * C :])]
    elif kind == 2:
        runs, packed = _unit_runs(d, start)
        attrs.append(ntfs.nonresident(ntfs.DATA, runs, size, compression=4))
        out.append((start * C, packed))
    else:
        attrs.append(_listed([ref + 2, ref + 1]))
        children = [(ref + 1, _piece([(start, half)], size)), (ref + 2, _piece([(start + half, n - half)], 0, half))]
        out.append((start * C, d))
    slot = MFT_AT * C + 1024 * (8 + 3 * r["rank"])
    flags = 0 if r["doc_id"] % 10 == 9 else 1
    made = [ntfs.make_record(ref, attrs, flags)] + [ntfs.make_record(c, [a]) for c, a in children]
    out += [(slot + 1024 * i, m) for i, m in enumerate(made)]
    return [*out, (index_at + ntfs.INDEX_BLOCK * r["rank"], ntfs.make_index([(ref, key)]))]


def _disk(spark: SparkSession, sf_dir: str) -> str:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("en")).alias("lang"), text_bytes(F.col("text")).alias("b"))
    n = F.ceil(F.octet_length("b") / C).cast("long")
    # One window over ids and sizes lays the image out; the texts stay where they are.
    by_id = Window.orderBy("doc_id")
    layout = docs.select("doc_id", n.alias("n")).select("doc_id", "n", (F.row_number().over(by_id) - 1).alias("rank"), (F.sum(F.col("n") + 1).over(by_id) - F.col("n") - 1).alias("start"))
    layout = _cut(layout)
    count, clusters = layout.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") + 1), F.lit(0))).first()
    mft = max(128, -(-(8 + 3 * count) // 4))
    index_at, data_at = (MFT_AT + mft) * C, MFT_AT + mft + count
    path = _scratch(spark)
    rows = dealt(docs).join(layout.withColumn("start", F.col("start") + data_at), "doc_id")
    _written(rows, path, (data_at + clusters) * C, lambda r: _document(r, index_at))
    folder = lambda ref, text: ntfs.make_record(ref, [ntfs.resident(ntfs.NAME, _name(ROOT, text, 0, T0, ntfs.DIRECTORY_KEY))], 3)
    master = ntfs.make_record(0, [ntfs.resident(ntfs.NAME, _name(ROOT, "$MFT", 0, T0)), _piece([(MFT_AT, mft)], mft * C)])
    with open(path, "r+b") as f:
        f.seek(MFT_AT * C)
        f.write(b"".join([master, folder(ROOT, "."), *[folder(LANGUAGE + i, x) for i, x in enumerate(LANGUAGES)]]))
    return path


_DOCS = "SELECT doc_id, coalesce(lang, 'en') AS lang, octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents"
_CLUSTERS = "(size + 4095) // 4096"


@query(f"SELECT doc_id, './' || lang || '/doc-' || doc_id || '.txt' AS path, size, 1600000000 + doc_id AS mtime, digest, true AS whole FROM ({_DOCS}) WHERE doc_id % 10 <> 9")
def disk_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image to records, paths, runs over several records, and files: every document comes back from its clusters."""
    path = _disk(spark, sf_dir)
    found, index = records.scan_image(spark, path)
    found = _cut(found)  # read twice below
    dirs = catalogue.paths(catalogue.directories(found, index))
    own = catalogue.with_extensions(found).filter(records.in_use(F.col("flags")) & ~records.is_directory(F.col("flags")) & F.col("name").startswith("doc-"))
    out = recover.restored(catalogue.with_paths(own, dirs), path)
    return _answer(out.select(F.regexp_extract("path", "doc-([0-9]+)", 1).cast("bigint").alias("doc_id"), "path", "size", "mtime", F.md5("content").alias("digest"), F.col("error").isNull().alias("whole")), path)


@query(f"""
WITH d AS ({_DOCS}) SELECT 'INDX' AS origin, doc_id, './' || lang || '/doc-' || doc_id || '.txt' AS path, size FROM d WHERE size >= 1024
UNION ALL SELECT 'MFT', doc_id, './' || lang || '/doc-' || doc_id || '.txt', size FROM d WHERE size >= 1024 AND doc_id % 10 <> 9""")
def disk_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of both passes, written as a catalogue, read again and listed from 1024 bytes on."""
    path = _disk(spark, sf_dir)
    found, index = records.scan_image(spark, path)
    saved = path + ".catalogue"
    tables.write_catalogue(catalogue.with_paths(catalogue.entries(found, index), catalogue.paths(catalogue.directories(found, index))).filter("name LIKE 'doc-%'"), saved)
    listed = catalogue.listing(tables.catalogue(spark, saved))
    return _answer(listed.select("origin", F.regexp_extract("path", "doc-([0-9]+)", 1).cast("bigint").alias("doc_id"), "path", "size"), path)


@query(f"""
WITH d AS ({_DOCS}), r AS (SELECT *, {_CLUSTERS} AS n, CASE WHEN doc_id % 4 = 1 AND size > 4096 THEN 2 ELSE 1 END AS runs FROM d WHERE size > 0 AND doc_id % 10 <> 9 AND (doc_id % 4 < 2 OR doc_id % 4 = 3 AND size <= 4096))
SELECT doc_id, size, runs::INT AS runs, runs = 2 AS fragmented, runs::BIGINT AS wiped_runs, n * 4096 AS wiped_bytes FROM r""")
def disk_recoverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files with whole runs, whether they lie in pieces, and what a wipe would zero."""
    path = _disk(spark, sf_dir)
    found, _ = records.scan_image(spark, path)
    plain = _cut(catalogue.recoverable(found).filter("name LIKE 'doc-%'").withColumn("path", F.col("name")))
    wiped = recover.wipe_plan(plain).groupBy("path").agg(F.count(F.lit(1)).alias("wiped_runs"), F.sum("length").alias("wiped_bytes"))
    pieces = records.fragmented(found).select("ref", "fragmented")
    out = plain.join(wiped, "path").join(pieces, "ref").select(((F.col("ref") - FIRST) / 3).cast("bigint").alias("doc_id"), "size", F.size("runs").alias("runs"), "fragmented", "wiped_runs", "wiped_bytes")
    return _answer(out, path)


@query(f"WITH d AS ({_DOCS}), r AS (SELECT * FROM d WHERE size > 0 AND doc_id % 10 <> 9 AND (doc_id % 4 < 2 OR doc_id % 4 = 3 AND size <= 4096)) SELECT count(*) AS files, sum(size)::BIGINT AS bytes_wanted, sum(size)::BIGINT AS bytes_copied, 0::BIGINT AS errors FROM r")
def disk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a dry run that copies all plain files."""
    path = _disk(spark, sf_dir)
    found, _ = records.scan_image(spark, path)
    plain = catalogue.recoverable(found).filter("name LIKE 'doc-%'").withColumn("path", F.col("name"))
    return _answer(recover.totals(recover.restored(plain, path)), path)


@query(f"WITH d AS ({_DOCS}), r AS (SELECT * FROM d WHERE size > 0 AND doc_id % 10 <> 9 AND (doc_id % 4 < 2 OR doc_id % 4 = 3 AND size <= 4096)) SELECT lang AS tree, count(*) AS files, sum(size)::BIGINT AS bytes_wanted, sum(size)::BIGINT AS bytes_copied, 0::BIGINT AS errors FROM r GROUP BY lang")
def disk_tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run of copying each folder's tree."""
    path = _disk(spark, sf_dir)
    found, index = records.scan_image(spark, path)
    found = _cut(found)  # read twice below
    plain = catalogue.recoverable(found).filter("name LIKE 'doc-%'")
    named = catalogue.with_paths(plain, catalogue.paths(catalogue.directories(found, index)))
    return _answer(recover.tree_totals(recover.restored(named, path)), path)


@query("""
WITH n AS (SELECT count(*) AS docs FROM documents), m AS (SELECT greatest(128, (8 + 3 * docs + 3) // 4) AS mft FROM n)
SELECT 4096::BIGINT AS cluster, 0::BIGINT AS part_start, mft - 1 AS last_vcn, ' bs=4096 skip=16 count=' || mft AS command FROM m""")
def disk_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster size and partition start from the master table's own record, and the command that copies it."""
    path = _disk(spark, sf_dir)
    found, _ = records.scan_image(spark, path)
    found = _cut(found.filter("name = '$MFT'"))  # of all records, decoded once
    command = F.regexp_replace("command", "^dd if=[^ ]*", "")
    out = records.geometry(found).join(records.dd_commands(found).select("fpos", command.alias("command")), "fpos")
    return _answer(out.select("cluster", "part_start", "last_vcn", "command"), path)


@query(f"""
WITH d AS ({_DOCS}), k AS (SELECT 'INDX' AS kind, 64 AS flag, 1 AS n FROM d UNION ALL SELECT 'FILE', 128, CASE WHEN doc_id % 4 = 3 AND size > 4096 THEN 3 ELSE 1 END FROM d UNION ALL SELECT 'FILE', 128, 6)
SELECT kind, flag, sum(n)::BIGINT AS n FROM k GROUP BY ALL""")
def disk_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors of the image by signature."""
    path = _disk(spark, sf_dir)
    hits = signatures.sector_hits(blocks(spark, path, 512)).filter("kind IN ('FILE', 'INDX')")
    return _answer(hits.groupBy("kind", "flag").agg(F.count(F.lit(1)).alias("n")), path)


# ---- flat images: a block or sector per document --------------------------------------------------------

_RANKED = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents"


def _flat(spark: SparkSession, sf_dir: str, block: int, make: Callable[[dict], bytes]) -> str:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_bytes(F.col("text")).alias("b"))
    ranked = _cut(docs.select("doc_id", (F.row_number().over(Window.orderBy("doc_id")) - 1).alias("k")))
    path = _scratch(spark)
    _written(docs.join(ranked, "doc_id"), path, block * ranked.count(), lambda r: [(r["k"] * block, make(r)[:block])])
    return path


@query(f"""
WITH s AS (SELECT k // 32 AS buffer, CASE k % {_N} {_CASE} END AS flag, k % {2 * _N} <> {2 * _N - 1} AS used FROM ({_RANKED})),
b AS (SELECT buffer, bit_or(flag) AS flags, count(*) AS sectors, count(*) FILTER (WHERE used) AS used FROM s GROUP BY buffer HAVING count(*) = 32),
c AS (SELECT buffer, CASE WHEN flags & 128 <> 0 THEN 'M' WHEN flags & 64 <> 0 THEN 'I' WHEN flags & 1 <> 0 THEN '~' WHEN flags & 2 <> 0 THEN '#' WHEN used = 0 THEN '0' WHEN used = sectors THEN '*' ELSE '.' END AS c FROM b)
SELECT (buffer // 8)::BIGINT AS row, (buffer // 8 * 8 * 16384 // 1073741824)::VARCHAR || ' GB' AS label, string_agg(c, '' ORDER BY buffer) AS map FROM c GROUP BY buffer // 8""")
def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of an image of known sectors, read back through the block source."""
    heads = [h.ljust(512, b"\x2e") for h, _, _ in _HEADS]
    path = _flat(spark, sf_dir, 512, lambda r: bytes(512) if r["k"] % (2 * len(heads)) == 2 * len(heads) - 1 else heads[r["k"] % len(heads)])
    stats = blockstats.buffer_stats(blocks(spark, path, 512), buffer=32 * 512)
    return _answer(blockstats.heat_map(stats, columns=8, whole=32, buffer=32 * 512).select("row", "label", "map"), path)


@query(f"""
WITH d AS (SELECT k, hex(encode(coalesce(text, ''))) AS h FROM ({_RANKED}) JOIN documents USING (doc_id) WHERE k <= 100),
b AS (SELECT k, 16 * instr('0123456789ABCDEF', p[1]) + instr('0123456789ABCDEF', p[2]) - 17 AS v FROM (SELECT k, unnest(regexp_extract_all(substr(h, 1, 8192), '..')) AS p FROM d)),
x AS (SELECT k, bit_xor(v) AS x FROM b WHERE v NOT IN (0, 255) GROUP BY k),
c AS (SELECT k, CASE WHEN h = '' THEN '.' ELSE substr('0123456789ABCDEF@abcdefghijklmno', 1 + (coalesce(x, 0) & 31)::INT, 1) END AS c FROM d LEFT JOIN x USING (k))
SELECT (k // 16 * 65536)::BIGINT AS fpos, string_agg(c, '' ORDER BY k) AS map FROM c GROUP BY k // 16""")
def xor_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character per block of an image of texts, up to a limit."""
    path = _flat(spark, sf_dir, C, lambda r: r["b"])
    return _answer(blockstats.xor_map(blocks(spark, path, C), columns=16, limit=100 * C).select("fpos", "map"), path)


@query(f"SELECT (512 * k)::BIGINT AS fpos, doc_id::VARCHAR AS text FROM ({_RANKED}) WHERE k BETWEEN 3 AND 40 AND doc_id % 3 = 0")
def block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one magic in a byte range of an image."""
    path = _flat(spark, sf_dir, 512, lambda r: (b"yes " if r["doc_id"] % 3 == 0 else b"no  ") + str(r["doc_id"]).encode())
    rows = blocks(spark, path, 512, start=3 * 512, end=41 * 512, magic=b"yes ".hex(), partitionbytes=4096)
    return _answer(rows.select("fpos", F.regexp_extract(F.decode(F.substring("data", 5, 20), "ISO-8859-1"), "^[0-9]+", 0).alias("text")), path)


# ---- file tables ------------------------------------------------------------------------------------------


@query("SELECT n_nationkey || '.txt' AS name, octet_length(encode(n_name))::BIGINT AS size, md5(n_name) AS digest, n_nationkey % 2 = 0 AS deep FROM nation")
def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files of a folder tree, written by the engine, listed and read again."""
    top = _scratch(spark)
    nation = table(spark, sf_dir, "nation")
    path = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "a/b/").otherwise(""), F.col("n_nationkey").cast("string"), F.lit(".txt"))
    recover.write_files(nation.select(path.alias("path"), F.lit(T0).cast("bigint").alias("mtime"), F.encode("n_name", "UTF-8").alias("content")), top).collect()
    found = tables.recovered(spark, top).filter(F.col("mtime") == T0)
    return _cut(found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", F.md5("content").alias("digest"), F.col("path").contains("/a/b/").alias("deep")))


def _lines(spark: SparkSession, lines: DataFrame) -> str:
    folder = _scratch(spark)
    lines.write.text("file://" + folder)
    return "file://" + folder


@query("SELECT c_custkey * 4096 AS fpos, c_custkey + 7 AS size, c_name || ' report ' || c_nationkey || '.doc' AS name FROM customer WHERE c_custkey % 5 <> 0")
def carve_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A carver's list with broken lines in it, written as text and read."""
    c = table(spark, sf_dir, "customer")
    good = F.concat(F.lit("0x"), F.hex(F.col("c_custkey") * 4096), F.lit(": "), (F.col("c_custkey") + 7).cast("string"), F.lit(" x y z "), "c_name", F.lit(" report "), F.col("c_nationkey").cast("string"), F.lit(".doc"))
    return tables.carve_list(spark, _lines(spark, c.select(F.when(F.col("c_custkey") % 5 == 0, "cut short").otherwise(good).alias("value"))))


@query("SELECT p_partkey::INT AS tag, trim(p_name) AS name FROM part WHERE p_partkey % 7 <> 0")
def tag_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag dictionary as text; lines without a number are no entries."""
    p = table(spark, sf_dir, "part")
    number = F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.col("p_partkey").cast("string"))
    return tables.tag_names(spark, _lines(spark, p.select(F.concat_ws("\t", number, F.hex("p_partkey"), "p_name").alias("value"))))


@query("SELECT s_suppkey * 32 AS fpos, 'F' || lpad((s_suppkey % 10000000)::VARCHAR, 7, '0') AS name, 'JPG' AS ext, s_suppkey * 3 + 70000 AS cluster, s_suppkey * 100 AS size FROM supplier WHERE s_suppkey % 3 = 0")
def fat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAT directory records of one extension, among others and unprintable ones."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")

    @F.pandas_udf("binary")
    def record(keys):
        import pandas as pd

        def one(k: int) -> bytes:
            name = f"F{k % 10_000_000:07d}".encode() + (b"JPG", b"TXT", b"J\x01G")[k % 3]
            cluster = 3 * k + 70_000
            return name + bytes(9) + (cluster >> 16).to_bytes(2, "little") + bytes(4) + (cluster & 0xFFFF).to_bytes(2, "little") + (100 * k).to_bytes(4, "little")

        return pd.Series([one(int(k)) for k in keys])

    return signatures.fat_entries(s.select(F.lit("i").alias("image"), (F.col("s_suppkey") * 32).alias("fpos"), record("s_suppkey").alias("data"))).drop("image")
