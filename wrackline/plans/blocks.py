"""Block sources, signatures and statistics, on blocks made of texts and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrackline.functions.bytesql import filetime_to_unix, unix_to_filetime
from wrackline.operators import blockstats, signatures
from wrackline.plans.common import registered, table, text_bytes

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registered(QUERIES, ORACLE_SQL)


@query("""
SELECT page_id, CASE substr(html, 1, 4) WHEN '<!DO' THEN 'XHTML' WHEN '<!do' THEN 'xhtml' WHEN '<htm' THEN 'html' WHEN '<HTM' THEN 'HTML' WHEN '<?xm' THEN 'XML' END AS kind
FROM pages""")
def page_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block type of every page by its first bytes."""
    return table(spark, sf_dir, "pages").select("page_id", signatures.block_type(F.substring(text_bytes(F.col("html")), 1, 4096)).alias("kind"))


@query("""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(regexp_extract_all(h, '.{1000}.{24}')) AS c FROM d)
SELECT doc_id, count(*) AS sectors, count(*) FILTER (WHERE c = repeat(substr(c, 1, 8), 128)) AS uniform FROM s GROUP BY doc_id""")
def sector_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole 512-byte sectors of every text, and how many of them repeat four bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_bytes(F.col("text")).alias("b"))
    n = F.floor(F.octet_length("b") / 512).cast("int")
    rows = docs.filter(n > 0).select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("b", i * 512 + 1, F.lit(512)))).alias("data"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sectors"), F.count_if(blockstats.is_uniform(F.col("data"))).alias("uniform"))


_HEADS = [
    (b"INDX" + bytes(24) + (100).to_bytes(4, "little") + (4072).to_bytes(4, "little"), "INDX", 64),
    (b"FILE" + bytes(20) + (416).to_bytes(4, "little") + (1024).to_bytes(4, "little"), "FILE", 128),
    (b"FILE" + bytes(20) + (2000).to_bytes(4, "little") + (1024).to_bytes(4, "little"), "FILE", 0),
    (b"PK\3\4\x14\0\0\0\x08\0", "ZIP", 1),
    (b"PK\3\4\x0a\0\0\0\0\0", "ZIP", 0),
    (bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + bytes.fromhex("3E000300"), "OLE2", 1),
    (b"{\\rtf1\\ansi", "RTF", 1),
    (b"%PDF-1.4", "PDF", 1),
    (b"%PDF-1.9", None, 0),
    (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", "PNG", 2),
    (b"8BPS\0\1\0\0" + bytes(5) + b"\3" + bytes(8) + b"\0\x08", "PSD", 2),
    (b"\xff\xd8\xff\xe0\0\x10JFIF", "JPEG", 2),
    (b"\xff\xd8\xff\xe0\0\x10none", "JPEG", 0),
    (b"\0\0\0\x18ftypmp42", "MP4", 2),
    (b"$FL2@(#) IBM", "SAV", 1),
    (b"plain text", None, 0),
]


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sector per document: a header by its id; of the last kind every other is empty."""
    heads = F.array(*[F.lit(bytearray(h.ljust(512, b"\x2e"))) for h, _, _ in _HEADS])
    k = (F.col("doc_id") % len(_HEADS)).cast("int")
    empty = (F.col("doc_id") % (2 * len(_HEADS)) == 2 * len(_HEADS) - 1)
    data = F.when(empty, F.lit(bytearray(512))).otherwise(F.element_at(heads, k + 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("image"), (F.col("doc_id") * 512).alias("fpos"), data.alias("data"))


_CASE = " ".join(f"WHEN {i} THEN {f}" for i, (_, _, f) in enumerate(_HEADS))
_KIND = " ".join(f"WHEN {i} THEN {'NULL' if k is None else repr(k)}" for i, (_, k, _) in enumerate(_HEADS))
_N = len(_HEADS)


@query(f"SELECT doc_id, CASE doc_id % {_N} {_KIND} END AS kind, CASE doc_id % {_N} {_CASE} END AS flag FROM documents")
def signature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated signatures of synthetic sectors, near-misses among them."""
    s = signatures.sector_signature(F.col("data"))
    return _sectors(spark, sf_dir).select("doc_id", s["kind"].alias("kind"), s["flag"].alias("flag"))


@query(f"""
WITH s AS (SELECT doc_id // 32 AS buffer, CASE doc_id % {_N} {_CASE} END AS flag, doc_id % {2 * _N} <> {2 * _N - 1} AS used FROM documents),
b AS (SELECT buffer, bit_or(flag) AS flags, count(*) AS sectors, count(*) FILTER (WHERE used) AS used FROM s GROUP BY buffer)
SELECT buffer, flags, sectors, used, CASE WHEN flags & 128 <> 0 THEN 'M' WHEN flags & 64 <> 0 THEN 'I' WHEN flags & 1 <> 0 THEN '~' WHEN flags & 2 <> 0 THEN '#'
WHEN used = 0 THEN '0' WHEN used = sectors THEN '*' ELSE '.' END AS map FROM b""")
def buffer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags or-ed per buffer, sectors in use and the map's character, over buffers of 32 sectors."""
    stats = blockstats.buffer_stats(_sectors(spark, sf_dir), buffer=32 * 512)
    return stats.select("buffer", "flags", "sectors", F.col("used").cast("bigint").alias("used"), blockstats.buffer_char(F.col("flags"), F.col("used"), F.col("sectors")).alias("map"))


@query(f"SELECT 512 * count(*) AS bytes, count(*) AS sectors, count(*) FILTER (WHERE doc_id % {2 * _N} <> {2 * _N - 1}) AS used FROM documents")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, sectors and sectors in use of the synthetic image."""
    found = blockstats.usage(blockstats.buffer_stats(_sectors(spark, sf_dir)))
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in ("bytes", "sectors", "used")])


@query("""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, 16 * instr('0123456789ABCDEF', p[1]) + instr('0123456789ABCDEF', p[2]) - 17 AS v FROM (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS p FROM d)),
x AS (SELECT doc_id, bit_xor(v) AS x FROM b WHERE v NOT IN (0, 255) GROUP BY doc_id)
SELECT doc_id, coalesce(x, 0)::INT AS x, substr('0123456789ABCDEF@abcdefghijklmno', 1 + (coalesce(x, 0) & 31)::INT, 1) AS c FROM d LEFT JOIN x USING (doc_id) WHERE h <> ''""")
def xor_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive or of each text's bytes and its character."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_bytes(F.col("text")).alias("b")).filter(F.octet_length("b") > 0)
    return docs.select("doc_id", blockstats.byte_xor(F.col("b")).alias("x"), blockstats.fingerprint_char(F.col("b")).alias("c"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds, (epoch(date_trunc('second', ts))::BIGINT + 11644473600) * 10000000 AS ticks FROM events")
def filetime_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to ticks since 1601 and back."""
    seconds = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp"))
    ticks = unix_to_filetime(seconds)
    return table(spark, sf_dir, "events").select("event_id", filetime_to_unix(ticks).alias("seconds"), ticks.alias("ticks"))


@query("SELECT doc_id, true AS same FROM documents")
def crc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's CRC-32 against the one that chunk checks use."""

    @F.pandas_udf("bigint")
    def crc(data):
        import zlib

        import pandas as pd

        return pd.Series([zlib.crc32(d) for d in data])

    b = text_bytes(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.crc32(b) == crc(b)).alias("same"))
