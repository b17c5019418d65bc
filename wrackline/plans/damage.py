"""Damaged input, the normal case: records, run lists, formats and codecs, broken in known ways by id."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrackline.functions import ansi, archive, codecs, images, jpeg, ntfs, ole, pdf, tables
from wrackline.functions.memo import Memo
from wrackline.operators import catalogue, match, repair, signatures, validate
from wrackline.operators import ntfs as records
from wrackline.plans.blocks import _HEADS, _N
from wrackline.plans.catalogue import _made
from wrackline.plans.common import made_files, registered, table, text_bytes, turned
from wrackline.plans.content import NOISE, _noise, _zip

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registered(QUERIES, ORACLE_SQL)

BLOCK = "image string, fpos bigint, data binary"


def _case(key: str, values: list, default: str = "NULL") -> str:
    show = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + f" ELSE {default} END"


# ---- formats: one variant of damage per id ------------------------------------------------------------


def _cycle(period: int) -> Callable:
    """For a maker whose bytes depend on the id modulo ``period`` only: each of them is made once."""

    def wrap(make: Callable[[int, int], bytes]) -> Callable[[int, int], bytes]:
        made = Memo(make, 8 * period)
        return lambda i, k: made(i % period, k)

    return wrap


@_cycle(NOISE)
def _gif(i: int, k: int) -> bytes:
    good = images.make_gif(24, 17 if k == 4 else 16, _noise(i, 384), trailer=b"\x77" if k == 1 else b";")
    if k == 2:
        return good[:6] + (9000).to_bytes(2, "little") + good[8:]
    at = 13 + 768 + 10  # the code size
    return good[:at] + b"\0" + good[at + 1 :] if k == 5 else good[: at + 20] if k == 3 else good


@_cycle(NOISE)
def _tif(i: int, k: int) -> bytes:
    good = images.make_tiff(32, 24 + (k == 1), _noise(i, 768), (images.RAW, images.LZW, images.RAW, images.PACKBITS, images.RAW, images.DEFLATE)[k])
    after = 8 + 2 + 12 * 9
    if k == 2:
        return good[:after] + (8).to_bytes(4, "little") + good[after + 4 :]
    if k == 3:
        return good[:8] + b"\xff\0" + good[10:]
    return good[:-400] if k == 4 else good[:-60] + bytes(60) if k == 5 else good


@_cycle(NOISE)
def _psd(i: int, k: int) -> bytes:
    rows = [_noise(i + y, 32) for y in range(24)]
    if k == 3:
        rows[5] = rows[5][:20]
    good = images.make_psd(33 if k == 2 else 32, 24, rows, rle=k in (2, 3, 5))
    return good + b"x" if k in (1, 5) else good[:5] + b"\2" + good[6:] if k == 4 else good


@_cycle(NOISE)
def _png(i: int, k: int) -> bytes:
    raw = b"".join(b"\0" + _noise(i + y, 32) for y in range(24 - (k == 3)))
    good = images.make_png(32, 24, raw)
    if k == 1:
        return good[:29] + bytes([good[29] ^ 1]) + good[30:]
    if k == 2:
        return good[:-12]
    return good[:60] + bytes([good[60] ^ 8]) + good[61:] if k == 4 else good


@_cycle(NOISE)
def _jpg(i: int, k: int) -> bytes:
    good = jpeg.make_jpeg(96, 64, [int(v) * 7 - 890 for v in _noise(i, 96)])
    if k == 6:  # a frame too narrow to be meant
        at = good.index(b"\xff\xc0") + 7
        return good[:at] + b"\0\x08" + good[at + 2 :]
    if k == 1:
        return good[:2] + good
    if k == 2:
        return good[:-2]
    if k == 3:
        at = good.index(b"\xff\xdb")
        return good[: at + 2] + b"\0\x45" + good[at + 4 : at + 69] + b"\0\0" + good[at + 69 :]
    if k == 4:
        at = good.index(b"\xff\xdb")
        return good[:at] + b"junk" + good[at:]
    return good + good if k == 5 else good


def _pdf(i: int, k: int) -> bytes:
    stream = zlib.compress(b"BT %d ET " % i * 40)
    packed = bytes(len(stream)) if k == 4 else stream
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"]
    good = pdf.make_pdf(bodies, startxref=k != 2, end=b"\n" if k == 1 else b"%%EOF\n")
    if k == 3:
        return good.replace(b"0000000015 00000 n", b"0000009999 00000 n")
    return good + b"x" * 5000 if k == 5 else good


def _archive(i: int, k: int) -> bytes:
    good = _zip(i, k == 1)
    if k == 2:
        whole = archive.make_zip({"big.bin": _noise(i, 3000)}, 0)
        return whole[:500] + bytes([whole[500] ^ 1]) + whole[501:]
    return archive.make_zip({"big.bin": _noise(i, 3000)}, 0)[:2000] if k == 3 else archive.make_zip({"ppt/presentation.xml": b"<a>" + b"x" * 2000, "ppt/theme/theme1.xml": b"<b>" + b"y" * 2000}) if k == 4 else good


def _wmf(i: int, k: int) -> bytes:
    good = images.make_wmf([bytes(20)] * 30)
    return good + b"x" if k == 1 else good[:40] + b"\xff\xff" + good[42:] if k == 2 else good[:40] + bytes(4) + b"\1" + good[45:] if k == 3 else good


@_cycle(NOISE)
def _ole(i: int, k: int) -> bytes:
    good = ole.make_compound({("Workbook", "PowerPoint Document", "Catalog", "WordDocument", "Other")[k]: _noise(i, 300) if k else b"", "1Table": _noise(i + 1, 300)})
    return good


#: Format to its maker, and (errors, extension, status) of each variant.
_VARIANTS: dict[str, tuple[Callable[[int, int], bytes], list[tuple[int | None, str, str]]]] = {
    "gif": (_gif, [(0, "gif", "OK"), (20, "gif", "BAD"), (10, "gif", "BAD"), (100, "gif", "BAD"), (1, "gif", "BAD"), (100, "gif", "BAD")]),
    "tif": (_tif, [(0, "tif", "OK"), (1, "tif", "BAD"), (10, "tif", "BAD"), (10, "tif", "BAD"), (1, "tif", "BAD"), (None, "tif", "ERROR")]),
    "psd": (_psd, [(0, "psd", "OK"), (10, "psd", "BAD"), (20, "psd", "BAD"), (1, "psd", "BAD"), (-1, "???", "DUNNO"), (10, "psd", "BAD")]),
    "png": (_png, [(0, "png", "OK"), (1, "png", "BAD"), (1, "png", "BAD"), (1, "png", "BAD"), (11, "png", "BAD")]),
    "jpeg": (_jpg, [(0, "jpg", "OK"), (10, "jpg", "BAD"), (10, "jpg", "BAD"), (10, "jpg", "BAD"), (5, "jpg", "BAD"), (0, "jpg", "OK"), (1, "jpg", "BAD")]),
    "pdf": (_pdf, [(0, "pdf", "OK"), (5, "pdf", "BAD"), (10, "pdf", "BAD"), (1, "pdf", "BAD"), (1, "pdf", "BAD"), (1, "pdf", "BAD")]),
    "zip": (_archive, [(0, "docx", "OK"), (1, "docx", "BAD"), (1, "zip", "BAD"), (10, "zip", "BAD"), (2, "pptx", "BAD")]),
    "wmf": (_wmf, [(0, "wmf", "OK"), (1, "wmf", "BAD"), (2, "wmf", "BAD"), (1, "wmf", "BAD")]),
    "ole": (_ole, [(0, "xls", "OK"), (0, "ppt", "OK"), (0, "db", "OK"), (0, "doc", "OK"), (0, "ole", "OK")]),
}


def _files(spark: SparkSession, sf_dir: str, make: Callable[[int, int], bytes], variants: int) -> DataFrame:
    """A file per customer, broken in the way that its key modulo ``variants`` names."""
    return made_files(table(spark, sf_dir, "customer").select("c_custkey"), lambda i: make(i, i % variants))


def _damage(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        make, cases = _VARIANTS[kind]
        found = validate.verdicts(_files(spark, sf_dir, make, len(cases)))
        return found.select(F.col("path").cast("bigint").alias("id"), "ext", "errcnt", "status")

    run.__name__, run.__doc__ = f"{kind}_damage", f"A {kind} file per customer, sound or broken in one of several ways."
    return run


for _kind, (_, _cases) in _VARIANTS.items():
    QUERIES[f"{_kind}_damage"] = _damage(_kind)
    _k = f"c_custkey % {len(_cases)}"
    ORACLE_SQL[f"{_kind}_damage"] = f"SELECT c_custkey AS id, {_case(_k, [e for _, e, _ in _cases])} AS ext, {_case(_k, [n for n, _, _ in _cases])}::INT AS errcnt, {_case(_k, [s for *_, s in _cases])} AS status FROM customer"


def _dxf(i: int, k: int) -> bytes:
    good = tables.make_dxf({"HEADER": [(9, "$ACADVER"), (1, "AC1009")], "ENTITIES": [(0, "LINE"), *[(c, str(i + c)) for c in range(10, 40)]]})
    return good.replace(b"EOF", b"EOX") if k == 1 else good.replace(b"ENDSEC", b"END", 1) if k == 2 else b"text\n" + good if k == 3 else good


def _sav(i: int, k: int) -> bytes:
    good = tables.make_sav([f"V{j}" for j in range(3 + i % 5)], b"a label" if i % 2 else b"")
    return good[:-8] if k == 1 else good[:64] + b"\x09" + good[65:] if k == 2 else good


@query("SELECT c_custkey AS id, 'dxf' AS ext, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 10 END AS errcnt, CASE WHEN c_custkey % 4 = 0 THEN 'OK' ELSE 'BAD' END AS status FROM customer")
def dxf_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings, told by their name, that are sound, lack their end mark, a section's end, or have a line too many."""
    files = _files(spark, sf_dir, _dxf, 4).withColumn("path", F.concat("path", F.lit(".DXF")))
    return validate.verdicts(files).select(F.regexp_extract("path", "[0-9]+", 0).cast("bigint").alias("id"), "ext", "errcnt", "status")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 10 END AS errcnt FROM customer")
def sav_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistical data files, checked on request: sound, without the dictionary's end, of no known layout."""
    return _files(spark, sf_dir, _sav, 3).select(F.col("path").cast("bigint").alias("id"), validate.check_as("sav", F.col("content")).alias("errcnt"))


@query("SELECT 'even' AS folder, count(*) AS files, count(*) FILTER (WHERE c_custkey % 6 = 0) AS ok, count(*) FILTER (WHERE c_custkey % 6 <> 0) AS bad FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'odd', count(*), 0, count(*) FROM customer WHERE c_custkey % 2 = 1")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by status in two folders."""
    files = _files(spark, sf_dir, _gif, 6).withColumn("path", F.concat(F.when(F.col("path") % 2 == 0, "even/").otherwise("odd/"), "path"))
    return validate.folder_counts(validate.verdicts(files)).select("folder", "files", "ok", "bad")


_GIF = _VARIANTS["gif"][1]


@query(f"SELECT n_nationkey::BIGINT AS id, {_case('n_nationkey % 6', [n for n, _, _ in _GIF])}::INT AS errcnt, {_case('n_nationkey % 6', [s for *_, s in _GIF])} AS status FROM nation")
def arriving_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a stream over a folder that files were put into, up to what is there."""
    from wrackline.operators.recover import write_files
    from wrackline.plans.disk import _scratch
    from wrackline.streaming import watch

    @F.pandas_udf("binary")
    def made(ids):
        import pandas as pd

        return pd.Series([_gif(int(i), int(i) % 6) for i in ids])

    top = _scratch(spark)
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    write_files(keys.select(F.concat(F.col("k").cast("string"), F.lit(".gif")).alias("path"), F.lit(1_600_000_000).cast("bigint").alias("mtime"), made("k").alias("content")), f"{top}/in").collect()
    found = watch.arriving_verdicts(spark, f"file://{top}/in", per_trigger=7)
    done = found.writeStream.format("parquet").option("path", f"file://{top}/out").option("checkpointLocation", f"file://{top}/log").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"file://{top}/out").select(F.regexp_extract("path", "([0-9]+)[.]gif$", 1).cast("bigint").alias("id"), "errcnt", "status")


@query("SELECT 'copy' AS action, 'd/' || c_custkey AS source, 'bad/gif/' || c_custkey AS target FROM customer WHERE c_custkey % 6 <> 0")
def bad_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files with errors would be put aside."""
    files = _files(spark, sf_dir, _gif, 6).withColumn("path", F.concat(F.lit("d/"), "path"))
    return validate.bad_plan(validate.verdicts(files), "bad")


# ---- JPEG ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'intact' WHEN 3 THEN 'none' ELSE 'repaired' END AS action, CASE WHEN c_custkey % 4 < 3 THEN true END AS same FROM customer")
def jpeg_thumbnail_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG files without their first sector: of those with a thumbnail the main image has to come back."""

    def make(i: int, k: int) -> bytes:
        good, small = _jpg(i, 0), jpeg.make_jpeg(16, 16, [1, 2, 3, 4])
        return (good, b"\x2e" * 512 + good[2:], b"\x2e" * 512 + small[2:] + b"between" + good[2:], b"\x2e" * 1200)[k]

    @F.pandas_udf("boolean")
    def same(path, whole):
        import pandas as pd

        return pd.Series([None if w is None else w == _jpg(int(p), 0) for p, w in zip(path, whole)], dtype="boolean")

    fixed = repair.repaired_jpegs(_files(spark, sf_dir, make, 4), ("content",))
    return fixed.select(F.col("path").cast("bigint").alias("id"), "action", same("path", F.when(F.col("action") == "intact", F.col("content")).otherwise(F.col("repaired"))).alias("same"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 0 ELSE 96 END::BIGINT AS units, CASE WHEN c_custkey % 3 = 1 THEN 0 ELSE 96 END::BIGINT AS expected, CASE WHEN c_custkey % 3 <> 1 THEN 8 END AS lines, CASE WHEN c_custkey % 3 <> 1 THEN 12 END AS columns FROM customer")
def jpeg_scan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded units that decode, those there should be, and the size of the preview; a third has no frame."""

    def make(i: int, k: int) -> bytes:
        good = _jpg(i, 0)
        return good.replace(b"\xff\xc0", b"\xff\xef") if k == 1 else good

    seen = repair.scans(_files(spark, sf_dir, make, 3))
    lines = F.split("preview", "\n")
    return seen.select(F.col("path").cast("bigint").alias("id"), "units", "expected", F.size(lines).alias("lines"), F.char_length(F.get(lines, 0)).alias("columns")).withColumn("lines", F.when(F.col("columns").isNotNull(), F.col("lines")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 72 ELSE 96 END::BIGINT AS units, CASE WHEN c_custkey % 3 = 1 THEN 72 ELSE 96 END::BIGINT AS expected FROM customer")
def progressive_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded units of progressive images, first scans and refinements; a third has lost the last scan."""

    @_cycle(601 * 7)
    def make(i: int, k: int) -> bytes:
        blocks = [[(i * 7 + y * 31) % 601 - 300, *[(0, 0, 1, -1, 2, -3, 9)[(i + y * 5 + z * z) % 7] for z in range(15)]] for y in range(24)]
        whole = jpeg.make_progressive(48, 32, blocks)
        return whole[: whole.rindex(b"\xff\xda")] + b"\xff\xd9" if k == 1 else whole

    return repair.scan_health(_files(spark, sf_dir, make, 3)).select(F.col("path").cast("bigint").alias("id"), "units", "expected")


_RGB = ("p_partkey * 37 % 256", "p_partkey * 91 % 256", "p_partkey * 151 % 256")


@query(f"""
WITH c AS (SELECT * FROM (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(ansi.PALETTE))}) t(i, r, g, b)),
p AS (SELECT p_partkey, i, row_number() OVER (PARTITION BY p_partkey ORDER BY (r - {_RGB[0]})^2 + (g - {_RGB[1]})^2 + (b - {_RGB[2]})^2, i) AS place FROM part, c)
SELECT p_partkey AS id, max(i) FILTER (WHERE place = 1) AS best, max(i) FILTER (WHERE place = 2) AS second FROM p GROUP BY p_partkey""")
def palette_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two palette colours nearest to a colour per part."""
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ansi.nearest_colours(*[F.expr(x) for x in _RGB]).alias("c"))
    return found.select("id", F.col("c")[0].alias("best"), F.col("c")[1].alias("second"))


@query("SELECT c_custkey AS id, 8 AS lines, 96 AS cells FROM customer")
def color_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews in cells of a 16-colour terminal, a cell per block of the image."""
    seen = repair.previews(_files(spark, sf_dir, lambda i, k: _jpg(i, 0), 1), color=True)
    cells = F.regexp_extract_all("preview", F.lit("\\x1b\\[(4|10)[0-7]m\\x1b\\[[39][0-7]m[ ░▒▓█]"), F.lit(0))
    return seen.select(F.col("path").cast("bigint").alias("id"), F.size(F.split("preview", "\n")).alias("lines"), F.size(cells).alias("cells"))


# ---- run lists --------------------------------------------------------------------------------------------

#: Bytes after a sound run of 10 clusters at 5 (3 bytes), the unit, the total that is meant, and what is found.
_LISTS: list[tuple[bytes, int, int, str | None, int, str]] = [
    (b"\0", 0, 10, None, -1, "GOOD"),
    (b"\0", 0, 11, None, -1, "BadSIZE"),
    (b"\x10\x05", 0, 10, "bad ssize", 3, "CantFIX"),
    (b"\x91" + bytes(20), 0, 10, "bad csize", 3, "CantFIX"),
    (b"\x22\x01", 0, 10, "overflow", 3, "CantFIX"),
    (b"\x11\x00\x05\0", 0, 10, "wrong size", 3, "CantFIX"),
    (b"\x11\x06\x20\0", 16, 16, "pad nonzero", 3, "CantFIX"),
    (b"\x01\x06\0", 16, 16, None, -1, "GOOD"),
    (b"\x01\x05\0", 16, 16, "pad mismatch", 3, "CantFIX"),
    (b"\x01\x06\x01\x06\0", 16, 16, "pad zero", 5, "CantFIX"),
    (b"\xff\xff\xff\xff", 0, 10, None, -1, "GOOD"),
]


@query(f"SELECT c_custkey AS id, {_case(f'c_custkey % {len(_LISTS)}', [x[3] for x in _LISTS])} AS error, {_case(f'c_custkey % {len(_LISTS)}', [x[4] for x in _LISTS])} AS error_at FROM customer WHERE c_custkey % {len(_LISTS)} <> {len(_LISTS) - 1}")
def run_list_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way in which a run list stops, with the place."""
    n = len(_LISTS)
    made = _made(table(spark, sf_dir, "customer").filter(F.col("c_custkey") % n != n - 1).select("c_custkey"), lambda r: {"id": r["c_custkey"], "raw": b"\x11\x0a\x05" + _LISTS[r["c_custkey"] % n][0], "unit": _LISTS[r["c_custkey"] % n][1]}, "id bigint, raw binary, unit int")
    return records.decode_run_lists(made, "raw", F.col("unit")).select("id", "decoded.error", "decoded.error_at")


#: A list of two units of 16 clusters, whole or broken: raw bytes, status, clusters.
_TWO = ntfs.encode_runs([(100, 10), (None, 6), (200, 12), (None, 4)])
_BROKEN: list[tuple[bytes, str, int]] = [
    (_TWO, "GOOD", 32),
    (ntfs.encode_runs([(100, 16)]), "BadSIZE", 16),
    (_TWO[:3] + b"\x71\x06" + _TWO[5:], "FIXED", 32),
    (_TWO[:3] + b"\x00\x06" + _TWO[5:], "FIXED", 32),
    (_TWO[:-1] + b"[ZoneTransfer]\r\n" + b"junk", "GOOD", 32),
    (_TWO[:3] + b"\x71\x77" + b"\x99" * 12, "CantFIX", 10),
]


@query(f"SELECT c_custkey AS id, {_case(f'c_custkey % {len(_BROKEN)}', [x[1] for x in _BROKEN])} AS status, {_case(f'c_custkey % {len(_BROKEN)}', [x[2] for x in _BROKEN])}::BIGINT AS total, c_custkey % {len(_BROKEN)} IN (2, 3) AS repaired FROM customer")
def run_list_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lists of compressed files, cut at foreign bytes and mended by one change where that makes them whole."""
    n = len(_BROKEN)
    made = _made(table(spark, sf_dir, "customer").select("c_custkey"), lambda r: {"id": r["c_custkey"], "raw": _BROKEN[r["c_custkey"] % n][0]}, "id bigint, raw binary")
    return records.decode_run_lists(made, "raw", 16, F.lit(32), repair=True).select("id", "decoded.status", "decoded.total", "decoded.repaired")


# ---- records and index blocks -----------------------------------------------------------------------------------


def _record_block(r: dict) -> dict:
    """Sound (0), second sector's number wrong (1), first one's (2), size off (3), more bytes used than there are (4)."""
    k = r["c_custkey"] % 5
    name = ntfs.resident(ntfs.NAME, ntfs.name_key(5, 1_600_000_000, 9, r["c_name"]))
    data = bytearray(ntfs.make_record(r["c_custkey"], [name, ntfs.nonresident(ntfs.DATA, [(50, 2)], 5000)]))
    if k in (1, 2):
        data[1022 if k == 1 else 510] ^= 1
    if k == 3:
        data[28:32] = (1000).to_bytes(4, "little")
    if k == 4:
        data[24:28] = (2000).to_bytes(4, "little")
    return {"image": "i", "fpos": 1024 * r["c_custkey"], "data": bytes(data)}


@query("""
SELECT c_custkey AS ref, 'strict' AS mode, c_name AS name FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'lenient', c_name FROM customer WHERE c_custkey % 5 < 3""")
def fixup_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with update sequences and sizes that fail, read strictly and leniently."""
    blocks = _made(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _record_block, BLOCK)
    modes = [records.file_records(blocks, m).select("ref", F.lit(m).alias("mode"), "name") for m in ("strict", "lenient")]
    return modes[0].unionByName(modes[1])


@query("SELECT c_custkey AS id, c_custkey % 5 < 3 AS strict, c_custkey % 5 < 3 AS lenient, false AS plausible, c_custkey AS ref, 1 AS flags FROM customer WHERE c_custkey % 5 <> 4 UNION ALL SELECT c_custkey, false, false, true, c_custkey, 1 FROM customer WHERE c_custkey % 5 = 4")
def record_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields and the strict, lenient and block-scan tests of the same blocks, natively."""
    blocks = _made(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _record_block, BLOCK)
    d = F.col("data")
    head = records.record_header(d)
    return blocks.select((F.col("fpos") / 1024).cast("bigint").alias("id"), records.sane_record(d).alias("strict"), records.sane_record(d, False).alias("lenient"), records.plausible_record(d).alias("plausible"), head["ref"].alias("ref"), head["flags"].cast("int").alias("flags"))


@query("SELECT c_custkey AS ref, CASE c_custkey % 3 WHEN 0 THEN 777 WHEN 1 THEN 4000 ELSE 12 END::BIGINT AS size, CASE c_custkey % 3 WHEN 0 THEN 'c' ELSE 'a' END AS name, CASE c_custkey % 3 WHEN 1 THEN 20 END::BIGINT AS lcn, CASE c_custkey % 3 WHEN 1 THEN 2 ELSE 0 END AS streams FROM customer")
def record_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of zero in names, two unnamed data, and a named stream that does not count."""

    def make(r: dict) -> dict:
        name = lambda size, text: ntfs.resident(ntfs.NAME, ntfs.name_key(5, 0, size, text))
        two = [ntfs.nonresident(ntfs.DATA, [(10, 2)], 5000), ntfs.nonresident(ntfs.DATA, [(20, 1)], 4000)]
        named = bytearray(two[0])
        named[9] = 3
        attrs = ([name(0, "a"), name(777, "b"), name(888, "c")], [name(9, "a"), *two], [name(12, "a"), bytes(named)])[r["c_custkey"] % 3]
        return {"image": "i", "fpos": 1024 * r["c_custkey"], "data": ntfs.make_record(r["c_custkey"], attrs)}

    found = records.file_records(_made(table(spark, sf_dir, "customer").select("c_custkey"), make, BLOCK))
    return found.select("ref", "size", "name", F.get("runs", 0)["lcn"].alias("lcn"), "streams")


@query("SELECT c_custkey AS ref, m AS mode FROM customer, (VALUES ('strict'), ('off')) t(m) WHERE c_custkey % 3 = 0 OR m = 'off'")
def index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index blocks that are sound, whose entries leave the block, and whose update sequence fails; also read without it."""

    def make(r: dict) -> dict:
        data = bytearray(ntfs.make_index([(r["c_custkey"], ntfs.name_key(5, 0, 1, r["c_name"]))]))
        if r["c_custkey"] % 3 == 1:
            data[28:32] = (5000).to_bytes(4, "little")
        if r["c_custkey"] % 3 == 2:
            data[1022] ^= 1
        return {"image": "i", "fpos": 4096 * r["c_custkey"], "data": bytes(data)}

    blocks = _made(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), make, BLOCK)
    modes = [records.index_rows(blocks, m).select("ref", F.lit(m).alias("mode")) for m in ("strict", "off")]
    return modes[0].unionByName(modes[1])


_TOP = 100_000_000


def _folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as directories: every third record is deleted, every fourth index entry has another name."""

    def record(r: dict) -> dict:
        k = r["c_custkey"]
        name = ntfs.resident(ntfs.NAME, ntfs.name_key(_TOP, 0, 0, r["c_name"], 1, ntfs.DIRECTORY_KEY))
        place = ntfs.nonresident(ntfs.INDEX_ALLOCATION, [(k, 1)], 4096)
        return {"image": "i", "fpos": 1024 * k, "data": ntfs.make_record(k, [name, place], 2 if k % 3 == 0 else 3)}

    def entry(r: dict) -> dict:
        k = r["c_custkey"]
        key = ntfs.name_key(_TOP, 0, 0, "moved" if k % 4 == 0 else r["c_name"], 1, ntfs.DIRECTORY_KEY)
        child = ntfs.name_key(k, 0, 1, "child")
        return {"image": "i", "fpos": 4096 * (k + 7), "data": ntfs.make_index([(k, key), (1_000_000 + k, child)])}

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return records.file_records(_made(rows, record, BLOCK)), records.index_rows(_made(rows, entry, BLOCK))


@query("SELECT c_custkey AS ref, c_name AS known_name, 'moved' AS index_name FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 = 0")
def directory_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that index entries know under another name; deleted records are no conflict."""
    return catalogue.directory_conflicts(*_folders(spark, sf_dir)).select("ref", "known_name", "index_name")


@query("SELECT c_custkey AS ref, c_custkey * 4096 AS record_at, (c_custkey + 7) * 4096 AS index_at, 28672::BIGINT AS delta FROM customer WHERE c_custkey % 3 <> 0")
def index_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where directories in use should have their index, and where it was found."""
    return catalogue.index_offsets(*_folders(spark, sf_dir))


@query("SELECT c_custkey AS ref FROM customer WHERE c_custkey % 6 = 0")
def recoverable_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that may be copied, among others: 1 GiB on disk, compressed, empty, deleted, or with runs that do not add up."""

    def make(r: dict) -> dict:
        k = r["c_custkey"]
        clusters = (1 << 18) if k % 6 == 1 else 3
        data = bytearray(ntfs.nonresident(ntfs.DATA, [(50, clusters)], 0 if k % 6 == 3 else 9000, 4 if k % 6 == 2 else 0))
        if k % 6 == 5:
            data[40:48] = (8192).to_bytes(8, "little")
        name = ntfs.resident(ntfs.NAME, ntfs.name_key(5, 0, 0, r["c_name"]))
        return {"image": "i", "fpos": 1024 * k, "data": ntfs.make_record(k, [name, bytes(data)], 0 if k % 6 == 4 else 1)}

    found = records.file_records(_made(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), make, BLOCK))
    return catalogue.recoverable(found).select("ref")


@query("SELECT c_custkey AS number, CASE c_custkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'shifted' WHEN 2 THEN 'truncated' ELSE 'garbage' END AS state, CASE WHEN c_custkey % 4 < 2 THEN c_custkey END AS ref, CASE c_custkey % 4 WHEN 2 THEN 510 ELSE 0 END AS zeros FROM customer")
def record_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an extracted table that are in step, shifted by a sector, cut short by the next one, or garbage."""

    def make(r: dict) -> dict:
        k = r["c_custkey"]
        whole = ntfs.make_record(k, [ntfs.resident(ntfs.NAME, ntfs.name_key(5, 0, 9, r["c_name"]))])
        data = (whole + bytes(512), bytes(512) + whole, bytes(512) + whole[:512] + whole[:512], b"\x2e" * 1536)[k % 4]
        return {"image": "i", "fpos": 1024 * k, "data": data}

    rows = records.resynced(_made(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), make, BLOCK))
    parsed = records.file_records(rows).select("fpos", "ref")
    second = F.hex(F.substring("data", 513, 510))
    zeros = F.when((F.col("state") == "truncated") & (F.replace(second, F.lit("00"), F.lit("")) == ""), 510).otherwise(0)
    kept = rows.select("fpos", "number", "state", zeros.alias("zeros")).join(parsed, "fpos", "left")
    return kept.select("number", "state", F.when(F.col("state").isin("ok", "shifted"), F.col("ref")).alias("ref"), "zeros")


# ---- signatures -----------------------------------------------------------------------------------------------------

_DETAILS = ["#0 100/4096", "#774778414 416/1024 flags 0", "#774778414 2000/1024 flags 0", None, None, "v3.62", "", "%PDF-1.", None, None, None, None, None, None, None, None]
_PLAIN = [i for i, d in enumerate(_DETAILS) if d is not None and i != 7]


@query(f"SELECT doc_id, {_case(f'doc_id % {_N}', _DETAILS)} AS detail FROM documents WHERE doc_id % {_N} IN ({', '.join(map(str, _PLAIN))})")
def signature_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a signature's header tells: numbers, sizes, versions."""
    from wrackline.plans.blocks import _sectors

    hits = signatures.sector_hits(_sectors(spark, sf_dir)).filter(((F.col("fpos") / 512) % len(_HEADS)).isin(*_PLAIN))
    return hits.select((F.col("fpos") / 512).cast("bigint").alias("doc_id"), "detail")


_MAGICS: list[tuple[bytes, str | None]] = [(m, k) for m, k in signatures.BLOCK_MAGICS.items() if k != "$MFT"] + [
    (b"PK\3\4....[Content_Types].xml  word/", "DOCX"), (b"PK\3\4....", "ZIP"), (b"PK\3\4 [Content_Types].xm ppt/", "PPTX"), (b"PK\3\4 [Content_Types].xm workbook.xml", "XLSX"), (b"PK\3\4 NotationMetadata.xml", "MUSX"),
    (b"RIFF\0\0\0\0WEBPVP8", "WEBP"), (b"RIFF\0\0\0\0AVI ", "AVI"), (b"RIFF\0\0\0\0WAVE", "WAV"), (b"RIFF\0\0\0\0CDR9", "CDR"), (b"RIFF\0\0\0\0zzzz", "RIFF"), (b"ENIGMA BINARY FILE", "MUS"), (b"ENIGxx", "MUS???"), (b"MZ\x90\0", "EXE"), (b"MZ\0\x90", None),
    (b"....Standard Jet", "MDB"), (b".......**ACE**", "ACE"), (b"....ftypqt", "MP4"), (b"BM....", "BMP?"), (b"FLV\1", "FLV"), (b"CWS\7", "SWF.comp"), (b"FWS\7", "SWF"), (b"ID3\3", "MP3.ID3"), (b"nothing", None), (b"FILE", None),
]


@query(f"SELECT l_orderkey * 10 + l_linenumber AS id, kind FROM (SELECT *, {_case(f'(l_orderkey * 10 + l_linenumber) % {len(_MAGICS)}', [k for _, k in _MAGICS])} AS kind FROM lineitem) WHERE kind IS NOT NULL")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type that a block's first bytes announce, a block per line item."""
    heads = F.array(*[F.lit(bytearray(m.ljust(64, b"\0"))) for m, _ in _MAGICS])
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    rows = rows.select(F.lit("i").alias("image"), F.col("id").alias("fpos"), F.element_at(heads, (F.col("id") % len(_MAGICS)).cast("int") + 1).alias("data"))
    return signatures.block_hits(rows).select(F.col("fpos").alias("id"), "kind")


@query("""
SELECT 4096 * c_custkey AS fpos, CASE WHEN c_custkey % 2 = 0 THEN 'NTFS' ELSE 'MBR?' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN 4096 * c_custkey + (c_custkey % 1000) * 512 * 8 END AS mft_fpos, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 100 END AS total_sectors FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT 4096 * c_custkey + 512, 'MBR?', NULL, NULL FROM customer WHERE c_custkey % 5 = 0""")
def boot_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boot sectors with their geometry, two to a block at times."""

    def make(r: dict) -> dict:
        k = r["c_custkey"]
        b = bytearray(4096)
        if k % 2 == 0:
            b[3:7], b[11:13], b[13], b[0x28:0x30], b[0x30:0x38] = b"NTFS", (512).to_bytes(2, "little"), 8, (100 * k).to_bytes(8, "little"), (k % 1000).to_bytes(8, "little")
        if k % 3:
            b[510:512] = b"\x55\xaa"
        if k % 5 == 0:
            b[1022:1024] = b"\x55\xaa"
        return {"image": "i", "fpos": 4096 * k, "data": bytes(b)}

    found = signatures.boot_sectors(_made(table(spark, sf_dir, "customer").select("c_custkey"), make, BLOCK))
    return found.select("fpos", "kind", "mft_fpos", "total_sectors")


# ---- codecs ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS digest, CASE WHEN doc_id % 3 = 1 AND octet_length(encode(coalesce(text, ''))) > 0 THEN 'not enough data' WHEN doc_id % 3 = 2 AND octet_length(encode(coalesce(text, ''))) > 0 THEN 'missing pad' END AS error FROM documents")
def unit_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as compressed units put together from runs: whole, with clusters missing after the end, and with the pad missing."""

    def run(i: int, d: bytes) -> tuple[bytes, str | None]:
        parts: list[tuple[bytes | None, int]] = []
        for at in range(0, len(d), codecs.UNIT):
            packed = codecs.lznt1_compress(d[at : at + codecs.UNIT])
            n = -(-len(packed) // codecs.CLUSTER) * codecs.CLUSTER
            parts += [(packed.ljust(n, b"\0"), n), (None, codecs.UNIT - n)] if n < codecs.UNIT else [(d[at : at + codecs.UNIT].ljust(codecs.UNIT, b"\0"), codecs.UNIT)]
        size = len(d)
        if i % 3 == 2 and parts and parts[-1][0] is None:
            parts.pop()
        whole, wrong = codecs.reassemble(parts, size + (len(parts) * codecs.UNIT if i % 3 == 1 else 0), codecs.UNIT)
        return whole[:size], wrong

    docs = turned(table(spark, sf_dir, "documents"), run, "content binary, error string")
    return docs.select("doc_id", F.octet_length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("digest"), "error")


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, -1 AS used_of_broken, true AS zeros FROM documents WHERE octet_length(encode(coalesce(text, ''))) BETWEEN 1 AND 65536")
def unit_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units one after another, zeros between them, and a unit without a chunk's signature."""

    def run(i: int, d: bytes) -> tuple[bytes, int, bool]:
        packed = codecs.lznt1_compress(d)
        padded = packed.ljust(-(-len(packed) // codecs.CLUSTER) * codecs.CLUSTER, b"\0")
        whole = codecs.walk_units(bytes(codecs.UNIT) + padded)
        return whole[codecs.UNIT : codecs.UNIT + len(d)], codecs.lznt1_unit(b"\x01\x80" + d)[1], not any(whole[: codecs.UNIT])

    docs = table(spark, sf_dir, "documents").filter(F.octet_length(text_bytes(F.col("text"))).between(1, 65536))
    return turned(docs, run, "content binary, used int, zeros boolean").select("doc_id", F.md5("content").alias("digest"), F.col("used").alias("used_of_broken"), "zeros")


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through chains of document filters, one of four by id."""

    def run(i: int, d: bytes) -> tuple[bytes]:
        k = i % 4
        if k == 0:
            return (codecs.apply_filters(codecs.ascii85_encode(zlib.compress(d)), [b"/ASCII85Decode", b"/FlateDecode"]),)
        if k == 1:
            return (codecs.apply_filters(zlib.compress(d).hex().encode() + b">", [b"/ASCIIHexDecode", b"/FlateDecode", b"/DCTDecode"]),)
        if k == 2:
            return (codecs.apply_filters(codecs.lzw_encode(zlib.compress(d)), [b"/LZWDecode", b"/FlateDecode"]),)
        return (codecs.apply_filters(codecs.ascii85_encode(d), [b"/A85", b"/Unknown"]),)

    return turned(table(spark, sf_dir, "documents"), run, "content binary").select("doc_id", F.md5("content").alias("digest"))


# ---- times, names and plans ------------------------------------------------------------------------------------------------


def _summary(saved: int, created: int) -> bytes:
    ticks = lambda s: ((s + ntfs.EPOCH) * 10_000_000).to_bytes(8, "little")
    props = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"".join(k.to_bytes(4, "little") + at.to_bytes(4, "little") for k, at in ((13, 24), (12, 36)))
    return bytes(44) + (48).to_bytes(4, "little") + props + b"".join((64).to_bytes(4, "little") + ticks(t) for t in (saved, created))


def _dated(i: int, k: int) -> bytes:
    """An archive with two dates (0), one whose later date is none (1), a compound file (2), one saved too early (3), none (4)."""
    if k in (0, 1):
        day = f"20{10 + i % 10}-03-04T05:06:07Z"
        props = f'<p:x xmlns:p="u" xmlns:d="v"><d:created>2005-01-01T00:00:00Z</d:created><d:modified>{"20 nonsense" if k else day}</d:modified></p:x>'
        return archive.make_zip({"docProps/core.xml": props.encode()})
    if k in (2, 3):
        return ole.make_compound({"\x05SummaryInformation": _summary(1_400_000_000 + i if k == 2 else 5, 1_300_000_000)})
    return b"no document" * 40


_DATE = "epoch(make_timestamp(2010 + c_custkey % 10, 3, 4, 5, 6, 7))::BIGINT"


@query(f"SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN {_DATE} WHEN 1 THEN 1104537600 WHEN 2 THEN 1400000000 + c_custkey ELSE 77 END AS mtime, 'x' AS ext FROM customer")
def document_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time inside a document goes before that of the file."""
    files = _files(spark, sf_dir, _dated, 5)
    facts = match.file_facts(files.select(F.concat(F.lit("d/"), "path", F.lit(".X")).alias("path"), F.lit(1).cast("bigint").alias("size"), F.lit(77).cast("bigint").alias("mtime"), "content"))
    return facts.select(F.regexp_extract("path", "([0-9]+)", 1).cast("bigint").alias("id"), "mtime", "ext")


@query(f"SELECT c_custkey AS id, 'set_mtime' AS action, CASE c_custkey % 5 WHEN 0 THEN {_DATE} ELSE 1104537600 END AS mtime FROM customer WHERE c_custkey % 5 < 2")
def document_time_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose own date differs from the file's."""
    files = _files(spark, sf_dir, _dated, 5).select("path", F.lit(1).cast("bigint").alias("size"), F.lit(77).cast("bigint").alias("mtime"), "content")
    return match.document_time_plan(files).select(F.col("path").cast("bigint").alias("id"), "action", "mtime")


@query("SELECT 'set_mtime' AS action, c_name AS path, c_custkey AS mtime FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 = 0")
def catalogue_time_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times for files that are there under a catalogue name; the first entry of a path decides, orphans don't count."""
    c = table(spark, sf_dir, "customer")
    named = c.select(F.col("c_name").alias("path"), F.explode(F.array(F.lit(0), F.lit(5))).alias("later"), "c_custkey").select("path", (F.col("c_custkey") + F.col("later")).alias("mtime"), F.col("later").alias("ord"), (F.col("c_custkey") % 4 == 0).alias("orphan"))
    return match.time_plan(named, c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("path")))


@query("SELECT s_name AS target FROM supplier WHERE s_suppkey % 3 <> 0")
def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue names that no file has yet."""
    s = table(spark, sf_dir, "supplier").select(F.lit(1).alias("size"), F.col("s_name").alias("path"), F.col("s_name").alias("name"), F.lit(0).alias("mtime"), F.lit(0).alias("ord"), "s_suppkey")
    return match.candidates(s, s.filter("s_suppkey % 3 = 0").select("path")).select("target")


@query("SELECT 'rename' AS action, 'file' || c_custkey AS source, c_name AS target FROM customer WHERE c_custkey % 2 = 0")
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rename for each file with an entry of its size."""
    c = table(spark, sf_dir, "customer")
    files = c.select(F.concat(F.lit("file"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").alias("size"), F.lit(0).cast("bigint").alias("mtime"), F.lit("doc").alias("ext"))
    named = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("size"), F.lit("a.doc").alias("name"), F.col("c_name").alias("path"), F.lit(3).cast("bigint").alias("mtime"), F.lit(0).alias("ord"))
    return match.rename_plan(match.match_nearest(files, named))


@query("SELECT c_custkey AS pos, c_custkey - c_custkey % 8 + 7 - c_custkey % 8 AS best_key FROM customer WHERE c_custkey - c_custkey % 8 + 7 <= (SELECT max(c_custkey) FROM customer) AND c_custkey >= 8")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name to one file: eight files of a size, whose nearest names are in the reverse order of their keys."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).filter("k >= 8")
    last = c.agg(F.max("k").alias("last"))
    c = c.join(last, F.col("k") - F.col("k") % 8 + 7 <= F.col("last")).drop("last")
    files = c.selectExpr("concat('f', k) AS path", "k AS pos", "k - k % 8 AS size", "100 * (k % 8) AS mtime", "'doc' AS ext")
    named = c.selectExpr("k - k % 8 AS size", "concat('n', k, '.doc') AS name", "concat('n', k, '.doc') AS path", "100 * (7 - k % 8) AS mtime", "k AS ord")
    return match.match_greedy(files, named).select("pos", F.regexp_extract("best", "([0-9]+)", 1).cast("bigint").alias("best_key"))


_NAMES = ["Letter.doc", "LETTER.DOC", "Lett~1.doc", "a~b.doc", "levél.doc", "123.456"]


@query(f"SELECT c_custkey AS id, {_case('c_custkey % 6', [0, -3, -10, -5, 10, 0])} AS score FROM customer")
def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far names look like those that people give."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % 6).cast("int") + 1)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), catalogue.name_score(name).alias("score"))


# ---- inner tables -------------------------------------------------------------------------------------------------------------


def _inner(spark: SparkSession, sf_dir: str, make: Callable[[int, int], bytes], name: str) -> DataFrame:
    return validate.inner(_files(spark, sf_dir, make, 1), name).withColumn("id", F.col("path").cast("bigint"))


def _office(i: int, k: int) -> bytes:
    name = f"Tab{i}".encode()
    sheet = lambda kind, state: b"\x85\0" + (8 + len(name)).to_bytes(2, "little") + i.to_bytes(4, "little") + bytes([state, kind]) + bytes([len(name), 0]) + name
    book = b"\x09\x08\x10\x00" + b"\0\6\5\0" + bytes(12) + sheet(i % 3, i % 3) + b"\x0a\0\0\0"
    return ole.make_compound({"Workbook": book, "Other": _noise(i, 5000)})


@query("SELECT c_custkey AS id, name, CASE name WHEN 'Other' THEN 5000 ELSE 4096 END::BIGINT AS size FROM customer, (VALUES ('Workbook'), ('Other')) t(name)")
def ole_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a compound file."""
    return _inner(spark, sf_dir, _office, "ole_streams").select("id", F.element_at(F.split("name", "/"), -1).alias("name"), F.octet_length("content").cast("bigint").alias("size"))


@query("SELECT c_custkey AS id, c_custkey AS position, 'Tab' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'worksheet or dialog sheet' WHEN 1 THEN 'Excel 4.0 macro sheet' ELSE 'chart' END AS kind, CASE c_custkey % 3 WHEN 0 THEN 'visible' WHEN 1 THEN 'hidden' ELSE 'very hidden' END AS state FROM customer")
def xls_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of a workbook stream, with kind and state."""
    return _inner(spark, sf_dir, _office, "xls_sheets").select("id", "position", "name", "kind", "state")


@query("SELECT c_custkey AS id, name, sound FROM customer, (VALUES ('IHDR', true), ('IDAT', true), ('IEND', true)) t(name, sound) WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, name, sound FROM customer, (VALUES ('IHDR', false), ('IDAT', true), ('IEND', true)) t(name, sound) WHERE c_custkey % 2 = 1")
def png_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a PNG file and whether their checksums hold."""
    return _inner(spark, sf_dir, lambda i, k: _png(i, i % 2), "png_chunks").select("id", "name", "sound")


@query("SELECT c_custkey AS id, part, CASE WHEN part <> 'end' THEN 24 END AS w, CASE WHEN part <> 'end' THEN 16 END AS h FROM customer, (VALUES ('screen'), ('frame'), ('end')) t(part) WHERE part <> 'end'")
def gif_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen and frames of a GIF file."""
    return _inner(spark, sf_dir, lambda i, k: _gif(i, 0), "gif_blocks").filter("part IN ('screen', 'frame')").select("id", "part", "w", "h")


@query("SELECT c_custkey AS id, tag, CASE WHEN tag = 257 THEN 20 + c_custkey % 5 ELSE v END::BIGINT AS value FROM customer, (VALUES (256, 32), (257, 0), (258, 8), (259, 1), (262, 1), (277, 1)) t(tag, v)")
def tiff_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a TIFF directory and their first values."""
    rows = _inner(spark, sf_dir, lambda i, k: images.make_tiff(32, 20 + i % 5, _noise(i, 32 * (20 + i % 5))), "tiff_tags")
    return rows.filter("tag IN (256, 257, 258, 259, 262, 277)").select("id", "tag", F.get("ints", 0).alias("value"))


@query("SELECT c_custkey AS id, 1005 AS resource, 2::BIGINT AS size FROM customer")
def psd_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of a PSD file."""
    return _inner(spark, sf_dir, lambda i, k: _psd(i, 0), "psd_resources").select(F.col("path").cast("bigint").alias("id"), F.lit(1005).alias("resource"), "size")


@query("SELECT c_custkey AS id, marker, n::BIGINT AS n FROM customer, (VALUES ('SOI', 1), ('APP0', 1), ('DQT', 1), ('SOF0', 1), ('DHT', 2), ('SOS', 1), ('EOI', 1)) t(marker, n)")
def jpeg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a JPEG file, all of whose bytes are accounted for."""
    rows = _inner(spark, sf_dir, lambda i, k: _jpg(i, 0), "jpeg_segments").filter("parsed = size AND garbage = 0")
    return rows.groupBy("id", "marker").agg(F.count(F.lit(1)).alias("n"))


def _attached(i: int, k: int) -> bytes:
    inner = zlib.compress(b"1 0 2 9 << /Type /Page >>")
    text = b"hello %d" % i
    return pdf.make_pdf([
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R >>",
        b"<< /Type /EmbeddedFile /Length %d >>\nstream\n" % len(text) + text + b"\nendstream", b"<< /Type /Filespec /F (name%d.txt) /EF << /F 4 0 R >> >>" % i,
        b"<< /Type /ObjStm /N 2 /First 8 /Length %d /Filter /FlateDecode >>\nstream\n" % len(inner) + inner + b"\nendstream",
    ])


@query("SELECT c_custkey AS id, oid::BIGINT AS oid, type FROM customer, (VALUES (1, '/Catalog'), (2, '/Pages'), (3, '/Page'), (4, '/EmbeddedFile'), (5, '/Filespec'), (6, '/ObjStm')) t(oid, type)")
def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a PDF file by number and type."""
    return _inner(spark, sf_dir, _attached, "pdf_objects").select("id", "oid", "type")


@query("SELECT c_custkey AS id, 'name' || c_custkey || '.txt' AS name, 'hello ' || c_custkey AS content FROM customer")
def pdf_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files inside a PDF file."""
    return _inner(spark, sf_dir, _attached, "pdf_attachments").select("id", "name", F.decode("content", "UTF-8").alias("content"))


@query("SELECT c_custkey AS id, 0 AS errcnt, 2 AS pages, 1::BIGINT AS count, 8 AS objects, false AS encrypted, 1 AS attachments FROM customer")
def pdf_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, objects and attachments of a PDF file, those inside object streams included."""
    return validate.pdf_facts(_files(spark, sf_dir, _attached, 1)).select(F.col("path").cast("bigint").alias("id"), "errcnt", "pages", "count", "objects", "encrypted", "attachments")
