"""Codecs and content checks, on files made of texts and ids."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrackline.functions import archive, codecs, images, jpeg, ole, pdf
from wrackline.functions.memo import memo
from wrackline.operators import repair, validate
from wrackline.plans.common import made_files, table, text_bytes, turned

QUERIES: dict = {}
ORACLE_SQL: dict = {}


# ---- codecs: every text is encoded and decoded; length and digest are those of the text ----------------

_TRIPS: dict[str, Callable[[bytes], bytes]] = {
    "lznt1": lambda d: codecs.lznt1_decompress(codecs.lznt1_compress(d)),
    "lzw_msb": lambda d: codecs.lzw_decode(codecs.lzw_encode(d)),
    "lzw_gif": lambda d: codecs.gif_lzw_decode(codecs.gif_lzw_encode(d, 8), 8),
    "packbits": lambda d: codecs.packbits_decode(codecs.packbits_encode(d)),
    "inflate": lambda d: codecs.inflate(zlib.compress(d)),
    "a85": lambda d: codecs.ascii85_decode(codecs.ascii85_encode(d)),
    "asciihex": lambda d: codecs.ascii_hex_decode(d.hex().encode() + b">"),
}


def _trip(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        turn = _TRIPS[name]

        docs = turned(table(spark, sf_dir, "documents"), lambda i, d: (turn(d),), "d binary")
        return docs.select("doc_id", F.octet_length("d").cast("bigint").alias("n_bytes"), F.md5("d").alias("digest"))

    run.__name__, run.__doc__ = f"{name}_roundtrip", f"Every text through {name} and back."
    return run


for _name in _TRIPS:
    QUERIES[f"{_name}_roundtrip"] = _trip(_name)
    ORACLE_SQL[f"{_name}_roundtrip"] = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents"


# ---- checks: a file per document; every fifth is damaged in one known way --------------------------------


#: Ids that differ by a multiple of this have the same noise.
NOISE = 256


def _noise(i: int, n: int) -> bytes:
    return _noise_of(i % NOISE, n)


@memo(4096)
def _noise_of(i: int, n: int) -> bytes:
    return bytes((i * 7919 + j * j * 31 + (j >> 3) * i) & 255 for j in range(n))


def _png(i: int, bad: bool) -> bytes:
    good = images.make_png(32, 24, b"".join(b"\0" + _noise(i + y, 32) for y in range(24)))
    return good[:29] + bytes([good[29] ^ 1]) + good[30:] if bad else good  # in the checksum of the header


def _gif(i: int, bad: bool) -> bytes:
    return images.make_gif(24, 16, _noise(i, 384), trailer=b"\x77" if bad else b";")


def _tif(i: int, bad: bool) -> bytes:
    scheme = (images.RAW, images.LZW, images.PACKBITS, images.DEFLATE)[i // 5 % 4]
    return images.make_tiff(32, 24 + bad, _noise(i, 768), scheme)


def _zip(i: int, bad: bool) -> bytes:
    body = b"<a>" + b"text %d " % i * 300 + (b"" if bad else b"</a>")
    return archive.make_zip({"[Content_Types].xml": b"<t>" + b"x" * 1500 + b"</t>", "word/document.xml": body, "small.txt": b"s"})


def _wmf(i: int, bad: bool) -> bytes:
    return images.make_wmf([_noise(i, 20)] * 20) + (b"x" if bad else b"")


def _psd(i: int, bad: bool) -> bytes:
    return images.make_psd(32, 24, [_noise(i + y, 32) for y in range(24)], rle=bool(i & 1)) + (b"x" if bad else b"")


def _pdf(i: int, bad: bool) -> bytes:
    stream = zlib.compress(b"BT %d ET " % i * 40)
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream"]
    return pdf.make_pdf(bodies, startxref=not bad)


def _jpg(i: int, bad: bool) -> bytes:
    good = jpeg.make_jpeg(64, 48, [int(v) * 7 - 890 for v in _noise(i, 48)])
    return good[:2] + good if bad else good


def _ole(i: int, bad: bool) -> bytes:
    good = ole.make_compound({"WordDocument": _noise(i, 5000), "1Table": _noise(i + 1, 300)})
    return good[:600] if bad else good


#: Format to its maker, the errors of a damaged file, and the extension that is reported.
_FORMATS: dict[str, tuple[Callable[[int, bool], bytes], int, str]] = {
    "png": (_png, 1, "png"), "gif": (_gif, 20, "gif"), "tif": (_tif, 1, "tif"), "zip": (_zip, 1, "docx"), "wmf": (_wmf, 1, "wmf"), "psd": (_psd, 10, "psd"), "pdf": (_pdf, 10, "pdf"), "jpeg": (_jpg, 10, "jpg"), "ole": (_ole, 10, "doc"),
}


def _files(spark: SparkSession, sf_dir: str, make: Callable[[int, bool], bytes]) -> DataFrame:
    return made_files(table(spark, sf_dir, "documents").select("doc_id"), lambda i: make(i, i % 5 == 0))


def _verdict(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = validate.verdicts(_files(spark, sf_dir, _FORMATS[kind][0]))
        return found.select(F.col("path").cast("bigint").alias("doc_id"), "ext", "errcnt", "status")

    run.__name__, run.__doc__ = f"{kind}_verdict", f"A {kind} file per document, every fifth damaged, through the dispatcher and its check."
    return run


for _kind, (_, _errors, _ext) in _FORMATS.items():
    QUERIES[f"{_kind}_verdict"] = _verdict(_kind)
    _bad_ext = "ole" if _kind == "ole" else _ext
    ORACLE_SQL[f"{_kind}_verdict"] = f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '{_bad_ext}' ELSE '{_ext}' END AS ext, CASE WHEN doc_id % 5 = 0 THEN {_errors} ELSE 0 END AS errcnt, CASE WHEN doc_id % 5 = 0 THEN 'BAD' ELSE 'OK' END AS status FROM documents"


def verdict_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts themselves through the dispatcher: short ones are small, the others of no known format."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), text_bytes(F.col("text")).alias("content"))
    return validate.verdicts(docs).select(F.col("path").cast("bigint").alias("doc_id"), "ext", "errcnt", "status")


QUERIES["verdict_dispatch"] = verdict_dispatch
ORACLE_SQL["verdict_dispatch"] = "SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) < 256 THEN 'small' ELSE '???' END AS ext, -1 AS errcnt, 'DUNNO' AS status FROM documents"


def jpeg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG files of which every fifth is sound and the others have lost their first sector."""
    files = _files(spark, sf_dir, lambda i, keep: _jpg(i, False) if keep else b"\x2e" * 512 + _jpg(i, False)[2:])
    fixed = repair.repaired_jpegs(files)
    again = validate.check_as("jpg", F.col("repaired"))
    return fixed.select(F.col("path").cast("bigint").alias("doc_id"), "action", F.when(F.col("repaired").isNotNull(), again).otherwise(-1).alias("errcnt"))


QUERIES["jpeg_repair"] = jpeg_repair
ORACLE_SQL["jpeg_repair"] = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'intact' ELSE 'repaired' END AS action, CASE WHEN doc_id % 5 <> 0 THEN 0 ELSE -1 END AS errcnt FROM documents"


def zip_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an archive per document, as a table."""
    rows = validate.inner(_files(spark, sf_dir, lambda i, bad: _zip(i, False)), "zip_members")
    return rows.select(F.col("path").cast("bigint").alias("doc_id"), "name", "size")


QUERIES["zip_listing"] = zip_listing
ORACLE_SQL["zip_listing"] = """
SELECT doc_id, name, CASE name WHEN 'small.txt' THEN 1 WHEN '[Content_Types].xml' THEN 1507 ELSE 7 + 300 * (6 + length(doc_id::VARCHAR)) END::BIGINT AS size
FROM documents, (VALUES ('[Content_Types].xml'), ('word/document.xml'), ('small.txt')) t(name)"""


def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of a JPEG file per document; damaged ones have a second start."""
    rows = validate.marker_histogram(_files(spark, sf_dir, _jpg))
    return rows.select(F.col("path").cast("bigint").alias("doc_id"), "marker", "n")


QUERIES["marker_counts"] = marker_counts
ORACLE_SQL["marker_counts"] = """
SELECT doc_id, marker, CASE WHEN marker = 'SOI' AND doc_id % 5 = 0 THEN 2 ELSE n END::BIGINT AS n
FROM documents, (VALUES ('SOI', 1), ('APP0', 1), ('DQT', 1), ('SOF0', 1), ('DHT', 2), ('SOS', 1), ('EOI', 1)) t(marker, n)"""
