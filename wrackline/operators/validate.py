"""Verdicts on recovered files, and their inner tables.

The first bytes choose the check by native predicates, so that files of no
known format never reach Python; checks run in Arrow batches, a file per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.functions import archive, images, jpeg, ole, pdf, tables
from wrackline.functions.bytesql import be, has

LEAST = 256
#: Inner rows are handed on once they have so many bytes.
BATCH_BYTES = 1 << 20
VERDICT = "errcnt int, ext string, status string"


def format_of(content: Column, name: Column) -> Column:
    """Name of the check that a file's first bytes (and for drawings its name) ask for."""
    rules = [
        ("small", F.octet_length(content) < LEAST),
        ("wmf", has(content, 0, images.WMF_MAGIC)),
        ("gif", has(content, 0, b"GIF87a") | has(content, 0, b"GIF89a")),
        ("png", has(content, 0, images.PNG_MAGIC)),
        ("tif", has(content, 0, images.TIFF_MAGIC[0]) | has(content, 0, images.TIFF_MAGIC[1])),
        ("zip", has(content, 0, b"PK\x03\x04")),
        ("psd", has(content, 0, images.PSD_MAGIC + b"\0\1")),
        ("ole", has(content, 0, ole.MAGIC)),
        ("jpg", has(content, 0, b"\xff\xd8\xff") & (be(content, 3, 1) >= 0xC0)),
        ("pdf", F.contains(F.decode(F.substring(content, 1, 32), "ISO-8859-1"), F.lit("%PDF-"))),
        ("dxf", F.lower(name).endswith(".dxf")),
    ]
    out: Column | None = None
    for kind, test in rules:
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("???")


def check_ole(data: bytes) -> tuple[int, str]:
    """1 for each oddity and each unreadable stream or workbook, 10 if it does not open."""
    try:
        f = ole.CompoundFile(data)
    except ole.OleError:
        return 10, "ole"
    errors, kind = len(f.issues), "ole"
    for e in f.streams():
        try:
            f.read(e)
        except ole.OleError:
            errors += 1
    for name, ext in (("Workbook", "xls"), ("Catalog", "db"), ("WordDocument", "doc"), ("PowerPoint Document", "ppt")):
        if f.find(name):
            kind = ext
    if book := f.find("Workbook"):
        try:
            ole.workbook_sheets(f.read(book))
        except ole.OleError:
            errors += 1
    return errors, kind


#: Check of each format, giving errors and extension; what is not here has no verdict.
CHECKS: dict[str, Callable[[bytes], tuple[int, str]]] = {
    "wmf": lambda d: (images.check_wmf(d), "wmf"),
    "gif": lambda d: (images.check_gif(d), "gif"),
    "png": lambda d: (images.check_png(d), "png"),
    "tif": lambda d: (images.check_tiff(d), "tif"),
    "zip": archive.check_zip,
    "psd": lambda d: (images.check_psd(d), "psd"),
    "ole": check_ole,
    "jpg": lambda d: (jpeg.check_jpeg(d), "jpg"),
    "pdf": lambda d: (pdf.check_pdf(d), "pdf"),
    "xml": lambda d: (archive.check_xml(d), "xml"),
    "dxf": lambda d: (tables.check_dxf(d), "dxf"),
    "sav": lambda d: (tables.check_sav(d), "sav"),  # on request only, see check_as
}


def verdict(kind: str, data: bytes) -> tuple[int | None, str, str]:
    """errcnt, ext, status; ERROR without a count where a check gives up."""
    check = CHECKS.get(kind)
    if check is None:
        return -1, kind, "DUNNO"
    try:
        errors, ext = check(data)
    except Exception:  # damaged input is the normal case here; it must never end a scan of a million files
        return None, kind, "ERROR"
    return errors, ext, "BAD" if errors > 0 else "OK" if errors == 0 else "DUNNO"


def _checked(kind: Column, content: Column) -> Column:
    @F.pandas_udf(VERDICT)
    def run(kinds, contents):
        import pandas as pd

        rows = [verdict(k, c) if isinstance(c, bytes | bytearray) else (None, k, "ERROR") for k, c in zip(kinds, contents)]
        out = pd.DataFrame(rows, columns=["errcnt", "ext", "status"])
        return out.astype({"errcnt": "Int32"})

    return run(kind, content)


def verdicts(files: DataFrame) -> DataFrame:
    """path, ext, errcnt, status of files (path, content).

    One pass: formats without a check, small files and null contents are
    settled natively and reach Python as a kind without content.
    """
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.coalesce(format_of(F.col("content"), name), F.lit("???"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, c in zip(b.column(1).to_pylist(), b.column(2)):
                rows.append((-1, k, "DUNNO") if k not in CHECKS else verdict(k, c.as_py()))
            errors, ext, status = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ext, pa.string()), pa.array(errors, pa.int32()), pa.array(status, pa.string())], names=["path", "ext", "errcnt", "status"])

    rows = files.select("path", kind.alias("kind"), "content")
    rows = rows.select("path", "kind", F.when(F.col("kind").isin(*CHECKS), F.col("content")).alias("content"))
    return rows.mapInArrow(run, "path string, ext string, errcnt int, status string")


def bad_plan(found: DataFrame, folder: str) -> DataFrame:
    """action, source, target: copies of files with errors, under their extension and name; never carried out."""
    name = F.element_at(F.split("path", "/"), -1)
    return found.filter("status = 'BAD'").select(F.lit("copy").alias("action"), F.col("path").alias("source"), F.concat_ws("/", F.lit(folder), "ext", name).alias("target"))


def check_as(kind: str, content: Column) -> Column:
    """errcnt of a content under one check, whatever its magic."""
    return _checked(F.lit(kind), content)["errcnt"]


def folder_counts(found: DataFrame) -> DataFrame:
    """files, and how many of each status, per folder."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return found.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "BAD", "DUNNO", "ERROR")])


# ---- inner tables -----------------------------------------------------------------------------------


def _guarded(rows: Callable[[bytes], Iterator[dict] | list[dict]]) -> Callable[[bytes], list[dict]]:
    """Rows up to the first one that cannot be read."""

    def run(data: bytes) -> list[dict]:
        out: list[dict] = []
        try:
            for r in rows(data):
                out.append(r)
        except Exception:
            pass
        return out

    return run


def _tiff_rows(d: bytes) -> Iterator[dict]:
    for at, tags, _ in images.tiff_directories(d):
        for t in tags:
            yield {"ifd": at, **t}


def _pdf_objects(d: bytes) -> list[dict]:
    got = pdf.parse(d)
    return got.objects if got else []


def _pdf_attachments(d: bytes) -> list[dict]:
    return [{"name": n, "content": c} for c, n in (pdf.facts(d) or {"attachments": []})["attachments"]]


def _ole_rows(d: bytes) -> Iterator[dict]:
    f = ole.CompoundFile(d)
    for e in f.streams():
        try:
            content = f.read(e)
        except ole.OleError:
            content = None
        yield {"name": e.path, "size": e.size, "content": content}


def _sheets(d: bytes) -> list[dict]:
    f = ole.CompoundFile(d)
    return ole.workbook_sheets(f.read(f.find("Workbook")))[0]


#: Table name to its columns and rows.
TABLES: dict[str, tuple[str, Callable[[bytes], Iterator[dict] | list[dict]]]] = {
    "zip_members": ("name string, size bigint, packed bigint, method int, encrypted boolean, content binary", archive.members),
    "ole_streams": ("name string, size bigint, content binary", _ole_rows),
    "xls_sheets": ("position bigint, name string, kind string, state string", _sheets),
    "png_chunks": ("at bigint, name string, size bigint, sound boolean", lambda d: ({"at": a, "name": n.decode("latin-1"), "size": len(b), "sound": s} for a, n, b, s in images.png_chunks(d))),
    "gif_blocks": ("at bigint, part string, label int, w int, h int, size bigint", lambda d: ({"at": p["at"], "part": p["part"], "label": p.get("label"), "w": p.get("w"), "h": p.get("h"), "size": len(p.get("data", b""))} for p in images.gif_parts(d))),
    "tiff_tags": ("ifd bigint, tag int, typ int, cnt bigint, ints array<bigint>, str string", _tiff_rows),
    "psd_resources": ("id int, name string, at bigint, size bigint", lambda d: images.psd_sections(d)["resources"]),
    "jpeg_segments": ("at bigint, marker string, size int, parsed int, garbage int", lambda d: ({"at": s.at, "marker": jpeg.marker_name(s.marker), "size": len(s.body), "parsed": s.parsed, "garbage": s.garbage} for s in jpeg.segments(d))),
    "jpeg_pictures": ("size bigint, offset bigint", lambda d: (p for s in jpeg.segments(d) if s.marker == jpeg.APP2 for p in jpeg.multi_picture(s.body))),
    "pdf_objects": ("oid bigint, at bigint, type string, stream bigint", _pdf_objects),
    "pdf_attachments": ("name string, content binary", _pdf_attachments),
}


def inner(files: DataFrame, name: str) -> DataFrame:
    """path and the rows of one inner table of each file."""
    from wrackline.operators.ntfs import _arrow

    ddl, rows = TABLES[name]
    ddl, make = f"path string, {ddl}", _guarded(rows)
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                for r in make(content.as_py() or b""):
                    found.append({"path": path, **r})
                    held += 100 + sum(len(v) for v in r.values() if isinstance(v, bytes))
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found, held = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)


def register_tables(spark) -> None:
    """Make every inner table a SQL table function: ``SELECT * FROM files, LATERAL zip_members(content)``."""
    from pyspark.sql.functions import udtf

    for name, (ddl, rows) in TABLES.items():
        spark.udtf.register(name, udtf(_table_class(ddl, rows), returnType=ddl))


def _table_class(ddl: str, rows) -> type:
    columns, make = [c.strip().split(" ")[0] for c in ddl.split(", ")], _guarded(rows)

    class Rows:
        def eval(self, content: bytes):
            for r in make(bytes(content or b"")):
                yield tuple(r.get(c) for c in columns)

    return Rows


def pdf_facts(files: DataFrame) -> DataFrame:
    """path, errcnt, pages, count, objects, encrypted, attachments of PDF files."""

    @F.pandas_udf("errcnt int, pages int, count bigint, objects int, encrypted boolean, attachments int")
    def run(content):
        import pandas as pd

        rows = []
        for c in content:
            got = pdf.facts(c or b"") or {}
            rows.append([got.get("errcnt", 99), got.get("pages"), got.get("count"), got.get("objects"), got.get("encrypted"), len(got["attachments"]) if got else None])
        return pd.DataFrame(rows, columns=["errcnt", "pages", "count", "objects", "encrypted", "attachments"]).astype({"pages": "Int32", "count": "Int64", "objects": "Int32", "attachments": "Int32", "encrypted": "boolean"})

    return files.select("path", run("content").alias("f")).select("path", "f.*")


def marker_histogram(files: DataFrame) -> DataFrame:
    """path, marker, n of JPEG files."""
    return inner(files, "jpeg_segments").groupBy("path", "marker").agg(F.count(F.lit(1)).alias("n"))
