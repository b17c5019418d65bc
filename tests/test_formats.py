"""Integrity checks: sound files score 0 and mutations score as they should."""

from __future__ import annotations

import random
import zlib

import pytest

from wrackline.functions import ansi, archive, dates, images, jpeg, ole, pdf, tables
from wrackline.operators import repair, validate

RNG = random.Random(1)
NOISE = bytes(RNG.randrange(256) for _ in range(64 * 64))


def flip(data: bytes, at: int) -> bytes:
    return data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]


def test_png():
    raw = b"".join(b"\0" + NOISE[64 * y : 64 * (y + 1)] for y in range(64))
    good = images.make_png(64, 64, raw)
    assert images.check_png(good) == 0 and images.check_png(good + b"tail") == 0
    assert images.check_png(flip(good, 100)) >= 1 and images.check_png(good[:-12]) >= 1 and images.check_png(good[:300]) >= 10
    assert images.check_png(images.make_png(64, 63, raw)) == 1
    for w in (1, 3, 5, 17):
        for h in (1, 4, 8, 13):
            for depth in (1, 4, 8):
                size = images.png_raw_size(w, h, depth, True)
                assert images.check_png(images.make_png(w, h, bytes(size), depth, 0, 1)) == 0
                if depth == 8 and w >= 5:
                    assert size == images.png_raw_size(w, h, depth, True, compat=True)


def test_gif():
    good = images.make_gif(40, 30, NOISE[:1200])
    assert images.check_gif(good) == 0 and images.check_gif(good[:-1]) == 0
    assert images.check_gif(good[:-1] + b"\x77") == 20
    assert images.check_gif(b"GIF89a" + (9000).to_bytes(2, "little") + good[8:]) == 10
    assert images.check_gif(b"GIF00a" + good[6:]) == 100 and images.check_gif(good[:800]) == 100
    assert images.check_gif(images.make_gif(41, 30, NOISE[:1200])) == 1


@pytest.mark.parametrize("scheme", [images.RAW, images.LZW, images.PACKBITS, images.DEFLATE])
@pytest.mark.parametrize("rows", [None, 7])
def test_tiff(scheme, rows):
    good = images.make_tiff(40, 30, NOISE[:1200], scheme, rows)
    assert images.check_tiff(good) == 0
    assert images.check_tiff(images.make_tiff(40, 31, NOISE[:1200], scheme, rows)) == 1
    assert images.check_tiff(b"XX" + good[2:]) == 100 and images.check_tiff(good[:8] + bytes(300)) == 10


def test_tiff_loops_end():
    good = images.make_tiff(40, 30, NOISE[:1200])
    at = 8 + 2 + 12 * 9
    assert images.check_tiff(good[:at] + (8).to_bytes(4, "little") + good[at + 4 :]) == 10


def test_wmf_and_psd():
    good = images.make_wmf([bytes(20)] * 30)
    assert images.check_wmf(good) == 0 and images.check_wmf(good + b"x") == 1
    assert images.check_wmf(good[:40] + b"\xff\xff" + good[42:]) == 2 and images.check_wmf(good[:40] + bytes(4) + b"\1" + good[45:]) == 1
    rows = [NOISE[64 * y : 64 * y + 64] for y in range(40)]
    for rle in (False, True):
        psd = images.make_psd(64, 40, rows, rle)
        assert images.check_psd(psd) == 0 and images.check_psd(psd + b"x") == 10
        assert images.check_psd(psd[:5] + b"\2" + psd[6:]) == 100
    with pytest.raises(images.Unreadable):
        images.check_psd(psd[:40])
    assert images.check_psd(images.make_psd(65, 40, rows, True)) == 20  # ten wrong rows, and the rest is not looked at
    assert images.check_psd(images.make_psd(64, 40, [*rows[:-1], rows[0][:60]], True)) == 1


def office(core: str = "2021-03-04T05:06:07Z") -> bytes:
    body = "<a>" + "text " * 400 + "</a>"
    props = f'<p:x xmlns:p="u" xmlns:d="v"><d:created>2020-01-01T00:00:00Z</d:created><d:modified>{core}</d:modified><d:t>words</d:t></p:x>'
    return archive.make_zip({"[Content_Types].xml": body.encode(), "word/document.xml": body.encode(), "docProps/core.xml": props.encode()})


def test_zip_and_dates():
    good = office()
    assert archive.check_zip(good) == (0, "docx")
    assert archive.check_zip(good[: len(good) // 2]) == (10, "zip")
    bad = archive.make_zip({"xl/styles.xml": b"<a>" + b"x" * 2000, "big.bin": NOISE})
    assert archive.check_zip(bad) == (1, "xlsx")
    assert archive.check_zip(flip(archive.make_zip({"big.bin": NOISE}, 0), 500)) == (1, "zip")
    assert dates.document_time(good) == 1614834367 and dates.document_time(office("nonsense")) == 1577836800
    assert dates.iso_time("2021-03-04T05:06:07+01:00") == 1614830767


def summary(saved: int, created: int) -> bytes:
    ticks = lambda s: ((s + 11_644_473_600) * 10_000_000).to_bytes(8, "little")
    props = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"".join(k.to_bytes(4, "little") + at.to_bytes(4, "little") for k, at in ((13, 24), (12, 36)))
    return bytes(44) + (48).to_bytes(4, "little") + props + b"".join((64).to_bytes(4, "little") + ticks(t) for t in (saved, created))


def test_ole():
    book = b"\x09\x08\x10\x00" + b"\0\6\5\0" + bytes(12) + b"\x85\0\x0c\0" + bytes(4) + b"\0\1" + b"\4\0Tab1" + b"\x0a\0\0\0"
    good = ole.make_compound({"Workbook": book, "\x05SummaryInformation": summary(1_500_000_000, 1_400_000_000), "Other": NOISE})
    f = ole.CompoundFile(good)
    assert [e.name for e in f.streams()] == ["Workbook", "\x05SummaryInformation", "Other"] and f.read(f.find("Other"))[: len(NOISE)] == NOISE
    assert ole.workbook_sheets(f.read(f.find("Workbook"))) == ([{"position": 0, "name": "Tab1", "kind": "Excel 4.0 macro sheet", "state": "visible"}], 1)
    assert validate.check_ole(good) == (0, "xls") and validate.check_ole(good[:700]) == (10, "ole")
    fat = good.rindex(b"\xfd\xff\xff\xff")
    assert validate.check_ole(good[: fat - fat % 512] + b"\0" * 512 + good[fat - fat % 512 + 512 :])[0] >= 1
    assert dates.document_time(good) == 1_500_000_000 and dates.document_time(ole.make_compound({"\x05SummaryInformation": summary(-11_644_473_600, 5)})) is None


def document() -> bytes:
    z = zlib.compress(b"1 0 2 9 << /Type /Page >>")
    return pdf.make_pdf(
        [
            b"<< /Type /Catalog /Pages 2 0 R >>",
            b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
            b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Note (a \\(b\\) c) >>",
            b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(zlib.compress(b"q Q" * 50)) + zlib.compress(b"q Q" * 50) + b"\nendstream",
            b"<< /Type /EmbeddedFile /Length 5 >>\nstream\nhello\nendstream",
            b"<< /Type /Filespec /F (name.txt) /EF << /F 5 0 R >> >>",
            b"<< /Type /ObjStm /N 2 /First 8 /Length %d /Filter /FlateDecode >>\nstream\n" % len(z) + z + b"\nendstream",
        ]
    )


def test_pdf():
    good = document()
    got = pdf.parse(good)
    assert got.errors == 0, got.notes
    facts = pdf.facts(good)
    assert (facts["pages"], facts["count"], facts["objects"]) == (2, 1, 9) and facts["attachments"] == [[b"hello", "name.txt"]]
    assert pdf.check_pdf(good.replace(b"%%EOF", b"")) >= 5 and pdf.check_pdf(good.replace(b"startxref", b"startxxxx")) >= 10
    assert pdf.check_pdf(b"x" * 3000) == 99 and pdf.check_pdf(good + b"x" * 5000) == 1
    assert pdf.check_pdf(good.replace(b"0000000015 00000 n", b"0000009999 00000 n")) == 1
    z = zlib.compress(b"q Q" * 50)
    assert pdf.check_pdf(good.replace(z, b"\0" * len(z))) == 1
    assert pdf.check_pdf(good.replace(b"trailer", b"trailxx")) >= 1
    assert pdf.values([b"/A", b"[", 1, 2, b"]", b"/B", 3, 0, b"R", b"/C"], b"/B") == [3, 0, b"R"]
    for cut in range(0, len(good), 37):
        pdf.check_pdf(good[:cut]), pdf.check_pdf(good[cut:])


def picture() -> bytes:
    return jpeg.make_jpeg(64, 48, [RNG.randint(-900, 900) for _ in range(48)])


def test_jpeg():
    good = picture()
    assert jpeg.check_jpeg(good) == 0
    assert jpeg.decode(good)[1] == [(48, 48)] and len(jpeg.preview(good).splitlines()) == 6
    assert jpeg.check_jpeg(good[:2] + good) == 10 and jpeg.check_jpeg(good[:-2]) == 10
    assert jpeg.check_jpeg(good[:2] + b"junk" + good[2:]) == 5
    assert jpeg.check_jpeg(good + b"\0\0" + good) == 0 and jpeg.check_jpeg(good + good[:2] + good) == 10
    at = good.index(b"\xff\xc0")
    assert jpeg.check_jpeg(good[: at + 5] + b"\0\1" + good[at + 7 :]) == 1
    table = good.index(b"\xff\xdb")
    assert jpeg.check_jpeg(good[: table + 2] + b"\0\x45" + good[table + 4 : table + 69] + b"\0\0" + good[table + 69 :]) == 10
    for cut in range(0, len(good), 5):
        jpeg.check_jpeg(good[:cut]), jpeg.check_jpeg(good[cut:]), jpeg.decode(good[:cut]), jpeg.repair_jpeg(good[cut:])


def test_jpeg_repair():
    good = picture()
    assert jpeg.repair_jpeg(good)["action"] == "intact"
    lost = b"\x11" * 512 + good[2:]
    got = jpeg.repair_jpeg(lost)
    assert got["action"] == "repaired" and got["start"] == 512 and jpeg.check_jpeg(got["repaired"]) == 0
    # The thumbnail's own image ends before the main one starts, which is what counts.
    both = jpeg.repair_jpeg(b"\0" * 512 + good[2:] + b"between" + good[2:])
    assert both["action"] == "repaired" and both["start"] == 512 + len(good) - 2 + 7 and both["repaired"] == good
    assert jpeg.repair_jpeg(b"\0" * 512 + good[2:] + b"\xff\xda\xff\xd9")["start"] == 512
    assert jpeg.repair_jpeg(b"\0" * 2000)["action"] == "none"


def test_verdicts_and_tables(spark):
    files = [("a/x.png", images.make_png(64, 64, bytes(65 * 64), level=0)), ("a/x.gif", images.make_gif(40, 30, NOISE[:1200])), ("a/x.tif", images.make_tiff(40, 30, NOISE[:1200])), ("a/x.zip", office())]
    files += [("b/x.psd", images.make_psd(64, 40, [bytes(64)] * 40)), ("b/x.jpg", picture() + bytes(200)), ("b/x.pdf", document()), ("b/x.wmf", images.make_wmf([bytes(20)] * 30))]
    files += [("c/small", b"tiny"), ("c/odd", b"?" * 900), ("c/bad.psd", images.PSD_MAGIC + b"\0\1" + bytes(300)), ("c/none", None), ("c/cut.png", files[0][1][:400]), ("c/d.dxf", b"0\n" * 400)]
    table = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in files], "path string, content binary")
    got = {r.path: (r.errcnt, r.ext, r.status) for r in validate.verdicts(table).collect()}
    assert len(got) == len(files)
    for p, ext in (("a/x.png", "png"), ("a/x.gif", "gif"), ("a/x.tif", "tif"), ("a/x.zip", "docx"), ("b/x.psd", "psd"), ("b/x.jpg", "jpg"), ("b/x.pdf", "pdf"), ("b/x.wmf", "wmf")):
        assert got[p] == (0, ext, "OK"), (p, got[p])
    assert got["c/small"] == (-1, "small", "DUNNO") and got["c/odd"] == (-1, "???", "DUNNO") and got["c/none"][2] == "DUNNO" and got["c/d.dxf"] == (10, "dxf", "BAD")
    assert got["c/bad.psd"][2] in ("ERROR", "BAD") and got["c/cut.png"][2] == "BAD"
    counts = {r.folder: (r.files, r.ok, r.bad + r.error) for r in validate.folder_counts(validate.verdicts(table)).collect()}
    assert counts["a"] == (4, 4, 0) and counts["c"][0] == 6
    for name in validate.TABLES:
        assert validate.inner(table, name).count() >= (0 if name in ("ole_streams", "xls_sheets", "jpeg_pictures") else 1), name
    assert {r.name for r in validate.inner(table, "zip_members").collect()} == {"[Content_Types].xml", "word/document.xml", "docProps/core.xml"}
    validate.register_tables(spark)
    table.createOrReplaceTempView("files")
    assert spark.sql("SELECT t.name FROM files, LATERAL png_chunks(content) t WHERE path = 'a/x.png'").count() == 3
    assert validate.pdf_facts(table.filter("path = 'b/x.pdf'")).first().pages == 2
    assert {r.marker: r.n for r in validate.marker_histogram(table).collect()}["SOI"] == 1
    fixed = repair.repaired_jpegs(spark.createDataFrame([("l.jpg", bytearray(b"\x11" * 512 + picture()[2:])), ("n", None)], "path string, content binary"))
    assert {r.path: r.action for r in fixed.collect()} == {"l.jpg": "repaired", "n": "none"} and repair.rename_originals(fixed).count() == 1
    assert [tuple(r)[1:] for r in repair.scan_health(table.filter("path = 'b/x.jpg'")).collect()] == [(48, 48)]
    assert repair.previews(table.filter("path = 'b/x.jpg'")).first().preview


def test_streamed_verdicts(spark, tmp_path):
    from wrackline.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(picture() + bytes(300))
    (tmp_path / "in/b.txt").write_bytes(b"short")
    query = watch.arriving_verdicts(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.status for r in spark.sql("SELECT * FROM seen").collect()) == ["DUNNO", "OK"]
    kinds = watch.arriving_kinds(spark, str(tmp_path / "in"))
    assert kinds.isStreaming and kinds.columns == ["window", "kind", "n"]


def test_cells_of_colours():
    assert ansi.mixed((0, 0, 0)) == (0, 4, 0) and ansi.cell((0, 0, 0)).endswith(" ")
    assert ansi.mixed((216, 216, 216))[0] == 15 and ansi.cell((216, 216, 216)).startswith("\x1b[107m")
    assert ansi.rgb_of(-2000) == (0, 0, 0) and ansi.rgb_of(0, 0, 0) == (128, 128, 128) and ansi.rgb_of(0, 0, 800)[0] == 255
    back, front, shade = ansi.mixed((60, 60, 60))
    assert {back, front} <= set(range(16)) and 0 <= shade < 5
    shown = jpeg.preview(picture(), color=True).splitlines()
    assert len(shown) == 6 and all(x.endswith(ansi.RESET) for x in shown)


def test_progressive_scans_and_their_refinements():
    rng = random.Random(4)
    blocks = [[rng.randint(-300, 300), *[rng.choice((0, 0, 1, -1, 2, -3, 9)) for _ in range(15)]] for _ in range(24)]
    good = jpeg.make_progressive(48, 32, blocks)
    d, scans = jpeg.decode(good)
    assert scans == [(24, 24)] * 4 and jpeg.check_jpeg(good) == 0
    assert [d.set_ac.get((1, i // 6, i % 6), 0) for i in range(24)] == [sum(1 << k for k, v in enumerate(b) if k and v) for b in blocks]
    assert [d.dc[1][i // 6, i % 6] for i in range(24)] == [b[0] >> 1 << 1 for b in blocks]
    broken = good[:-40] + b"\xff\xd9"
    assert jpeg.decode(broken)[1][3][0] < 24


def test_drawings_and_statistical_data():
    good = tables.make_dxf({"HEADER": [(9, "$X"), (1, "0")], "ENTITIES": [(0, "LINE"), (8, "0")]})
    assert tables.check_dxf(good) == 0 and tables.check_dxf(good.replace(b"\n", b"\r\n")) == 0
    assert {tables.check_dxf(x) for x in (b"", b"0\nEOF", good[:-8], good + b"0\nEOF\n", good.replace(b"SECTION", b"SECT", 1), b"\xff" * 300)} <= {0, 10}
    assert tables.check_dxf(good[:-8]) == 10 and tables.check_dxf(good + b"0\nLINE\n") == 10 and tables.check_dxf(good.replace(b"SECTION", b"SECT", 1)) == 10
    whole = tables.make_sav(["A", "B"], b"label")
    assert tables.check_sav(whole) == 0 and tables.check_sav(tables.make_sav(["A"])) == 0
    for cut in range(0, len(whole)):
        assert tables.check_sav(whole[:cut]) == 10
