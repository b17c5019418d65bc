"""Signatures, block types, maps and file tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wrackline.operators import blockstats, signatures
from wrackline.operators.validate import format_of
from wrackline.sources import files


def rows(spark, data):
    return spark.createDataFrame([("i", 512 * i, bytearray(d)) for i, d in enumerate(data)], "image string, fpos bigint, data binary")


SECTORS = [
    (b"INDX" + bytes(12) + (9).to_bytes(8, "little") + bytes(4) + (1000).to_bytes(4, "little") + (4072).to_bytes(4, "little"), ("INDX", 64)),
    (b"INDX" + bytes(24) + (5000).to_bytes(4, "little") + (4072).to_bytes(4, "little"), ("INDX", 0)),
    (b"FILE" + bytes(20) + (240).to_bytes(4, "little") + (1024).to_bytes(4, "little"), ("FILE", 128)),
    (b"FILE" + bytes(20) + (240).to_bytes(4, "little") + (1000).to_bytes(4, "little"), ("FILE", 0)),
    (b"PK\3\4\x14\0\0\0\x08\0" + bytes(8) + (7).to_bytes(4, "little") + (8).to_bytes(4, "little") + (5).to_bytes(2, "little") + b"\0\0a.txt", ("ZIP", 1)),
    (b"\xff\xd8\xff\xe1\0\x10Exif\0\0", ("JPEG", 2)),
    (b"\xff\xd8\xff\xf0\0\x10Exif\0\0", (None, 0)),
    (b"\0\0\0\x0fftypmp42", (None, 0)),
    (b"%PDF-1.8", (None, 0)),
]


def test_sector_signatures(spark):
    table = rows(spark, [s.ljust(512, b"\0") for s, _ in SECTORS])
    got = table.select("fpos", signatures.sector_signature(F.col("data")).alias("s")).orderBy("fpos").collect()
    assert [(r.s.kind, r.s.flag) for r in got] == [w for _, w in SECTORS]
    assert got[4].s.detail == "v20 method 8 7/8 a.txt" and got[0].s.detail.startswith("#9 1000/")
    assert signatures.sector_hits(table).count() == 6
    empty = rows(spark, [b"", b"P", b"\xff\xd8"])
    assert {r.s.kind for r in empty.select(signatures.sector_signature(F.col("data")).alias("s")).collect()} == {None}


BLOCKS = [
    (b"PK\3\4....[Content_Types].xml  word/", "DOCX"), (b"PK\3\4....", "ZIP"), (b"PK\3\4 [Content_Types].xm ppt/", "PPTX"), (b"PK\3\4 NotationMetadata.xml", "MUSX"), (b"RIFF\0\0\0\0WEBPVP8", "WEBP"), (b"RIFF\0\0\0\0zzzz", "RIFF"),
    (b"ENIGMA BINARY FILE", "MUS"), (b"ENIGxx", "MUS???"), (b"MZ\x90\0", "EXE"), (b"MZ\0\x90", None), (b"....Standard Jet", "MDB"), (b".......**ACE**", "ACE"), (b"....ftypqt", "MP4"), (b"BM....", "BMP?"), (b"x\x9c\xabV", "MP3"), (b"var x", "JS.var"), (b"\xde\x12\x04\x95", "MO"), (b"nothing", None), (b"", None),
]


def test_block_types(spark):
    got = rows(spark, [b for b, _ in BLOCKS]).select("fpos", signatures.block_type(F.col("data")).alias("k")).orderBy("fpos").collect()
    assert [r.k for r in got] == [k for _, k in BLOCKS]
    every = rows(spark, [m + bytes(60) for m in signatures.BLOCK_MAGICS])
    assert {r.k for r in every.select(signatures.block_type(F.col("data")).alias("k")).collect()} == set(signatures.BLOCK_MAGICS.values())
    assert signatures.block_hits(rows(spark, [b"FILE1234", b"GIF89a"])).count() == 1


def test_maps(spark):
    data = [bytes(512), b"\xff" * 512, b"\1\2\3\4" * 128, b"\1\2\3\4" * 127 + b"\1\2\3\5", b"%PDF-1.4".ljust(512, b"z")]
    table = rows(spark, data)
    assert [r.u for r in table.orderBy("fpos").select(blockstats.is_uniform(F.col("data")).alias("u")).collect()] == [True, True, True, False, False]
    stats = blockstats.buffer_stats(table, buffer=1024)
    assert [r.map for r in blockstats.heat_map(stats, columns=8, whole=2).collect()] == ["0."]
    assert [r.map for r in blockstats.heat_map(stats, columns=8, whole=None).collect()] == ["0.~"]
    use = blockstats.usage(stats).first()
    assert (use.bytes, use.sectors, use.used, use.used_percent) == (2560, 5, 2, 40.0)
    chars = [r.c for r in table.orderBy("fpos").select(blockstats.fingerprint_char(F.col("data")).alias("c")).collect()]
    assert chars[:3] == [".", "*", "0"]
    assert blockstats.xor_map(table, block=512, columns=2).orderBy("fpos").first().map == ".*"
    assert blockstats.xor_map(table, block=512, columns=2, limit=512).count() == 1


def test_boot_and_fat(spark):
    boot = bytearray(1024)
    boot[3:7], boot[510:512], boot[11:13], boot[13], boot[0x30] = b"NTFS", b"\x55\xaa", (512).to_bytes(2, "little"), 8, 200
    boot[1022:1024] = b"\x55\xaa"
    got = signatures.boot_sectors(rows(spark, [bytes(boot)])).orderBy("fpos").collect()
    assert [(r.fpos, r.kind, r.mft_fpos) for r in got] == [(0, "NTFS", 200 * 4096), (512, "MBR?", None)]
    record = b"PICTURE1JPG" + bytes(9) + (1).to_bytes(2, "little") + bytes(4) + (0xC8D8).to_bytes(2, "little") + (900).to_bytes(4, "little")
    fat = signatures.fat_entries(rows(spark, [record, b"\1" * 32])).collect()
    assert [(r.name, r.ext, r.cluster, r.size) for r in fat] == [("PICTURE1", "JPG", 65536 + 0xC8D8, 900)]


def test_file_tables(spark, tmp_path):
    (tmp_path / "f/sub").mkdir(parents=True)
    (tmp_path / "f/a.bin").write_bytes(b"abc")
    (tmp_path / "f/sub/b.bin").write_bytes(b"defg")
    got = {r.path.rsplit("/", 1)[1]: (r.size, bytes(r.content)) for r in files.recovered(spark, str(tmp_path / "f")).collect()}
    assert got == {"a.bin": (3, b"abc"), "b.bin": (4, b"defg")}
    (tmp_path / "list").write_text("0x1F00: 900 a b c name with blanks.doc\nbroken\n")
    assert [tuple(r) for r in files.carve_list(spark, str(tmp_path / "list")).collect()] == [(0x1F00, 900, "name with blanks.doc")]
    (tmp_path / "tags").write_text("256\t0100\tImageWidth\nbad\n257\t0101\tImageLength\n")
    names = files.tag_names(spark, str(tmp_path / "tags"))
    tags = spark.createDataFrame([(256,), (999,)], "tag int")
    assert sorted(tuple(r) for r in files.with_tag_names(tags, names).select("tag", "name").collect()) == [(256, "ImageWidth"), (999, "999")]
    files.write_catalogue(names, str(tmp_path / "cat"))
    assert files.catalogue(spark, str(tmp_path / "cat")).count() == 2


@pytest.mark.parametrize("content,name,kind", [(b"x", "a", "small"), (b"%PDF-1.4" + bytes(300), "a", "pdf"), (bytes(20) + b"%PDF-" + bytes(300), "a", "pdf"), (bytes(40) + b"%PDF-" + bytes(300), "a", "???"), (bytes(300), "A.DXF", "dxf"), (b"II*\0" + bytes(300), "a", "tif")])
def test_dispatch(spark, content, name, kind):
    row = spark.createDataFrame([(bytearray(content), name)], "c binary, n string")
    assert row.select(format_of(F.col("c"), F.col("n")).alias("k")).first().k == kind
