"""Which format a sector or block starts, by native predicates over its bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.functions.bytesql import be, contains_bytes, cut, has, latin, le

MFT, INDEX, DOCUMENT, PICTURE = 128, 64, 1, 2


def _ntfs_sizes(used: Column, size: Column) -> Column:
    return (used <= size) & size.between(1024, 16384) & (size % 512 == 0)


def sector_signature(data: Column) -> Column:
    """Struct of kind (null: none), flag and detail of a sector.

    ``flag`` is 128, 64, 1 (document) or 2 (picture), and 0 where the magic is
    known but its header is not one of a sound file.  Rows may carry bytes
    beyond the sector, of which only details make use.
    """
    num = lambda c: c.cast("string")
    used_i, size_i = le(data, 28, 4), le(data, 32, 4) + 24
    used_f, size_f = le(data, 24, 4), le(data, 28, 4)
    ole = le(data, 24, 4)
    free = (le(data, 3, 1) + 4).cast("int")
    box = F.when(cut(data, free, 4) == F.lit(bytearray(b"free")), free + be(data, free - 1, 1).cast("int")).otherwise(free)

    rules = [
        ("INDX", has(data, 0, b"INDX"), F.when(_ntfs_sizes(used_i, size_i), INDEX).otherwise(0), F.concat(F.lit("#"), num(le(data, 16, 4)), F.lit(" "), num(used_i), F.lit("/"), num(size_i))),
        ("FILE", has(data, 0, b"FILE"), F.when(_ntfs_sizes(used_f, size_f), MFT).otherwise(0), F.concat(F.lit("#"), num(le(data, 44, 4)), F.lit(" "), num(used_f), F.lit("/"), num(size_f), F.lit(" flags "), num(le(data, 22, 2)))),
        ("ZIP", has(data, 0, b"PK\x03\x04"), F.when((le(data, 8, 2) == 8) & (le(data, 4, 2) == 20), DOCUMENT).otherwise(0), F.concat(F.lit("v"), num(le(data, 4, 2)), F.lit(" method "), num(le(data, 8, 2)), F.lit(" "), num(le(data, 18, 4)), F.lit("/"), num(le(data, 22, 4)), F.lit(" "), F.decode(F.substring(data, F.lit(31), F.least(le(data, 26, 1), F.lit(480)).cast("int")), "ISO-8859-1"))),
        ("OLE2", has(data, 0, bytes.fromhex("D0CF11E0A1B11AE1")), F.when(ole.isin(0x3003B, 0x3003E, 0x4003E), DOCUMENT).otherwise(0), F.concat(F.lit("v"), num(le(data, 26, 1)), F.lit("."), num(le(data, 24, 1)))),
        ("RTF", has(data, 0, b"{\\rtf1\\a"), F.lit(DOCUMENT), F.lit("")),
        ("SAV", has(data, 0, b"$FL2@(#)"), F.lit(DOCUMENT), latin(data, 8, 56)),
        ("PDF", has(data, 0, b"%PDF-1.") & be(data, 7, 1).between(0x30, 0x37), F.lit(DOCUMENT), latin(data, 1, 7)),
        ("PNG", has(data, 0, b"\x89PNG\r\n\x1a\n") & has(data, 12, b"IHDR"), F.lit(PICTURE), F.concat_ws("x", be(data, 18, 2), be(data, 22, 2), be(data, 24, 1))),
        ("PSD", has(data, 0, b"8BPS\x00\x01\x00\x00"), F.when((be(data, 12, 1) == 0) & (be(data, 13, 1) != 0) & (be(data, 22, 1) == 0) & be(data, 23, 1).isin(1, 8, 16, 32), PICTURE).otherwise(0), F.concat(F.concat_ws("x", be(data, 20, 2), be(data, 16, 2), be(data, 13, 1)), F.lit(" "), num(be(data, 23, 1)), F.lit("bpp"))),
        ("JPEG", has(data, 0, b"\xff\xd8\xff") & be(data, 3, 1).between(0xE0, 0xEF), F.when(has(data, 6, b"JFIF") | has(data, 6, b"Exif") | has(data, 6, b"http") | has(data, 6, b"ICC_PROFIL"), PICTURE).otherwise(0), F.concat(F.hex(cut(data, 3, 1)), F.lit(":"), F.regexp_extract(latin(data, 6, 506), "^[ -~]*", 0))),
        ("MP4", has(data, 4, b"ftyp") & has(data, 0, b"\x00\x00\x00") & (be(data, 3, 1) >= 16), F.lit(PICTURE), F.concat(latin(data, 8, 4), F.lit(" "), F.decode(cut(data, box, 4), "ISO-8859-1"))),
    ]
    out: Column | None = None
    for kind, test, flag, detail in rules:
        row = F.struct(F.lit(kind).alias("kind"), flag.cast("int").alias("flag"), detail.alias("detail"))
        out = F.when(test, row) if out is None else out.when(test, row)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("flag"), F.lit(None).cast("string").alias("detail")))


def sector_hits(blocks: DataFrame) -> DataFrame:
    """image, fpos, kind, flag, detail of the sectors that start a known format."""
    found = blocks.select("image", "fpos", sector_signature(F.col("data")).alias("s"))
    return found.select("image", "fpos", "s.kind", "s.flag", "s.detail").filter("kind IS NOT NULL")


#: First four bytes of a block and what they announce.
BLOCK_MAGICS: dict[bytes, str] = {
    **{bytes([0xFF, 0xD8, 0xFF, x]): "JPG" for x in (0xE0, 0xE1, 0xE2, 0xED, 0xFE)},
    b"MM\x00*": "TIFF", b"II*\x00": "TIFF", b"HXFF": "VDB", b"regf": "REG", b"dns.": "AU", b"SFPK": "SFK", b"<?xm": "XML",
    b"SZDD": "??_", b"KWAJ": "??_", b"[Zon": "ZoneTransfer", b"CPT9": "CPT", b"AGD3": "FH8", b"FILE": "$MFT", b"\xd0\xcf\x11\xe0": "OLE", b"{\\rt": "RTF",
    b"Rar!": "RAR", b"7z\xbc\xaf": "7z", b"%PDF": "PDF", b"8BPS": "PSD", b"\x89PNG": "PNG", b"GIF8": "GIF", b"AC10": "DWG", b"  0\r": "DXF", b"\x1aE\xdf\xa3": "MKV",
    b"OggS": "OGG", b"fLaC": "FLAC", b"0&\xb2u": "WMV", b"\xd7\xcd\xc6\x9a": "WMF", b"MThd": "MID", b"\x06\x06\xed\xf5": "INDD", b"II\xbc\x01": "JPEG-XR", b"%!PS": "PS",
    b"Pain": "PSP", b"JASC": "JBF", b"\xcf\xad\x12\xfe": "DBX", b"\xde\x12\x04\x95": "MO", b"\xc5\xd0\xd3\xc6": "EPS", b"\x1aTki": "DMX", b"AT&T": "DjVu", b"<htm": "html", b"<HTM": "HTML",
    b"\xef\xbb\xbf<": "HTML.BOM", b"<!DO": "XHTML", b"<!do": "xhtml", b"var ": "JS.var", b"\xdb\xa5-\x00": "DOC?", b"d8:a": "torrent", b"MATL": "Matlab", b"SQLi": "SQlite", b"MSCF": "CAB", b"#EXT": "M3U", b"x\x9c\xabV": "MP3",
}


def block_type(data: Column) -> Column:
    """Type name of a block by its magic, or null; the first rule that fits decides."""
    first = cut(data, 0, 4)
    office = F.when(contains_bytes(data, b"document.xml"), "DOCX").when(contains_bytes(data, b"workbook.xml"), "XLSX").when(contains_bytes(data, b"presentation"), "PPTX")
    office = office.when(contains_bytes(data, b"word/"), "DOCX").when(contains_bytes(data, b"xl/_rels"), "XLSX").when(contains_bytes(data, b"ppt/"), "PPTX").otherwise("DOCX/XLSX/PPTX")
    archive = F.when(contains_bytes(data, b"vnd.makemusic.notation") | contains_bytes(data, b"NotationMetadata.xml"), "MUSX").when(contains_bytes(data, b"[Content_Types].xm"), office).otherwise("ZIP")
    riff = F.when(has(data, 8, b"CDR"), "CDR").when(has(data, 8, b"WAV"), "WAV").when(has(data, 8, b"AVI"), "AVI").when(has(data, 8, b"WEB"), "WEBP").otherwise("RIFF")
    named = F.create_map(*[x for k, v in BLOCK_MAGICS.items() for x in (F.lit(k.hex().upper()), F.lit(v))])
    by_magic = F.element_at(named, F.hex(first))
    out = F.when(has(data, 0, b"PK\x03\x04"), archive).when(has(data, 0, b"ENIG"), F.when(contains_bytes(data, b"ENIGMA BINARY FILE"), "MUS").otherwise("MUS???")).when(has(data, 0, b"RIFF"), riff)
    out = out.when(by_magic.isNotNull(), by_magic).when(has(data, 0, b"MZ") & (le(data, 2, 2) < 512), "EXE")
    for magic, offset, label in ((b"FLV", 0, "FLV"), (b"CWS", 0, "SWF.comp"), (b"FWS", 0, "SWF"), (b"ID3", 0, "MP3.ID3"), (b"ftyp", 4, "MP4"), (b"BM", 0, "BMP?"), (b"Standard", 4, "MDB"), (b"**ACE**", 7, "ACE")):
        out = out.when(has(data, offset, magic), label)
    return out


def block_hits(blocks: DataFrame) -> DataFrame:
    """image, fpos, kind of the blocks whose type is known; records of the file system are left to their decoders."""
    kinds = blocks.select("image", "fpos", block_type(F.col("data")).alias("kind"))
    return kinds.filter("kind IS NOT NULL AND kind <> '$MFT'")


def boot_sectors(blocks: DataFrame, sector: int = 512) -> DataFrame:
    """Sectors of a block that end in 55AA: NTFS geometry, or the two bytes that tell other loaders apart.

    ``fpos`` is that of the sector itself, which is where the partition starts.
    """
    size = F.octet_length("data")
    spots = blocks.select("image", "fpos", "data", F.explode(F.sequence(F.lit(0), F.greatest(size - sector, F.lit(0)), F.lit(sector))).alias("at"))
    s = F.substring("data", F.col("at") + 1, F.lit(sector))
    found = spots.select("image", (F.col("fpos") + F.col("at")).alias("fpos"), s.alias("s")).filter(has(F.col("s"), sector - 2, b"\x55\xaa"))
    b, ntfs = F.col("s"), has(F.col("s"), 3, b"NTFS")
    when = lambda c: F.when(ntfs, c)
    return found.select(
        "image", "fpos", F.when(ntfs, "NTFS").otherwise("MBR?").alias("kind"), when(le(b, 11, 2)).alias("bytes_per_sector"), when(le(b, 13, 1)).alias("sectors_per_cluster"),
        when(le(b, 0x28, 6)).alias("total_sectors"), when(le(b, 0x30, 6)).alias("mft_cluster"),
        when(F.col("fpos") + le(b, 0x30, 6) * le(b, 11, 2) * le(b, 13, 1)).alias("mft_fpos"), F.hex(cut(b, 0xDA, 1)).alias("byte_da"), F.hex(cut(b, 0xDC, 1)).alias("byte_dc"),
    )


def fat_entries(records: DataFrame, extension: str = "JPG") -> DataFrame:
    """32-byte FAT directory records of one extension with printable names."""
    name = latin(F.col("data"), 0, 11)
    rows = records.select("image", "fpos", name.alias("n"), le(F.col("data"), 20, 2).alias("hi"), le(F.col("data"), 26, 2).alias("lo"), le(F.col("data"), 28, 4).alias("size"))
    rows = rows.filter(F.col("n").rlike("^[ -~]{11}$") & (F.substring("n", 9, 3) == extension))
    return rows.select("image", "fpos", F.rtrim(F.substring("n", 1, 8)).alias("name"), F.substring("n", 9, 3).alias("ext"), (F.col("hi") * 65536 + F.col("lo")).alias("cluster"), "size")
