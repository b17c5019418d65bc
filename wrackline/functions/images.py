"""Integrity of WMF, GIF, PNG, TIFF and PSD files, as weighted error counts, and their inner tables.

0 is a sound file.  :class:`Unreadable` stands for input that no count fits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from wrackline.functions import codecs
from wrackline.functions.ntfs import u


class Unreadable(ValueError):
    """The file ends or lies where a header promised something else."""


def _be(data: bytes, at: int, n: int) -> int:
    if at < 0 or at + n > len(data):
        raise Unreadable(f"nothing at {at}")
    return int.from_bytes(data[at : at + n], "big")


# ---- WMF --------------------------------------------------------------------------------------

WMF_MAGIC = b"\xd7\xcd\xc6\x9a"


def check_wmf(data: bytes) -> int:
    """0: records end with the file; 2: one is larger than announced; 1: anything else."""
    largest = u(data, 22 + 12, 4)
    at = 22 + 2 * u(data, 24, 2)
    while at + 6 <= len(data):
        size, function = u(data, at, 4), u(data, at + 4, 2)
        if size > largest:
            return 2
        at += 2 * size
        if function == 0:
            return 0 if at == len(data) else 1
        if size == 0:
            return 1
    return 1


def make_wmf(records: list[bytes]) -> bytes:
    body = b"".join((3 + len(r) // 2).to_bytes(4, "little") + b"\x01\x02" + r for r in records) + b"\x03\0\0\0\0\0"
    largest = max([3, *(3 + len(r) // 2 for r in records)])
    head = struct.pack("<HHHIHIH", 1, 9, 0x300, 9 + len(body) // 2, 0, largest, 0)
    return WMF_MAGIC + bytes(2) + struct.pack("<hhhhHIH", 0, 0, 100, 100, 96, 0, 0) + head + body


# ---- GIF --------------------------------------------------------------------------------------

GIF_MAGIC = (b"GIF87a", b"GIF89a")
GIF_WIDEST, GIF_HIGHEST = 8192, 4096


class _Gif:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise Unreadable("GIF ends early")
        self.at += n
        return out

    def blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)


def gif_parts(data: bytes) -> Iterator[dict]:
    """Screen, then frames and extensions with what they hold; a block of no known kind comes as ``bad``."""
    g = _Gif(data)
    magic = g.take(6)
    if magic not in GIF_MAGIC:
        raise Unreadable("no GIF")
    w, h, flags, _, _ = struct.unpack("<HHBBB", g.take(7))
    yield {"part": "screen", "at": 0, "w": w, "h": h, "colors": 2 << (flags & 7) if flags & 0x80 else 0}
    g.at += 3 * (2 << (flags & 7)) if flags & 0x80 else 0
    while g.at < len(data):
        at, kind = g.at, g.take(1)[0]
        if kind == 0x3B:
            yield {"part": "trailer", "at": at}
            return
        if kind == 0x21:
            label = g.take(1)[0]
            yield {"part": "extension", "at": at, "label": label, "data": g.blocks()}
        elif kind == 0x2C:
            _, _, fw, fh, fl = struct.unpack("<HHHHB", g.take(9))
            g.at += 3 * (2 << (fl & 7)) if fl & 0x80 else 0
            bits = g.take(1)[0]
            yield {"part": "frame", "at": at, "w": fw, "h": fh, "bits": bits, "data": g.blocks()}
        else:
            yield {"part": "bad", "at": at, "label": kind}
            return


def check_gif(data: bytes) -> int:
    """100: no GIF or cut short; 10: too large; 20: unknown block; 1: no frame has all its pixels."""
    good = 0
    try:
        for p in gif_parts(data):
            if p["part"] == "screen" and (p["w"] > GIF_WIDEST or p["h"] > GIF_HIGHEST):
                return 10
            if p["part"] == "bad":
                return 20
            if p["part"] == "frame":
                if not 1 <= p["bits"] <= 11:
                    raise Unreadable("code size")
                pixels = p["w"] * p["h"]
                good += len(codecs.gif_lzw_decode(p["data"], p["bits"], pixels)) == pixels
    except (Unreadable, struct.error):
        return 100
    return 0 if good else 1


def make_gif(w: int, h: int, pixels: bytes, bits: int = 8, trailer: bytes = b";") -> bytes:
    packed = codecs.gif_lzw_encode(pixels, bits)
    subs = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)) + b"\0"
    palette = bytes(x for i in range(1 << bits) for x in (i & 255, i & 255, i & 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | bits - 1, 0, 0) + palette + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([bits]) + subs + trailer


# ---- PNG --------------------------------------------------------------------------------------

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_raw_size(w: int, h: int, bits: int, interlaced: bool, compat: bool = False) -> int:
    """Inflated size.  Interlaced images are summed over their passes; ``compat``
    takes the pixels of the whole image and a table of scan lines instead, which
    is not exact for narrow images and less than 8 bits."""
    if not interlaced:
        return h * (1 + (w * bits + 7) // 8)
    if compat:
        # Scan lines of the last, incomplete eight rows.
        return (w * bits + 7) // 8 * h + 15 * (h // 8) + (0, 4, 5, 7, 8, 11, 12, 14)[h % 8]
    total = 0
    for x, y, dx, dy in _PASSES:
        pw, ph = max(0, -((x - w) // dx)), max(0, -((y - h) // dy))
        total += ph * (1 + (pw * bits + 7) // 8) if pw else 0
    return total


def png_chunks(data: bytes) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """(offset, name, body, whether its checksum fits), up to the end chunk."""
    at = 8
    while at + 8 <= len(data):
        size = _be(data, at, 4)
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        yield at, name, body, zlib.crc32(name + body) == _be(data, at + 8 + size, 4)
        at += 12 + size
        if name == b"IEND":
            return


def check_png(data: bytes, compat: bool = False) -> int:
    """1 for each bad checksum, 1 for a wrong first or last chunk, 1 for a wrong size, 10 for the rest."""
    errors, names, inflated, head = 0, [], 0, None
    z = zlib.decompressobj()
    try:
        for _, name, body, sound in png_chunks(data):
            names.append(name)
            errors += not sound
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", body[:13])
            elif name == b"IDAT":
                inflated += len(z.decompress(body))
        inflated += len(z.flush())
        errors += names[0] != b"IHDR" or names[-1] != b"IEND"
        w, h, depth, color, _, _, interlace = head
        errors += inflated != png_raw_size(w, h, depth * _CHANNELS.get(color, 0), bool(interlace), compat)
    except (Unreadable, zlib.error, struct.error, IndexError, TypeError):
        errors += 10
    return errors


def png_chunk(name: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")


def make_png(w: int, h: int, raw: bytes, depth: int = 8, color: int = 0, interlace: int = 0, level: int = 6) -> bytes:
    """``raw`` with its filter bytes."""
    head = struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlace)
    return PNG_MAGIC + png_chunk(b"IHDR", head) + png_chunk(b"IDAT", zlib.compress(raw, level)) + png_chunk(b"IEND", b"")


# ---- TIFF -------------------------------------------------------------------------------------

TIFF_MAGIC = (b"II*\0", b"MM\0*")
#: Type code to name and bytes per value; fixed by the format.
TIFF_TYPES = {
    1: ("BYTE", 1), 2: ("ASCII", 1), 3: ("SHORT", 2), 4: ("LONG", 4), 5: ("RATIONAL", 8), 6: ("SBYTE", 1),
    7: ("UNDEFINED", 1), 8: ("SSHORT", 2), 9: ("SLONG", 4), 10: ("SRATIONAL", 8), 11: ("FLOAT", 4), 12: ("DOUBLE", 8),
}
_WHOLE, _SIGNED = {1, 3, 4}, {6, 8, 9, 10}
RAW, LZW, PACKBITS, DEFLATE = 1, 5, 32773, 32946


def tiff_directories(data: bytes) -> Iterator[tuple[int, list[dict], int]]:
    """(offset, tags, offset of the next) of each directory; stops at one that makes no sense or comes again."""
    order = "little" if data[:2] == b"II" else "big"

    def number(at: int, n: int, signed: bool = False) -> int:
        return int.from_bytes(data[at : at + n], order, signed=signed)

    at, seen = number(4, 4), set()
    while 8 <= at <= len(data) - 2 and at not in seen:
        seen.add(at)
        n = number(at, 2)
        if not 4 <= n <= 64:
            return
        tags = []
        for i in range(n):
            p = at + 2 + 12 * i
            tag, typ, count = number(p, 2), number(p + 2, 2), number(p + 4, 4)
            if typ not in TIFF_TYPES or count == 0 or TIFF_TYPES[typ][1] * count > len(data):
                break
            each = TIFF_TYPES[typ][1]
            where = p + 8 if each * count <= 4 else number(p + 8, 4)
            row = {"tag": tag, "typ": typ, "cnt": count, "ints": [], "str": None}
            if typ == 2:
                row["str"] = data[where : where + count - 1].decode("latin-1")
            elif typ in (5, 10):
                row["ints"] = [number(where, 4, typ == 10), number(where + 4, 4, typ == 10)]
            elif typ in _WHOLE | _SIGNED:
                row["ints"] = [number(where + each * j, each, typ in _SIGNED) for j in range(count)]
            else:
                row["str"] = f"#{where}"
            tags.append(row)
        after = number(at + 2 + 12 * n, 4)
        yield at, tags, after
        if after == 0:
            return
        at = after


def _strip_size(part: bytes, scheme: int) -> int:
    if scheme == PACKBITS:
        return codecs.packbits_length(part)
    try:
        return len(codecs.lzw_decode(part, strict=False) if scheme == LZW else codecs.inflate(part))
    except codecs.CodecError as e:
        raise Unreadable(str(e)) from e


def check_tiff(data: bytes) -> int:
    """100: no TIFF; 10: directories do not end; else whether the strips decode to the image's size."""
    if data[:4] not in TIFF_MAGIC:
        return 100
    sound, ended, scheme = False, False, None
    for _, tags, after in tiff_directories(data):
        v = {t["tag"]: t["ints"] for t in tags if t["ints"]}
        one = lambda tag, default: v.get(tag, [default])[0]
        scheme = one(259, scheme)
        if 273 in v and 258 in v:
            counts = v.get(279, [len(data) - v[273][0]])
            packed = sum(counts)
            if scheme is not None and packed <= len(data) - 26:
                sound = True
            if scheme in (RAW, LZW, PACKBITS, DEFLATE):
                row = (one(256, 1) * sum(v[258]) + 7) // 8
                height, per = one(257, 1), max(1, one(278, 1))
                got = packed if scheme == RAW else sum(_strip_size(data[o : o + n], scheme) for o, n in zip(v[273], counts))
                if got not in (-(-height // per) * per * row, height * row):
                    sound = False
        if after == 0:
            ended = True
    return 10 if not ended else 0 if sound else 1


def make_tiff(w: int, h: int, pixels: bytes, scheme: int = RAW, rows_per_strip: int | None = None) -> bytes:
    """8-bit grey, little-endian."""
    per = rows_per_strip or h
    pack = {RAW: bytes, LZW: codecs.lzw_encode, PACKBITS: codecs.packbits_encode, DEFLATE: zlib.compress}[scheme]
    strips = [pack(pixels[w * y : w * min(y + per, h)]) for y in range(0, h, per)]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8]), (259, 3, [scheme]), (262, 3, [1]), (273, 4, None), (277, 3, [1]), (278, 4, [per]), (279, 4, [len(s) for s in strips])]
    base = 8 + 2 + 12 * len(tags) + 4
    extra = 4 * len(strips) if len(strips) > 1 else 0
    at, offsets = base + 2 * extra, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    out, tail = bytearray(b"II*\0" + (8).to_bytes(4, "little") + len(tags).to_bytes(2, "little")), b""
    for tag, typ, values in tags:
        values = offsets if values is None else values
        out += struct.pack("<HHI", tag, typ, len(values))
        if len(values) > 1:
            out += (base + len(tail)).to_bytes(4, "little")
            tail += b"".join(x.to_bytes(4, "little") for x in values)
        else:
            out += values[0].to_bytes(TIFF_TYPES[typ][1], "little").ljust(4, b"\0")
    return bytes(out) + bytes(4) + tail + b"".join(strips)


# ---- PSD --------------------------------------------------------------------------------------

PSD_MAGIC, BLOCK_MAGIC = b"8BPS", b"8BIM"
RLE_LIMIT = 10


def _psd_resources(data: bytes, at: int, end: int) -> tuple[list[dict], int]:
    """Resources (id, name, offset, size) and where their list really ends."""
    out = []
    while at < end and data[at : at + 4] == BLOCK_MAGIC:
        kind, n = _be(data, at + 4, 2), _be(data, at + 6, 1)
        body = at + 7 + n + (n + 1) % 2
        size = _be(data, body, 4)
        out.append({"id": kind, "name": data[at + 7 : at + 7 + n].decode("latin-1"), "at": body + 4, "size": size})
        at = body + 4 + size + size % 2
    return out, at


def psd_sections(data: bytes) -> dict:
    """Offsets of the sections, resources, and how much of each section is left over."""
    if data[:4] != PSD_MAGIC or _be(data, 4, 2) != 1 or any(data[6:12]):
        raise Unreadable("no PSD")
    out = {"channels": _be(data, 12, 2), "height": _be(data, 14, 4), "width": _be(data, 18, 4), "depth": _be(data, 22, 2), "mode": _be(data, 24, 2)}
    at = 30 + _be(data, 26, 4)
    size = _be(data, at, 4)
    out["resources"], end = _psd_resources(data, at + 4, at + 4 + size)
    out["resources_left"] = at + 4 + size - end
    at += 4 + size
    size, out["layers_left"] = _be(data, at, 4), 0
    if size:
        spot = at + 8 + _be(data, at + 4, 4)
        spot += 4 + _be(data, spot, 4)
        while spot < at + 4 + size and data[spot : spot + 4] == BLOCK_MAGIC:
            n = _be(data, spot + 8, 4)
            spot += 12 + n + -n % 4
        out["layers_left"] = at + 4 + size - spot
    out["image_at"] = at + 4 + size
    return out


def check_psd(data: bytes) -> int:
    """100: header; 1 for each section with a residue and each wrong row; 10: the image does not end with the file."""
    if data[:4] != PSD_MAGIC or data[4:12] != b"\0\1\0\0\0\0\0\0":
        return 100
    s = psd_sections(data)
    errors = (s["resources_left"] != 0) + (s["layers_left"] != 0)
    at, row, rows = s["image_at"] + 2, s["width"] * (s["depth"] // 8), s["height"] * s["channels"]
    scheme = _be(data, s["image_at"], 2)
    if scheme == 0:
        at += row * rows
    elif scheme == 1:
        sizes = [_be(data, at + 2 * i, 2) for i in range(rows)]
        at += 2 * rows
        for n in sizes:
            if len(codecs.packbits_decode(data[at : at + n])) != row:
                errors += 1
                if errors >= RLE_LIMIT:
                    break
            at += n
    return errors + (10 if at != len(data) else 0)


def make_psd(w: int, h: int, rows: list[bytes], rle: bool = False) -> bytes:
    """One 8-bit channel."""
    head = b"8BPS\0\1" + bytes(6) + struct.pack(">HIIHH", 1, h, w, 8, 1) + bytes(4)
    resource = b"8BIM" + struct.pack(">H", 1005) + b"\0\0" + (2).to_bytes(4, "big") + b"ab"
    packed = [codecs.packbits_encode(r) for r in rows]
    image = b"\0\1" + b"".join(len(p).to_bytes(2, "big") for p in packed) + b"".join(packed) if rle else b"\0\0" + b"".join(rows)
    return head + len(resource).to_bytes(4, "big") + resource + bytes(4) + image
