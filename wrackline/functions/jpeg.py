"""JPEG: segments, Huffman tables and scans, integrity, a DC preview, and repair of a lost header."""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from wrackline.functions import ansi
from wrackline.functions.memo import memo

SOI, EOI, SOS, DQT, DHT, DRI, SOF0, SOF2, APP2 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0, 0xC2, 0xE2
SECTOR = 512
AFTER_SCAN = (SOS, EOI, DHT)
#: Weights of an integrity check.
GARBAGE, FRAME, STRUCTURE = 5, 1, 10
_NAMES = {SOI: "SOI", EOI: "EOI", SOS: "SOS", DQT: "DQT", DHT: "DHT", DRI: "DRI", SOF0: "SOF0", SOF2: "SOF2"}


class JpegError(ValueError):
    """A table or scan that cannot be decoded."""


def marker_name(m: int) -> str:
    return _NAMES.get(m) or (f"APP{m - 0xE0}" if 0xE0 <= m <= 0xEF else f"RST{m - 0xD0}" if 0xD0 <= m <= 0xD7 else f"{m:02X}")


# ---- Huffman coding ---------------------------------------------------------------------------


class Huffman:
    """A canonical code; ``quick`` has (length, value) by the next eight bits, for codes of that length at most."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.first: list[tuple[int, int, int, int]] = []  # length, first code, first place, count
        self.quick: list[tuple[int, int] | None] = [None] * 256
        code = at = 0
        for length, n in enumerate(counts, 1):
            if n:
                self.first.append((length, code, at, n))
            if n and length <= 8:
                wide = 1 << (8 - length)
                for i in range(min(n, (1 << length) - code)):
                    spot = (code + i) * wide
                    self.quick[spot : spot + wide] = [old or (length, symbols[at + i]) for old in self.quick[spot : spot + wide]]
            code, at = (code + n) << 1, at + n
        self.symbols = symbols

    @cached_property
    def codes(self) -> dict[int, tuple[int, int]]:
        """Code and length of each value."""
        return {self.symbols[at + i]: (code + i, length) for length, code, at, n in self.first for i in range(n)}

    def read(self, bits: "Bits") -> int:
        window = bits.peek(16)
        if hit := self.quick[window >> 8]:
            bits.skip(hit[0])
            return hit[1]
        for length, code, at, n in self.first:
            k = (window >> (16 - length)) - code
            if 0 <= k < n:
                bits.skip(length)
                return self.symbols[at + k]
        raise JpegError("no such code")


class Bits:
    """Bits of unstuffed scan data, most significant first; zeros after the end, within reason."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size, self.at = data + bytes(8), 8 * len(data), 0

    def peek(self, n: int) -> int:
        """The next n bits, 24 at most."""
        if self.at >= self.size:
            raise JpegError("the scan ends early")
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 4], "big") >> (32 - (self.at & 7) - n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.size:
            raise JpegError("the scan ends early")

    def take(self, n: int) -> int:
        out = self.peek(n) if n else 0
        self.skip(n)
        return out

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def difference(self, code: Huffman) -> int:
        """``signed(code.read(self))``, of one look at the data where the code is short."""
        at = self.at
        if at >= self.size:
            raise JpegError("the scan ends early")
        i = at >> 3
        window = int.from_bytes(self.data[i : i + 5], "big") >> (8 - (at & 7)) & 0xFFFFFFFF
        hit = code.quick[window >> 24]
        if hit is None or hit[1] > 16:
            return self.signed(code.read(self))
        length, n = hit
        self.skip(length + n)
        v = window >> (32 - length - n) & ((1 << n) - 1)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def pass_block(self, code: Huffman) -> None:
        """Go past the AC values of a baseline block."""
        data, size, at, quick, k = self.data, self.size, self.at, code.quick, 1
        while k < 64:
            if at >= size:
                raise JpegError("the scan ends early")
            i = at >> 3
            if hit := quick[int.from_bytes(data[i : i + 2], "big") >> (8 - (at & 7)) & 255]:
                at, s = at + hit[0], hit[1]
            else:
                self.at = at
                s = code.read(self)
                at = self.at
            if at > size:
                raise JpegError("the scan ends early")
            if s == 0:
                break
            k += (s >> 4) + 1
            if k > 64:
                raise JpegError("a block of over 64 values")
            at += s & 15
        self.skip(at - self.at)


#: Files of one maker mostly have the same few tables.
_code = memo(256)(Huffman)


def read_huffman(body: bytes) -> tuple[list[tuple[int, int, Huffman]], int]:
    """(class, id, code) of each table of a segment, and the bytes they take."""
    out, at = [], 0
    while at + 17 <= len(body):
        counts = body[at + 1 : at + 17]
        n = sum(counts)
        if at + 17 + n > len(body):
            break
        out.append((body[at] >> 4, body[at] & 15, _code(counts, body[at + 17 : at + 17 + n])))
        at += 17 + n
    return out, at


def read_quantisers(body: bytes) -> tuple[dict[int, list[int]], int]:
    """8-bit tables by number, and the bytes they take."""
    out, at = {}, 0
    while at + 65 <= len(body) and body[at] >> 4 == 0:
        out[body[at] & 15] = list(body[at + 1 : at + 65])
        at += 65
    return out, at


# ---- frames and scans ---------------------------------------------------------------------------


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    bits: int = 8
    progressive: bool = False
    components: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # id: H, V, quantiser

    @property
    def units(self) -> tuple[int, int]:
        h, v = max((c[0] for c in self.components.values()), default=1), max((c[1] for c in self.components.values()), default=1)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def read_frame(body: bytes, progressive: bool) -> tuple[Frame, int]:
    if len(body) < 6:
        raise JpegError("frame header")
    bits, height, width, n = struct.unpack(">BHHB", body[:6])
    parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4 or 1, body[7 + 3 * i] & 15 or 1, body[8 + 3 * i]) for i in range(n) if 9 + 3 * i <= len(body)}
    return Frame(width, height, bits, progressive, parts), 6 + 3 * n


def plausible(f: Frame, components: int) -> bool:
    size = 16 <= f.width <= 16384 and 16 <= f.height <= 16384
    return f.bits == 8 and components in (1, 3, 4) and size and f.width <= 8 * f.height and f.height <= 5 * f.width


def unstuff(data: bytes) -> list[bytes]:
    """Scan data between restart marks, without stuffed zeros."""
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    out.append(data[start:])
    return [p.replace(b"\xff\x00", b"\xff") for p in out]


def scan_end(data: bytes, at: int) -> int:
    """Where the next marker is that ends a scan's data, or -1."""
    while 0 <= (at := data.find(b"\xff", at)) < len(data) - 1:
        m = data[at + 1]
        if m == 0xFF:
            at += 1
        elif m == 0 or 0xD0 <= m <= 0xD8:
            at += 2
        else:
            return at
    return -1


@dataclass
class Decoder:
    """Tables of an image so far; :meth:`scan` decodes one scan with them."""

    frame: Frame | None = None
    codes: dict[tuple[int, int], Huffman] = field(default_factory=dict)
    quantisers: dict[int, list[int]] = field(default_factory=dict)
    restart: int = 0
    dc: dict[int, dict[tuple[int, int], int]] = field(default_factory=dict)
    set_ac: dict[tuple[int, int, int], int] = field(default_factory=dict)  # of a block: a bit for each value other than zero

    def _blocks(self, chosen: list[int]) -> tuple[int, Iterator[list[tuple[int, int, int]]]]:
        """How many units there should be, and (component, row, column) of the blocks of each."""
        f = self.frame
        if len(chosen) == 1:
            c = chosen[0]
            h, v, _ = f.components[c]
            hm, vm = max(c[0] for c in f.components.values()), max(c[1] for c in f.components.values())
            columns, rows = -(-(-(-f.width * h // hm)) // 8), -(-(-(-f.height * v // vm)) // 8)
            return columns * rows, ([(c, y, x)] for y in range(rows) for x in range(columns))
        across, down = f.units
        parts = [(c, f.components[c][1], f.components[c][0], j, i) for c in chosen for j in range(f.components[c][1]) for i in range(f.components[c][0])]
        return across * down, ([(c, y * v + j, x * h + i) for c, v, h, j, i in parts] for y in range(down) for x in range(across))

    def scan(self, header: bytes, data: bytes) -> tuple[int, int]:
        """Units decoded and units that there should be; DC values go to ``dc``."""
        n = header[0]
        chosen = [header[1 + 2 * i] for i in range(n)]
        tables = {header[1 + 2 * i]: (header[2 + 2 * i] >> 4, header[2 + 2 * i] & 15) for i in range(n)}
        start, stop, approx = header[1 + 2 * n], header[2 + 2 * n], header[3 + 2 * n]
        if any(c not in self.frame.components for c in chosen):
            raise JpegError("a component without a frame")
        high, low = approx >> 4, approx & 15
        parts = iter(unstuff(data))
        bits, before, run, done = Bits(next(parts)), dict.fromkeys(chosen, 0), 0, 0
        expected, units = self._blocks(chosen)
        later, progressive = self.frame.progressive and start, self.frame.progressive
        for i, unit in enumerate(units):
            if self.restart and i and i % self.restart == 0:
                part = next(parts, None)
                if part is None:
                    break
                bits, before, run = Bits(part), dict.fromkeys(chosen, 0), 0
            try:
                for c, y, x in unit:
                    if later:
                        walk = self._ac_refined if high else self._ac_progressive
                        run = walk(bits, self.codes[1, tables[c][1]], (c, y, x), start, stop, run)
                    elif high:
                        bits.take(1)
                    else:
                        before[c] += bits.difference(self.codes[0, tables[c][0]])
                        self.dc.setdefault(c, {})[y, x] = before[c] << low
                        if not progressive:
                            bits.pass_block(self.codes[1, tables[c][1]])
            except (JpegError, KeyError):
                break
            done += 1
        return done, expected

    def _ac_progressive(self, bits: Bits, code: Huffman, place: tuple[int, int, int], start: int, stop: int, run: int) -> int:
        """One block of a first AC scan; returns how many blocks after it are zero as well."""
        if run:
            return run - 1
        k, known, read, skip = start, self.set_ac.get(place, 0), code.read, bits.skip
        try:
            while k <= stop:
                s = read(bits)
                zeros, size = s >> 4, s & 15
                if size == 0 and zeros < 15:
                    return (1 << zeros) + bits.take(zeros) - 1
                k += zeros
                if size:
                    skip(size)
                    if k <= stop:
                        known |= 1 << k
                k += 1
            return 0
        finally:
            if known:
                self.set_ac[place] = known

    def _ac_refined(self, bits: Bits, code: Huffman, place: tuple[int, int, int], start: int, stop: int, run: int) -> int:
        """One block of a refinement scan: a bit for each value that is set, and values that are set anew."""
        known, k, fresh, read = self.set_ac.get(place, 0), start, 0, code.read
        while not run and k <= stop:
            s = read(bits)
            zeros, size = s >> 4, s & 15
            if size > 1:
                raise JpegError("a refinement of more than one bit")
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            begun = k
            while k <= stop:
                if known >> k & 1:
                    pass
                elif zeros:
                    zeros -= 1
                else:
                    fresh |= size << k
                    break
                k += 1
            # A bit for the value and one for each that is set among those passed.
            bits.skip(size + (known >> begun & ((1 << (k - begun)) - 1)).bit_count())
            k += k <= stop
        if run:
            bits.skip((known >> k & ((1 << max(0, stop - k + 1)) - 1)).bit_count())
            run -= 1
        self.set_ac[place] = known | fresh
        return run


def multi_picture(body: bytes) -> list[dict]:
    """Pictures (size, offset) that a multi-picture index lists."""
    if not body.startswith(b"MPF\0") or len(body) < 12:
        return []
    data, order = body[4:], "little" if body[4:6] == b"II" else "big"
    n = lambda at, w: int.from_bytes(data[at : at + w], order)
    at, out = n(4, 4), []
    for i in range(min(n(at, 2), 64)):
        p = at + 2 + 12 * i
        if n(p, 2) == 0xB002:
            where = n(p + 8, 4)
            out += [{"size": n(where + 16 * k + 4, 4), "offset": n(where + 16 * k + 8, 4)} for k in range(min(n(p + 4, 4) // 16, 256))]
    return out


# ---- walk over segments -----------------------------------------------------------------------------


@dataclass
class Segment:
    marker: int
    at: int
    body: bytes
    parsed: int  # bytes of the body that its tables account for
    garbage: int = 0  # bytes before the marker
    data: bytes = b""  # of a scan


def segments(data: bytes, at: int = 0) -> Iterator[Segment]:
    """Segments up to the end of the image; one that is cut short ends the walk."""
    while at + 1 < len(data):
        garbage = 0
        if data[at] != 0xFF:
            n = data.find(b"\xff", at)
            n = len(data) if n < 0 else n
            garbage, at = n - at, n
            if at + 1 >= len(data):
                yield Segment(0, at, b"", 0, garbage)
                return
        m = data[at + 1]
        if m in (SOI, EOI):
            yield Segment(m, at, b"", 0, garbage)
            at += 2
            if m == EOI:
                return
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        s = Segment(m, at, body, len(body), garbage)
        if m == DHT:
            s.parsed = read_huffman(body)[1]
        elif m == DQT:
            s.parsed = read_quantisers(body)[1]
        elif m == DRI:
            s.parsed = 2
        elif m in (SOF0, SOF2):
            s.parsed = 6 + 3 * body[5] if len(body) > 5 else -1
        elif size < 2 or at + 2 + size > len(data):
            s.parsed = -1
        at += 2 + max(size, 2)
        if m == SOS:
            end = scan_end(data, at)
            s.data = data[at : end if end >= 0 else len(data)]
            yield s
            if end < 0:
                return
            at = end
            continue
        yield s


def check_jpeg(data: bytes, depth: int = 0) -> int:
    """Weighted errors; an image that follows the end is checked as well and added."""
    errors, seen, last_scan = 0, Counter(), False
    for s in segments(data):
        errors += GARBAGE * (s.garbage > 0)
        if last_scan and s.marker not in AFTER_SCAN:
            return errors + STRUCTURE
        last_scan = s.marker == SOS
        seen[s.marker] += 1
        if s.marker == EOI:
            if seen[SOI] != 1 or not seen[SOS] or seen[SOF0] + seen[SOF2] != 1:
                errors += STRUCTURE
            rest = data[s.at + 2 :].lstrip(b"\0")
            again = rest[:32].find(b"\xff\xd8")
            if again >= 0 and len(rest) > again + 8 and depth < 16:
                errors += check_jpeg(rest[again:], depth + 1)
            return errors
        if s.marker in (SOF0, SOF2) and s.parsed >= 0:
            frame, _ = read_frame(s.body, s.marker == SOF2)
            errors += FRAME * (not plausible(frame, s.body[5]))
        if s.marker not in (SOI, SOS, 0) and s.parsed != len(s.body):
            errors += STRUCTURE
    return errors + STRUCTURE


def marker_counts(data: bytes) -> dict[str, int]:
    return dict(Counter(marker_name(s.marker) for s in segments(data)))


def decode(data: bytes) -> tuple[Decoder, list[tuple[int, int]]]:
    """DC values of an image, and for each scan the units decoded of those there should be."""
    d, scans = Decoder(), []
    for s in segments(data):
        if s.marker == DHT:
            d.codes.update({(kind, i): code for kind, i, code in read_huffman(s.body)[0]})
        elif s.marker == DQT:
            d.quantisers.update(read_quantisers(s.body)[0])
        elif s.marker == DRI and len(s.body) >= 2:
            d.restart = int.from_bytes(s.body[:2], "big")
        elif s.marker in (SOF0, SOF2) and s.parsed >= 0:
            d.frame = read_frame(s.body, s.marker == SOF2)[0]
        elif s.marker == SOS and d.frame and len(s.body) >= 4 + 2 * (s.body[0] if s.body else 0):
            try:
                scans.append(d.scan(s.body, s.data))
            except (JpegError, KeyError, IndexError):
                scans.append((0, -1))
    return d, scans


_SHADES = " .:-=+*#%@"


@memo(1 << 14)
def _cell(*levels: int) -> str:
    return ansi.cell(ansi.rgb_of(*levels))


def preview(data: bytes, columns: int = 64, color: bool = False) -> str | None:
    """The image's blocks as text, a line per row of blocks; None without a decodable frame.

    Grey shades of the first component by default; with ``color``, cells of a
    16-colour terminal from the first three.
    """
    return shown(decode(data)[0], columns, color)


def shown(d: Decoder, columns: int = 64, color: bool = False) -> str | None:
    """The preview of a decoded image."""
    if not d.frame or not d.dc:
        return None
    parts = [c for c in list(d.frame.components)[: 3 if color else 1] if d.dc.get(c)]
    first = next(iter(d.frame.components))
    if first not in parts:
        return None
    quantiser = {c: (d.quantisers.get(d.frame.components[c][2]) or [8])[0] for c in parts}
    h, v, _ = d.frame.components[first]

    def level(c: int, y: int, x: int) -> int:
        across, down, _ = d.frame.components[c]
        return d.dc[c].get((y * down // v, x * across // h), 0) * quantiser[c]

    rows, cols = (max(k[i] for k in d.dc[first]) + 1 for i in (0, 1))
    step = max(1, -(-cols // columns))
    blocks, q = d.dc[first], quantiser[first]  # of the first component a cell is a block
    if not color:
        grey = lambda n: _SHADES[min(9, max(0, int((n / 8 + 128) * 10 / 256)))]
        return "\n".join("".join([grey(blocks.get((y, x), 0) * q) for x in range(0, cols, step)]) for y in range(0, rows, step))
    if len(parts) < 3:
        lines = ([_cell(blocks.get((y, x), 0) * q) for x in range(0, cols, step)] for y in range(0, rows, step))
    else:
        lines = ([_cell(*[level(c, y, x) for c in parts]) for x in range(0, cols, step)] for y in range(0, rows, step))
    return "\n".join("".join(cells) + ansi.RESET for cells in lines)


# ---- repair ---------------------------------------------------------------------------------------------

#: Markers that an image may begin with, and those of its tables.
_HEADERS = (0xC0, 0xC2, 0xC4, 0xDA, 0xDB, 0xDD, 0xFE, 0xE0, 0xE1)
_TABLES = (0xC0, 0xC2, 0xC4, 0xDB)


def marker_places(data: bytes, at: int = 0) -> list[tuple[int, int]]:
    """(offset, code) of every marker from 0xC0 on, whatever lies between."""
    return [(m.end() - 2, m[0][-1]) for m in re.compile(rb"\xff+[\xc0-\xfe]").finditer(data, at)]


def image_start(marks: list[tuple[int, int]]) -> int | None:
    """Where the last image begins that still has its tables.

    End marks cut the markers into stretches.  One of them holds an image if a
    scan comes after a table, and begins with its first header; thumbnails come
    before the image that they belong to, so the last such stretch counts.
    """
    start = None
    stretch: list[tuple[int, int]] = []
    for at, code in [*marks, (-1, EOI)]:
        if code != EOI:
            stretch.append((at, code))
            continue
        codes = [c for _, c in stretch]
        table = next((i for i, c in enumerate(codes) if c in _TABLES), len(codes))
        if SOS in codes[table:]:
            start = next(a for a, c in stretch if c in _HEADERS)
        stretch = []
    return start


def repair_jpeg(data: bytes) -> dict:
    """action, start, eoi and repaired of a file whose beginning was overwritten.

    A file with its own start is ``intact`` and left alone.  In another one the
    first sector is skipped; the image begins at :func:`image_start` and runs to
    the last end mark; a start mark is put before it if the nearest is not its
    own.  ``none``: no image.
    """
    intact = data[:2] == b"\xff\xd8"
    marks = marker_places(data, 2 if intact else SECTOR)
    start = image_start(marks)
    if start is None:
        return {"action": "none", "start": None, "eoi": None, "repaired": None}
    soi, eoi = (max((a for a, c in marks if c == code), default=None) for code in (SOI, EOI))
    out = {"action": "intact" if intact else "none", "start": start, "eoi": eoi, "repaired": None}
    if intact or eoi is None or eoi <= start:
        return out
    prefix = b"\xff\xd8" if soi is None or soi < start else b""
    return out | {"action": "repaired", "repaired": prefix + data[start : eoi + 2]}


# ---- encoders, for tests ------------------------------------------------------------------------------------


def make_jpeg(width: int, height: int, levels: list[int]) -> bytes:
    """A grey baseline image of flat blocks, one DC level (-1000..1000) each, in raster order."""

    def segment(m: int, body: bytes) -> bytes:
        return bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body

    counts = bytes([0, 0, 0, 12] + [0] * 12)
    dc, ac = Huffman(counts, bytes(range(12))), Huffman(bytes([0, 1] + [0] * 14), b"\0")
    value = size = before = 0
    for v in levels:
        diff, before = v - before, v
        n = abs(diff).bit_length()
        code, length = dc.codes[n]
        value, size = value << length | code, size + length
        value, size = value << n | (diff if diff >= 0 else diff + (1 << n) - 1), size + n
        code, length = ac.codes[0]
        value, size = value << length | code, size + length
    pad = -size % 8
    raw = (value << pad | (1 << pad) - 1).to_bytes((size + pad) // 8, "big").replace(b"\xff", b"\xff\x00")
    app = segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    tables = segment(DQT, b"\0" + bytes([8]) * 64) + segment(SOF0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
    tables += segment(DHT, b"\0" + counts + bytes(range(12))) + segment(DHT, b"\x10" + bytes([0, 1] + [0] * 14) + b"\0")
    return b"\xff\xd8" + app + tables + segment(SOS, b"\1\1\0\0\x3f\0") + raw + b"\xff\xd9"


class _Writer:
    """Bits of a scan; symbols have codes of eight bits, their own number."""

    def __init__(self) -> None:
        self.text: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.text.append(f"{value:0{n}b}")

    def signed(self, value: int) -> None:
        n = abs(value).bit_length()
        self.put(value if value >= 0 else value + (1 << n) - 1, n)

    def done(self) -> bytes:
        whole = "".join(self.text)
        whole += "1" * (-len(whole) % 8)
        return int(whole or "0", 2).to_bytes(len(whole) // 8, "big").replace(b"\xff", b"\xff\x00")


def make_progressive(width: int, height: int, blocks: list[list[int]]) -> bytes:
    """A grey progressive image of blocks of up to 16 values in zigzag order: first scans without the last bit, then refinements."""
    size = lambda v: abs(v).bit_length()
    half = lambda v: (abs(v) >> 1) * (1 if v > 0 else -1)
    scans, before = [_Writer() for _ in range(4)], 0
    known: dict[tuple[int, ...], tuple[str, str]] = {}  # AC values to their bits
    for b in blocks:
        dc, ac = b[0] >> 1, b[1:]
        scans[0].put(size(dc - before), 8)
        scans[0].signed(dc - before)
        before = dc
        scans[1].put(b[0] & 1, 1)
        if (done := known.get(tuple(ac))) is not None:
            scans[2].text.append(done[0])
            scans[3].text.append(done[1])
            continue
        begun = [len(s.text) for s in scans]
        zeros = 0
        for v in ac:
            if not half(v):
                zeros += 1
                continue
            scans[2].put(zeros << 4 | size(half(v)), 8)
            scans[2].signed(half(v))
            zeros = 0
        scans[2].put(0, 8)
        zeros, late = 0, []
        for v in ac:
            if half(v):
                late.append(abs(v) & 1)
            elif not v:
                zeros += 1
            else:
                scans[3].put(zeros << 4 | 1, 8)
                scans[3].put(v > 0, 1)
                for bit in late:
                    scans[3].put(bit, 1)
                zeros, late = 0, []
        scans[3].put(0, 8)
        for bit in late:
            scans[3].put(bit, 1)
        known[tuple(ac)] = "".join(scans[2].text[begun[2] :]), "".join(scans[3].text[begun[3] :])

    def segment(m: int, body: bytes) -> bytes:
        return bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body

    counts = bytes([0] * 7 + [255] + [0] * 8)
    head = segment(DQT, b"\0" + bytes([8]) * 64) + segment(SOF2, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
    head += segment(DHT, b"\0" + counts + bytes(range(255))) + segment(DHT, b"\x10" + counts + bytes(range(255)))
    heads = (b"\0\0\x01", b"\0\0\x10", b"\x01\x3f\x01", b"\x01\x3f\x10")
    return b"\xff\xd8" + head + b"".join(segment(SOS, b"\1\1\0" + h) + w.done() for h, w in zip(heads, scans)) + b"\xff\xd9"
