"""PDF: tokens, objects, cross references, streams; errors as a weighted count.

Tokens are ints, bytes (names, words and brackets) and :class:`Text`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from wrackline.functions.codecs import CodecError, apply_filters

HEADER_WITHIN = 1024
TRAILING = 4096
_BLANK, _ENDS = b"\0\t\n\x0c\r ", b"()<>[]{}/% \t\r\n\x0c\0"
#: Blanks and a number or a word, up to a delimiter.
_PLAIN = re.compile(rb"[\0\t\n\x0c\r ]*(?:([+-]?\d+)(?![^()<>\[\]{}/% \t\r\n\x0c\0])|(/?[^()<>\[\]{}/% \t\r\n\x0c\0]+|/))")
_INT = re.compile(rb"[+-]?\d+$")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class PdfError(ValueError):
    """What no weight is fixed for."""


class Text(bytes):
    """A string object."""


@dataclass
class Stream:
    raw: bytes
    filters: list[bytes]

    def decoded(self) -> bytes:
        return apply_filters(self.raw, self.filters)


@dataclass
class Parsed:
    errors: int = 0
    notes: list[str] = field(default_factory=list)
    objects: list[dict] = field(default_factory=list)
    inner: int = 0
    pages: int = 0
    count: int | None = None
    encrypt: int = 0
    encryption: dict = field(default_factory=dict)
    attachments: list[list] = field(default_factory=list)

    def wrong(self, weight: int, note: str) -> None:
        self.errors += weight
        self.notes.append(note)


class Tokens:
    """Reads tokens of ``data`` between ``at`` and ``end``."""

    def __init__(self, data: bytes, at: int, end: int, compat: bool = False) -> None:
        self.data, self.at, self.end, self.compat = data, at, end, compat

    def _skip(self) -> None:
        d = self.data
        while self.at < self.end:
            c = d[self.at]
            if c in _BLANK:
                self.at += 1
            elif c == 0x25 and d[self.at : self.at + 5] != b"%%EOF":
                while self.at < self.end and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self):
        """The next token, or None at the end."""
        if self.at >= 0 and (plain := _PLAIN.match(self.data, self.at, self.end)):
            self.at = plain.end()
            return int(plain[1]) if plain.lastindex == 1 else plain[2]
        self._skip()
        d = self.data
        if self.at >= self.end:
            return None
        c, start = d[self.at], self.at
        if c == 0x28:
            return self._literal()
        if c == 0x3C and d[start + 1 : start + 2] != b"<":
            stop = d.find(b">", start, self.end)
            stop = self.end if stop < 0 else stop
            self.at = stop + 1
            digits = bytes(x for x in d[start + 1 : stop] if x in b"0123456789abcdefABCDEF")
            return Text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        if d[start : start + 2] in (b"<<", b">>"):
            self.at += 2
            return d[start : start + 2]
        if d[start : start + 5] == b"%%EOF":
            self.at += 5
            return b"%%EOF"
        self.at += 1
        if c in b"[]{}<>)":
            return d[start : start + 1]
        while self.at < self.end and d[self.at] not in _ENDS:
            self.at += 1
        word = d[start : self.at]
        return int(word) if _INT.match(word) else word

    def _literal(self) -> Text:
        d, depth, out = self.data, 1, bytearray()
        self.at += 1
        while self.at < self.end:
            c = d[self.at]
            self.at += 1
            if c == 0x5C and self.at < self.end:
                e = d[self.at]
                self.at += 1
                if e in b"01234567":
                    digits = bytes([e])
                    while len(digits) < 3 and d[self.at : self.at + 1] and d[self.at] in b"01234567":
                        digits += d[self.at : self.at + 1]
                        self.at += 1
                    if not self.compat:
                        out.append(int(digits, 8) & 255)
                elif e in b"\r\n":
                    if e == 13 and d[self.at : self.at + 1] == b"\n":
                        self.at += 1
                elif not self.compat:
                    out.append(_ESCAPES.get(e, e))
                continue
            depth += (c == 0x28) - (c == 0x29)
            if depth == 0:
                break
            out.append(c)
        return Text(bytes(out))


def values(tokens: list, name: bytes) -> list:
    """What follows a name: the tokens up to the next name, or one name, or a bracket's inside."""
    if name not in tokens:
        return []
    at = tokens.index(name) + 1
    if at >= len(tokens):
        return []
    if tokens[at] == b"[":
        stop = tokens.index(b"]", at) if b"]" in tokens[at:] else len(tokens)
        return tokens[at + 1 : stop]
    if isinstance(tokens[at], bytes) and not isinstance(tokens[at], Text) and tokens[at][:1] == b"/":
        return [tokens[at]]
    out = []
    for t in tokens[at:]:
        if isinstance(t, bytes) and not isinstance(t, Text) and t[:1] in (b"/", b">", b"]"):
            break
        out.append(t)
    return out


def read_object(data: bytes, at: int, end: int, stop: bytes = b"endobj", compat: bool = False) -> tuple[int, list, Stream | None]:
    """Tokens up to ``stop`` (left out) or the end, and the stream among them."""
    reader, out, stream = Tokens(data, at, end, compat), [], None
    while (t := reader.next()) is not None:
        if t == stop:
            if stop == b"obj":
                out.append(t)
            break
        if t in (b"%%EOF", b"startxref") and not isinstance(t, Text):
            if not out:
                out.append(t)
                if t == b"startxref":
                    reader.next()
            else:
                reader.at -= len(t)
            break
        out.append(t)
        if t == b"stream" and not isinstance(t, Text):
            stream = _stream(reader, out)
            out.pop()
    return reader.at, out, stream


def _stream(reader: Tokens, tokens: list) -> Stream:
    d, start = reader.data, reader.at
    if d[start : start + 2] == b"\r\n":
        start += 2
    elif d[start : start + 1] in (b"\n", b"\r"):
        start += 1
    mark = d.find(b"endstream", start, reader.end)
    length = values(tokens, b"/Length")
    said = length[0] if len(length) == 1 and isinstance(length[0], int) else -1
    limit = reader.end if mark < 0 else mark
    # A length that runs past the mark or stops more than three bytes before it is not believed.
    size = said if 0 <= said and start + said <= reader.end and (mark < 0 or -3 <= start + said - mark) else limit - start
    if mark >= 0 and start + size > mark and d.find(b"endstream", start + size, reader.end) < 0:
        size = mark - start
    after = d.find(b"endstream", start + size, reader.end)
    reader.at = after + 9 if after >= 0 else reader.end
    return Stream(d[start : start + size], [f for f in values(tokens, b"/Filter") if isinstance(f, bytes)])


def _line_end(data: bytes, at: int, end: int) -> int:
    if data[at : at + 1] == b"\r":
        at += 1
    return at + 1 if at < end and data[at : at + 1] == b"\n" else at


def _header(data: bytes) -> int | None:
    at = data.find(b"%PDF-", 0, HEADER_WITHIN)
    at = data.find(b"%FDF-", 0, HEADER_WITHIN) if at < 0 else at
    if at < 0:
        return None
    end = min(len(data), HEADER_WITHIN)
    for part in range(2):
        if part and data[at : at + 1] != b"%":
            break
        while at < end and data[at] not in b"\r\n":
            at += 1
        at = _line_end(data, at, len(data))
    return at


def _xref_table(tokens: list, out: Parsed) -> dict[int, tuple[int, int]]:
    """Used entries of a table's sections."""
    found: dict[int, tuple[int, int]] = {}
    i = 1
    while i < len(tokens) and tokens[i] != b"trailer":
        if i + 2 >= len(tokens) or not isinstance(tokens[i], int) or not isinstance(tokens[i + 1], int):
            break
        first, n = tokens[i], tokens[i + 1]
        i += 2
        for j in range(n):
            if i + 2 >= len(tokens):
                raise PdfError("the table ends inside a section")
            place, gen, kind = tokens[i : i + 3]
            if kind == b"f":
                if first == 1 and j == 0 and gen == 65535:
                    first = 0  # numbered from one, but it starts with the head of the free list
            elif kind != b"n":
                out.wrong(1, "kind of a table entry")
            elif place:
                found[first + j] = (place, gen)
            i += 3
    if b"trailer" not in tokens:
        out.wrong(1, "no trailer")
    return found


def _cross_reference(data: bytes, body: int, out: Parsed) -> tuple[int, dict[int, tuple[int, int]]]:
    """End of what counts as the file, and the table."""
    end = len(data)
    mark = data.rfind(b"startxref", body)
    if mark <= 0:
        out.wrong(10, "no startxref")
        return end, {}
    try:
        number = re.compile(rb"\s*([^\r\n]*)").match(data, mark + 9)
        place = int(number[1])
        at = number.end()
        while at < end and data[at] <= 32:
            at += 1
        if data[at : at + 5] == b"%%EOF":
            if end >= at + TRAILING:
                out.wrong(1, "bytes after the end")
            end = at + 5
        else:
            out.wrong(5, "no end mark")
        if not body <= place < mark:
            place = data.rfind(b"xref", body, mark)
            out.wrong(1, "place of the table")
            if place < 0:
                raise PdfError("no table")
        _, tokens, _ = read_object(data, place, mark)
        if b"/Encrypt" in tokens:
            ref = values(tokens, b"/Encrypt")
            out.encrypt = ref[0] if ref and isinstance(ref[0], int) else -1
        if not tokens:
            raise PdfError("empty table")
        return end, _xref_table(tokens, out) if tokens[0] == b"xref" else {}
    except (PdfError, ValueError, TypeError, IndexError) as e:
        out.wrong(10, f"table: {e}")
        return end, {}


def parse(data: bytes, compat: bool = False) -> Parsed | None:
    """None where there is no header."""
    body = _header(data)
    if body is None:
        return None
    out = Parsed()
    try:
        end, table = _cross_reference(data, body, out)
        for oid, (place, _) in table.items():
            if not (isinstance(place, int) and body - 4 <= place < end - 5):
                out.wrong(1, f"object {oid} lies outside")
        at, fresh = body, True
        while at < min(end - 5, HEADER_WITHIN) and not (fresh and chr(data[at]).isdigit()):
            fresh = data[at] in b"\r\n"
            at += 1
        while at < end - 5:
            start = at
            at, tokens, stream = read_object(data, at, end, compat=compat)
            if not tokens or at <= start:
                break
            if len(tokens) >= 3 and tokens[2] == b"obj":
                _object(tokens, stream, start, out, compat)
            elif tokens[0] not in (b"xref", b"startxref", b"%%EOF") or isinstance(tokens[0], Text):
                out.wrong(1, "no object")
    except (PdfError, ValueError, TypeError, IndexError, RecursionError) as e:
        out.wrong(10, f"parser: {e}")
    return out


def _object(tokens: list, stream: Stream | None, start: int, out: Parsed, compat: bool) -> None:
    oid = tokens[0] if isinstance(tokens[0], int) and isinstance(tokens[1], int) else None
    if oid is None:
        out.wrong(1, "object number")
    kind = values(tokens, b"/Type")
    out.objects.append({"oid": oid, "at": start, "type": kind[0].decode("latin-1") if len(kind) == 1 and isinstance(kind[0], bytes) else None, "stream": None if stream is None else len(stream.raw)})
    if oid is not None and oid == out.encrypt:
        first = lambda n: next(iter(values(tokens, n)), None)
        out.encryption = {"v": first(b"/V"), "length": first(b"/Length"), "method": first(b"/CFM")}
    if stream is not None and not out.encrypt:
        try:
            plain = stream.decoded()
            if kind == [b"/EmbeddedFile"]:
                out.attachments.append([plain, None])
            if b"/ObjStm" in tokens:
                first, n = values(tokens, b"/First"), values(tokens, b"/N")
                offset = first[0] if first and isinstance(first[0], int) else 0
                out.inner += n[0] if n and isinstance(n[0], int) else 0
                _, tokens, _ = read_object(plain, offset, len(plain), compat=compat)
        except CodecError as e:
            out.wrong(1, f"stream of {oid}: {e}")
    if b"/Filespec" in tokens and not out.encrypt:
        for i, t in enumerate(tokens[:-1]):
            if t == b"/F" and not isinstance(t, Text) and isinstance(tokens[i + 1], Text):
                name = tokens[i + 1].decode("utf-8", "ignore")
                waiting = next((a for a in reversed(out.attachments) if a[1] is None and a[0] is not None), None)
                if waiting:
                    waiting[1] = name
                else:
                    out.attachments.append([None, name])
    elif out.attachments and out.attachments[-1][0] is not None and out.attachments[-1][1] is None:
        named = next((a for a in out.attachments if a[0] is None), None)
        if named:
            named[0] = out.attachments.pop()[0]
    out.pages += values(tokens, b"/Type") == [b"/Page"]
    if values(tokens, b"/Type") == [b"/Pages"]:
        count = values(tokens, b"/Count")
        out.count = count[0] if count and isinstance(count[0], int) else out.count


def check_pdf(data: bytes, compat: bool = False) -> int:
    """99: no PDF; else the weighted errors."""
    got = parse(data, compat)
    return 99 if got is None else got.errors


def facts(data: bytes) -> dict | None:
    """pages, count, objects, encrypted and attachments."""
    got = parse(data)
    if got is None:
        return None
    return {"errcnt": got.errors, "pages": got.pages, "count": got.count, "objects": len(got.objects) + got.inner, "encrypted": got.encrypt != 0, "attachments": [a for a in got.attachments if a[0] is not None]}


def make_pdf(objects: list[bytes], root: int = 1, end: bytes = b"%%EOF\n", startxref: bool = True) -> bytes:
    """A file of numbered object bodies with its table."""
    out = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
    places = []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root %d 0 R >>\n" % (len(objects) + 1, root)
    return bytes(out) + (b"startxref\n%d\n" % at if startxref else b"") + end
