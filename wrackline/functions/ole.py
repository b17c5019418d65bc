"""Compound files: sectors, chains, directory and streams; workbook records; summary times."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from wrackline.functions.ntfs import u, unix_time, utf16

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, FREE, FAT_SECTOR, DIFAT_SECTOR = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFC
STORAGE, STREAM, ROOT = 1, 2, 5


_NOT_ZERO = re.compile(rb"[^\0]")
_ENTRY = "<64sHBx3I36xIQ"


def _numbers(data: bytes) -> list[int]:
    """32-bit numbers; a last one that is cut short has zeros for the rest."""
    data += bytes(-len(data) % 4)
    return list(struct.unpack(f"<{len(data) // 4}I", data))


class OleError(ValueError):
    """A file or stream that cannot be read."""


@dataclass
class Entry:
    name: str
    kind: int
    start: int
    size: int
    path: str = ""


class CompoundFile:
    """Opens a compound file; what is odd but can be worked around goes to ``issues``."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC or len(data) < 512:
            raise OleError("no compound file")
        self.data, self.issues = data, []
        self.sector, self.mini = 1 << min(u(data, 30, 2), 20), 1 << min(u(data, 32, 2), 20)
        if self.sector not in (512, 4096):
            raise OleError("sector size")
        if self.mini != 64:
            self.issues.append("short sector size")
        if u(data, 28, 2) != 0xFFFE:
            self.issues.append("byte order mark")
        self.cutoff = u(data, 56, 4)
        self.fat = self._fat()
        self.entries = self._directory()
        root = self.entries[0]
        self._short = self._chain(root.start, self.sector, self.fat, self.data, self.sector) if root.size else b""
        mini_fat = self._chain(u(data, 60, 4), self.sector, self.fat, self.data, self.sector) if u(data, 64, 4) else b""
        self.mini_fat = _numbers(mini_fat)

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.sector : (n + 2) * self.sector]

    def _fat(self) -> list[int]:
        listed = _numbers(self.data[76:512])
        at, seen = u(self.data, 68, 4), set()
        while at < DIFAT_SECTOR and at not in seen:
            seen.add(at)
            more = self._sector(at)
            if len(more) < self.sector:
                self.issues.append("allocation list is cut short")
                break
            *more, at = _numbers(more)
            listed += more
        fat: list[int] = []
        for n in listed:
            if n < DIFAT_SECTOR:
                part = self._sector(n)
                if len(part) < self.sector:
                    raise OleError("allocation table lies outside the file")
                fat += _numbers(part)
        return fat

    @staticmethod
    def _chain(at: int, size: int, table: list[int], store: bytes, first: int, want: int | None = None) -> bytes:
        out, seen = [], set()
        while at != END:
            if at >= len(table) or at in seen:
                raise OleError("broken chain")
            seen.add(at)
            out.append(store[first + at * size : first + (at + 1) * size])
            at = table[at]
        whole = b"".join(out)
        if want is not None:
            if len(whole) < want:
                raise OleError("stream is cut short")
            whole = whole[:want]
        return whole

    def _directory(self) -> list[Entry]:
        raw = self._chain(u(self.data, 48, 4), self.sector, self.fat, self.data, self.sector)
        if len(raw) < 128:
            raise OleError("no directory")
        links: list[tuple[int, int, int]] = []
        out = []
        for at in range(0, len(raw) - 127, 128):
            name, n, kind, left, right, child, start, size = struct.unpack_from(_ENTRY, raw, at)
            out.append(Entry(utf16(name[: max(0, min(n, 64) - 2)]), kind, start, size if self.sector == 4096 else size & 0xFFFFFFFF))
            links.append((left, right, child))
        if out[0].kind != ROOT:
            self.issues.append("root entry")
        seen, todo = {0}, [(links[0][2], "")]
        while todo:
            i, folder = todo.pop()
            if i == FREE:
                continue
            if i >= len(out) or i in seen:
                self.issues.append("directory link")
                continue
            seen.add(i)
            out[i].path = folder + out[i].name
            todo += [(links[i][0], folder), (links[i][1], folder), (links[i][2], out[i].path + "/")]
        return out

    def streams(self) -> list[Entry]:
        return [e for e in self.entries if e.path and e.kind == STREAM]

    def find(self, path: str) -> Entry | None:
        return next((e for e in self.entries if e.path.lower() == path.lower()), None)

    def read(self, entry: Entry) -> bytes:
        if entry.size == 0:
            return b""
        if entry.size < self.cutoff:
            return self._chain(entry.start, self.mini, self.mini_fat, self._short, 0, entry.size)
        return self._chain(entry.start, self.sector, self.fat, self.data, self.sector, entry.size)


def summary_times(file: CompoundFile) -> tuple[int | None, int | None]:
    """(last saved, created) of the summary property set."""
    entry = file.find("\x05SummaryInformation")
    if entry is None:
        return None, None
    data = file.read(entry)
    start = u(data, 44, 4)
    times: dict[int, int] = {}
    for i in range(min(u(data, start + 4, 4), 256)):
        kind, at = u(data, start + 8 + 8 * i, 4), start + u(data, start + 12 + 8 * i, 4)
        if kind in (12, 13) and u(data, at, 4) == 64 and (ticks := u(data, at + 4, 8)):
            times[kind] = unix_time(ticks)
    return times.get(13), times.get(12)


# ---- workbooks ----------------------------------------------------------------------------------

#: Names of sheet kinds and states.
SHEET_KINDS = {0: "worksheet or dialog sheet", 1: "Excel 4.0 macro sheet", 2: "chart", 6: "Visual Basic module"}
SHEET_STATES = {0: "visible", 1: "hidden", 2: "very hidden", 3: "visibility=3"}


def workbook_sheets(data: bytes) -> tuple[list[dict], int]:
    """Sheets (position, name, kind, state) of a workbook stream, and its macro sheets.

    Raises :class:`OleError` where a record is cut short.
    """
    sheets, macros, wide, at = [], 0, True, 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        if not kind and not size:
            # Zeros are empty records; on to the first one that is not.
            after = _NOT_ZERO.search(data, at)
            at = at + (after.start() - at) // 4 * 4 if after else len(data)
            continue
        body = data[at + 4 : at + 4 + size] if kind in (0x0809, 0x85) else b""
        if kind == 0x0809 and size >= 8:
            if len(body) < 8:
                raise OleError("record is cut short")
            wide = u(body, 0, 2) == 0x0600
            macros += u(body, 2, 2) == 0x40
        elif kind == 0x85 and size >= 6:
            if len(body) < 8:
                raise OleError("record is cut short")
            n = body[6]
            if not wide:
                name = body[7 : 7 + n].decode("latin-1")
            else:
                name = utf16(body[8 : 8 + 2 * n]) if body[7] else body[8 : 8 + n].decode("latin-1")
            macros += body[5] == 1
            sheets.append({"position": u(body, 0, 4), "name": name, "kind": SHEET_KINDS.get(body[5], f"{body[5]:02x}"), "state": SHEET_STATES[body[4] & 3]})
        at += 4 + size
    return sheets, macros


# ---- encoder, for tests ----------------------------------------------------------------------------


def make_compound(streams: dict[str, bytes]) -> bytes:
    """A version 3 file with streams of the root; all are stored in whole sectors."""
    order = list(streams.items())
    sectors: list[bytes] = []
    fat: list[int] = []

    def store(data: bytes) -> int:
        n = max(1, -(-len(data) // 512))
        first = len(sectors)
        data = data.ljust(512 * n, b"\0")
        sectors.extend([data[512 * i : 512 * (i + 1)] for i in range(n)])
        fat.extend(range(first + 1, first + n))
        fat.append(END)
        return first

    starts = [store(v.ljust(4096, b"\0")) for _, v in order]

    def entry(name: str, kind: int, child: int, right: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")
        out = bytearray(128)
        out[: len(raw)] = raw
        out[64:66], out[66], out[67] = (len(raw) + 2).to_bytes(2, "little"), kind, 1
        for at, n in ((68, FREE), (72, right), (76, child), (116, start), (120, size)):
            out[at : at + 4] = n.to_bytes(4, "little")
        return bytes(out)

    rows = [entry("Root Entry", ROOT, 1 if order else FREE, FREE, END, 0)]
    rows += [entry(k, STREAM, FREE, i + 2 if i + 1 < len(order) else FREE, starts[i], max(4096, len(v))) for i, (k, v) in enumerate(order)]
    directory = store(b"".join(rows))
    fat_at = len(sectors)
    n = 1
    while n * 128 < len(fat) + n:
        n += 1
    fat += [FAT_SECTOR] * n
    raw = struct.pack(f"<{len(fat)}I", *fat).ljust(512 * n, b"\xff")
    sectors += [raw[512 * i : 512 * (i + 1)] for i in range(n)]
    head = bytearray(512)
    head[:8] = MAGIC
    for at, v, w in ((24, 0x3E, 2), (26, 3, 2), (28, 0xFFFE, 2), (30, 9, 2), (32, 6, 2), (44, n, 4), (48, directory, 4), (56, 4096, 4), (60, END, 4), (64, 0, 4), (68, END, 4), (72, 0, 4)):
        head[at : at + w] = v.to_bytes(w, "little")
    struct.pack_into("<109I", head, 76, *[fat_at + i if i < n else FREE for i in range(109)])
    return bytes(head) + b"".join(sectors)
