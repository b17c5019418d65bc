"""Drawings and statistical data: structure of DXF and of SPSS system files, 0 if sound and 10 if not."""

from __future__ import annotations

BROKEN = 10
SAV_MAGIC = b"$FL2"
_VARIABLE, _LABELS, _LABELLED, _DOCUMENT, _EXTENSION, _END = 2, 3, 4, 6, 7, 999


def check_dxf(data: bytes) -> int:
    """Pairs of a group code and a value; sections open and close in turn, and the file ends with its end mark."""
    lines = data.decode("latin-1").replace("\r\n", "\n").rstrip("\n").split("\n")
    inside, ended = False, False
    for code, value in zip(lines[::2], lines[1::2]):
        if ended or not code.strip().lstrip("-").isdigit():
            return BROKEN
        if int(code) != 0:
            continue
        word = value.strip()
        if word in ("SECTION", "ENDSEC"):
            if inside == (word == "SECTION"):
                return BROKEN
            inside = word == "SECTION"
        elif word == "EOF":
            ended = True
        elif not inside:
            return BROKEN
    return 0 if ended and not inside and len(lines) % 2 == 0 else BROKEN


def check_sav(data: bytes) -> int:
    """A header of a known layout and dictionary records up to the end record."""
    if data[:4] != SAV_MAGIC or len(data) < 176:
        return BROKEN
    order = next((o for o in ("little", "big") if int.from_bytes(data[64:68], o) in (2, 3)), None)
    if order is None:
        return BROKEN
    number = lambda at: int.from_bytes(data[at : at + 4], order, signed=True)
    at, variables = 176, 0
    while at + 4 <= len(data):
        kind = number(at)
        if kind == _VARIABLE:
            variables += number(at + 4) >= 0
            missing, labelled = abs(number(at + 12)), number(at + 8)
            at += 32
            if labelled == 1:
                at += 4 + -(-number(at) // 4) * 4
            at += 8 * missing if missing <= 3 else len(data)
        elif kind == _LABELS:
            n, at = number(at + 4), at + 8
            for _ in range(n):
                if at + 9 > len(data):
                    return BROKEN
                at += 8 + -(-(data[at + 8] + 1) // 8) * 8
        elif kind == _LABELLED:
            at += 8 + 4 * max(0, number(at + 4))
        elif kind == _DOCUMENT:
            at += 8 + 80 * max(0, number(at + 4))
        elif kind == _EXTENSION:
            at += 16 + max(0, number(at + 8)) * max(0, number(at + 12))
        elif kind == _END:
            return 0 if variables and at + 8 <= len(data) else BROKEN
        else:
            return BROKEN
    return BROKEN


# ---- encoders, for tests ------------------------------------------------------------------------


def make_dxf(sections: dict[str, list[tuple[int, str]]]) -> bytes:
    pairs = [p for name, rows in sections.items() for p in ((0, "SECTION"), (2, name), *rows, (0, "ENDSEC"))]
    return "".join(f"{c:3d}\n{v}\n" for c, v in [*pairs, (0, "EOF")]).encode("latin-1")


def make_sav(names: list[str], label: bytes = b"") -> bytes:
    n4 = lambda v: v.to_bytes(4, "little", signed=True)
    head = b"$FL2@(#) SPSS DATA FILE".ljust(64) + n4(2) + n4(len(names)) + n4(0) * 2 + n4(0) + bytes(8)
    out = head.ljust(176, b" ")
    for name in names:
        out += n4(2) + n4(0) + n4(1 if label else 0) + n4(0) + n4(0) * 2 + name.encode("latin-1").ljust(8)[:8]
        if label:
            out += n4(len(label)) + label.ljust(-(-len(label) // 4) * 4)
    return out + n4(999) + n4(0)
