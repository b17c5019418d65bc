"""Archives: members, and office documents by what they contain."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

LEAST = 1024
#: Members that tell a kind of document; the last one found decides.
PARTS = {
    "docx": ("word/document.xml", "word/fontTable.xml", "word/settings.xml", "word/styles.xml", "word/theme/theme1.xml"),
    "xlsx": ("xl/worksheets/sheet1.xml", "xl/styles.xml", "xl/theme/theme1.xml", "xl/sharedStrings.xml"),
    "pptx": ("ppt/presentation.xml", "ppt/theme/theme1.xml", "ppt/slides/slide1.xml", "ppt/slideMasters/slideMaster1.xml"),
}
VIEWER = "outputViewer000"
_KIND = {name: kind for kind, names in PARTS.items() for name in names}
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, ValueError, RuntimeError)


def check_xml(data: bytes) -> int:
    """0 if well-formed, else 1."""
    try:
        ElementTree.fromstring(data)
    except (ElementTree.ParseError, ValueError, LookupError):
        return 1
    return 0


def members(data: bytes) -> Iterator[dict]:
    """name, size, packed, method, encrypted, and content (null where it cannot be read) of each file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            content = None
            if not info.flag_bits & 1:
                try:
                    content = z.read(info)
                except _BROKEN:
                    content = None
            yield {"name": info.filename, "size": info.file_size, "packed": info.compress_size, "method": info.compress_type, "encrypted": bool(info.flag_bits & 1), "content": content}


def check_zip(data: bytes) -> tuple[int, str]:
    """Errors and kind: 1 for each unreadable member and each listed part that is no XML, 10 if it does not open."""
    errors, kind = 0, "zip"
    try:
        for m in members(data):
            if m["size"] < LEAST or m["encrypted"]:
                continue
            if m["content"] is None:
                errors += 1
                continue
            viewer = m["name"].startswith(VIEWER)
            kind = "spv" if viewer else _KIND.get(m["name"], kind)
            if viewer or m["name"] in _KIND or m["name"] == "[Content_Types].xml":
                errors += check_xml(m["content"])
    except _BROKEN:
        errors += 10
    return errors, kind


def make_zip(files: dict[str, bytes], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6)), content, method)
    return out.getvalue()
