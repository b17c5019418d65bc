"""Times that documents carry inside, as unix seconds in UTC."""

from __future__ import annotations

import io
import zipfile
from datetime import UTC, datetime
from xml.etree import ElementTree

#: Fixed value: times of compound files up to here are those of templates and empty fields.
OLE_SINCE = 852_076_801


def iso_time(text: str) -> int | None:
    """Seconds of an ISO date with time; one without a zone counts as UTC."""
    try:
        when = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())


def ooxml_time(data: bytes) -> int | None:
    """The latest of the core properties' dates."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("docProps/core.xml"))
    except Exception:
        return None
    found = [t for child in root if (child.text or "").startswith("20") and (t := iso_time(child.text)) is not None]
    return max(found, default=None)


def ole_time(data: bytes) -> int | None:
    """Last saved, else created, if late enough to be meant."""
    from wrackline.functions.ole import CompoundFile, OleError, summary_times

    try:
        saved, created = summary_times(CompoundFile(data))
    except OleError:
        return None
    when = saved or created
    return when if when and when > OLE_SINCE else None


def document_time(data: bytes) -> int | None:
    if data[:4] == b"PK\x03\x04":
        return ooxml_time(data)
    return ole_time(data) if data[:4] == b"\xd0\xcf\x11\xe0" else None
