r"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>[INST]role\ntext[/INST]</s>`` and a conversation
is its turns one after another.  :func:`parse` is a deterministic parser of
that grammar.  A turn is rendered plainly first and parsed again; while what
comes back differs from the source, one more control string that the text
holds is escaped, until both are identical.

Escaping puts a backslash after the first character of a control string, and
one more where such backslashes stand already (``[INST]`` to ``[\INST]``,
``[\INST]`` to ``[\\INST]``), so it can be undone exactly and with every
control string escaped no text can fail.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[INST]", "[/INST]</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)
_ESCAPED = {c: re.compile(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:])) for c in CONTROL}
_UNDO = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))


class GrammarError(ValueError):
    """The text is no sequence of turns."""


def escape(text: str, control: tuple[str, ...] | list[str] = CONTROL) -> str:
    for c in control:
        text = _ESCAPED[c].sub(lambda m, c=c: c[0] + m[1] + "\\" + c[1:], text)
    return text


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def spans(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of each turn's text in a formatted conversation.

    No control string may stand between the marks of a turn; this is what
    makes a plain text with one in it come back different, or not at all.
    """
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise GrammarError(f"no turn opens at {at}")
        head = _HEAD.match(formatted, at + len(OPEN))
        if not head:
            raise GrammarError(f"no role ends after {at}")
        end = formatted.find(CLOSE, head.end())
        if end < 0:
            raise GrammarError(f"the turn at {at} does not close")
        if any(formatted.find(c, head.end(), end) >= 0 for c in CONTROL):
            raise GrammarError(f"a control string stands inside the turn at {at}")
        yield _role_in(head[1]), head.end(), end
        at = end + len(CLOSE)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; :class:`GrammarError` where the grammar does not fit."""
    return [(role, unescape(formatted[a:b])) for role, a, b in spans(formatted)]


def render_turn(role: str | None, text: str | None) -> str:
    """The turn, with as few control strings escaped as the round trip takes; null counts as empty."""
    role, text = role or "", text or ""
    head, held = OPEN + _role_out(role) + "\n", [c for c in CONTROL if _ESCAPED[c].search(text)]
    for n in range(len(held) + 1):
        turn = head + escape(text, held[:n]) + CLOSE
        try:
            if parse(turn) == [(role, text)]:
                return turn
        except GrammarError:
            continue
    raise GrammarError("no escape makes the turn come back")


def render(turns: list[tuple[str | None, str | None]]) -> str:
    return "".join(render_turn(r, t) for r, t in turns)


def render_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, part: each row rendered by itself, before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [render_turn(r.as_py(), t.as_py()) for r, t in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part, pa.string())], names=["conv_id", "turn", "part"])

    kinds = dict(conversations.dtypes)
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, part string")


class _Reading:
    """Digests of one conversation, taken turn by turn from its formatted parts."""

    def __init__(self) -> None:
        self.n = self.chars = self.loss_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, part: str) -> None:
        self.chars += len(part)
        for role, a, b in spans(part):
            text = unescape(part[a:b])
            self.n += 1
            for x in (role, "\n", text, "\n"):
                self.turns.update(x.encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rendered parts, each conversation whole in one partition and in turn order.

    Equal turns are ordered by what they say, so ties have one defined order.
    """
    return render_rows(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, part, loss_start, loss_end: the formatted text as a stream of parts.

    Parts in order make up a conversation; the loss span of a part, in its
    code points, is null for all but the assistant's turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = [next(((x, y) for r, x, y in spans(p.as_py()) if r == "assistant"), (None, None)) for p in b.column(2)]
            arrays = [*b.columns, pa.array([m[0] for m in masks], pa.int64()), pa.array([m[1] for m in masks], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "part", "loss_start", "loss_end"])

    kinds = dict(conversations.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, part string, loss_start long, loss_end long"
    return _ordered(conversations).mapInArrow(run, schema)


def read_back(conversations: DataFrame) -> DataFrame:
    """One row per conversation with digests parsed back from its formatted text.

    Rendering and its round trips run on every row before the shuffle.  After
    it a conversation is only streamed through the parser and two hashes, a
    part at a time, so one of any length takes constant memory; a SHA-256 has
    to be taken in order, and that alone is left to one task.  Rows with a
    null conv_id make one conversation; null turns come first in theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reading, done = None, None, []
        for b in batches:
            for conv, part in zip(b.column(0).to_pylist(), b.column(2)):
                if reading is None or conv != key:
                    if reading is not None:
                        done.append((key, *reading.row()))
                    key, reading = conv, _Reading()
                reading.add(part.as_py())
            if len(done) >= 1000:
                yield _rows(done, schema)
                done = []
        if reading is not None:
            done.append((key, *reading.row()))
        if done:
            yield _rows(done, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = f"conv_id {dict(conversations.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = to_arrow_schema(_parse_datatype_string(names))
    return _ordered(conversations).mapInArrow(run, names)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
