"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits
of n: whole pieces of ``max_len``, then one piece for each bit of the rest,
longest first.  Every piece is a sequence of its own, so no sequence crosses
documents and none needs padding; equal lengths share a bucket, from which a
trainer draws batches of one shape.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.llm.common import small_batches

MAX_LEN = 2048
END_ID = 1

# Texts of other characters than these, or with long runs of blanks, for which
# the quick library would run out of stack, go through the tokenizer itself.
_ODD = re.compile("[^\t\n\r\x0b\x0c\x20-\x7e\xa0-\u024f]")
_BLANKS = re.compile(r"\s{10000}")
_CHECK = "An ordinary  sentence, it's 12 words long:\n\n naïve façade (x_1) -- ~#? "


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    Where the file is a plain byte-level BPE whose order of ids is its order
    of merges, texts of common characters are merged by the same table in a
    quicker library; both must agree on a line of text first.  Everything
    else is left to the tokenizer.
    """

    @classmethod
    def load(cls, path: str) -> "Encoder":
        """One encoder for each file and worker process.

        This module reaches each task by value, so what a process keeps is
        in a module of its own.
        """
        held = vars(sys.modules.setdefault("_wrackline_worker", types.ModuleType("_wrackline_worker")))
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = self._quick(path)

    def _quick(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, cut = whole["model"], whole.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or whole.get("normalizer"):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(plain)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
        vocab = {w: i for w, i in model["vocab"].items() if w not in self.special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [vocab[w] for w in merged]
        if any(a >= b for a, b in zip(order, order[1:])) or len(vocab) != len(merged) + 256:
            return None
        ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items()}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        quick = tiktoken.Encoding("quick", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return quick if quick.encode_ordinary(_CHECK) == self.tokenizer.encode(_CHECK, add_special_tokens=False).ids else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.quick or _ODD.search(text) or _BLANKS.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(n: int, max_len: int = MAX_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; ``max_len`` is a power of two."""
    out = [(s, max_len) for s in range(0, n - n % max_len, max_len)]
    start, size = n - n % max_len, max_len >> 1
    while size:
        if n & size:
            out.append((start, size))
            start += size
        size >>= 1
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, one sequence each.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset (0), bucket (log2 of the length), and ``ids`` on request.  A null
    or empty text is the end id alone.  Rows are independent: one narrow
    pass, no shuffle.  ``sequence_id`` is unique in the result: bucket, task
    and running number, so a task that is run again renumbers only itself.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.load(path)
        task = TaskContext.get().partitionId() << 32
        count = 0
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for start, length in pieces(n, max_len):
                    own = ids[4 * start : 4 * (start + length)]
                    bucket = length.bit_length() - 1
                    rows.append((doc, start, length, zlib.crc32(own), n, (bucket << 56) | task | count, 0, bucket, own))
                    count += 1
                if len(rows) >= 20_000:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    kind = dict(docs.dtypes)["doc_id"]
    names = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
    names += ", ids binary" if with_ids else ""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    docs = docs.select("doc_id", F.col("text").cast("string"))
    schema = to_arrow_schema(_parse_datatype_string(names))
    return docs.mapInArrow(run, names)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
