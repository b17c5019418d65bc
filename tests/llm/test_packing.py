"""op9: every id in one piece, against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from wrackline.llm import packing, queries


def check(rows, pieces) -> None:
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s, n in packing.pieces(len(ids)):
            want[d, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    assert all(p.offset == 0 and p.length & (p.length - 1) == 0 and p.length <= 2048 for p in pieces)
    assert len({p.sequence_id for p in pieces}) == len(pieces)


def test_query_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op9_packing(spark, sf_dir).collect())


def test_odd_rows_and_empty_table(spark, odd_docs, odd_rows, no_docs):
    check(odd_rows, packing.pack(odd_docs).collect())
    assert packing.pack(no_docs).collect() == []


def test_quick_way_and_tokenizer_agree():
    encoder = packing.Encoder.load(packing.default_tokenizer())
    texts = ["it's we'll I'D", "  lead  and trail  ", "a\u00a0b\u2003c", "x\r\n\ty\n\n\nz", "1234 5.6 ½ ²", "<|endoftext|> <s> </s>", "日本語 текст 😀", "\x85\x1c\x1f\u2028", "é" * 999, "İstanbul ſ", "don''t 'S 've"]
    for t in texts:
        assert encoder.ids(t) == encoder.whole(t)


def test_ids_are_returned_on_request(spark):
    docs = spark.createDataFrame([(1, "hello world " * 1500)], "doc_id bigint, text string")
    rows = packing.pack(docs, with_ids=True).orderBy("start").collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    assert Tokenizer.from_file(packing.default_tokenizer()).decode(ids[:-1].tolist()) == "hello world " * 1500
    assert ids[-1] == 1


def test_very_long_runs(spark):
    texts = [" " * 1_000_000, "\n" * 3_000_000, "a" + "\t" * 1_000_000 + "b", " \n\t\xa0" * 300_000, "x" * 1_000_000, "7" * 1_000_000, "-" * 1_000_000, "é" * 300_000, (" " * 9_999 + "w") * 40]
    docs = list(enumerate(texts))
    check(docs, packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())


def test_one_encoder_for_each_process(spark):
    path = packing.default_tokenizer()

    def run(batches):
        import os

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (os.getpid(), id(packing.Encoder.load(path)))], names=["pid", "at"])

    seen = {(r.pid, r.at) for _ in range(3) for r in spark.range(0, 64, 1, 8).mapInArrow(run, "pid long, at long").collect()}
    assert len(seen) == len({pid for pid, _ in seen})
