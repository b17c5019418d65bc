"""op1: formatting and its way back."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from wrackline.llm import chat, queries

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "<", "[", "s>", "INST]", "/", "user", "[\\INST]", "<\\s>", "é", "😀", " ok "]
TEXT = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_any_turns_come_back(turns):
    assert chat.parse(chat.render(turns)) == turns


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escape_is_undone(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_plain_text_is_not_touched():
    assert chat.render_turn("user", "no marks here") == chat.OPEN + "user\nno marks here" + chat.CLOSE


def brute(rows) -> dict:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, chat.render_turn(role, text), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_query_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op1_chat_round_trip(spark, sf_dir).collect()}
    assert got == brute(rows)
    assert got[-7][2] == 21


def test_odd_rows_and_empty_table(spark):
    rng = random.Random(1)
    rows = [(None, None, None, None), (None, 1, "user", "a"), (3, 2, "assistant", "x" * 200_000), (3, 1, "user", ""), (3, 1, "user", ""), (4, 0, "assistant", None), (5, 0, "As\nsist\\ant", "</s>" * 2000)]
    rows += [(6, i, rng.choice(["user", "assistant"]), "t" * i) for i in range(50)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(table).collect()}
    assert got == brute(rows)
    assert chat.read_back(table.limit(0)).collect() == []


def test_loss_spans_of_the_formatted_table(spark):
    table = spark.createDataFrame([(1, 0, "user", "[INST]"), (1, 1, "assistant", "a </s> b")], "conv_id bigint, turn bigint, role string, text string")
    parts = chat.format_conversations(table).orderBy("turn").collect()
    assert parts[0].loss_start is None
    assert chat.unescape(parts[1].part[parts[1].loss_start : parts[1].loss_end]) == "a </s> b"


def test_whole_conversations_parse_as_one_string(spark, sf_dir):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn is not None, r.turn or 0, chat.render_turn(r.role, r.text), r.role or "", r.text or ""))
    got = {r.conv_id: r.formatted_chars for r in queries.op1_chat_round_trip(spark, sf_dir).collect()}
    for conv, turns in by.items():
        turns = [(role, text) for *_, role, text in sorted(turns)]
        whole = chat.render(turns)
        assert chat.parse(whole) == turns and got[conv] == len(whole)
