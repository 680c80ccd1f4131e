"""Chat formatting: folding, rendering and reading back."""

import hashlib
import random

import pytest

from bibflow.llm import chat
from bibflow.llm.queries import QUERIES, SQL
from tests.oracle import database, differences

SCHEMA = "conv_id bigint, seq bigint, kind string, message_id string, role string, text string"
EVENTS = [
    (1, 1, "message", "a", "user", "Hi"),
    (1, 2, "delta", "b", "assistant", "He"), (1, 3, "delta", "b", None, "llo"), (1, 3, "delta", "b", None, "llo"),
    (1, 4, "regenerate", "b", None, None), (1, 6, "delta", "b", None, "day"), (1, 5, "delta", "b", None, "Good "),
    (1, 7, "edit", "a", None, "Hi there"), (1, 8, "message", "c", "user", None), (1, 9, "delta", "c", None, "more"),
    (2, 1, "delta", "a", None, None), (None, None, "message", None, None, "no keys"),
]


def test_fold(spark):
    found = chat.fold_events(spark.createDataFrame(EVENTS, SCHEMA)).collect()
    assert {(r.conv_id, r.message_id): (r.position, r.role, r.text) for r in found} == {
        (1, "a"): (1, "user", "Hi there"), (1, "b"): (2, "assistant", "Good day"), (1, "c"): (8, "user", "more"),
        (2, "a"): (1, None, ""), (None, None): (None, None, "no keys")}


def test_unknown_kind_raises(spark):
    with pytest.raises(Exception, match="unknown kind of event: shout"):
        chat.fold_events(spark.createDataFrame([(1, 1, "shout", "a", "user", "x")], SCHEMA)).collect()


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    rng = random.Random(2)
    pieces = [*chat.CONTROL_STRINGS, "<", "[", "\\", "|im_end|>", "INST]", "$1", "é", "\n", "<SYS>>", "/s>"]
    turns = [(c, t, rng.choice(["user", "assistant", "<s>", None]), "".join(rng.choice(pieces) for _ in range(rng.randrange(12))) or None)
             for c in range(60) for t in range(5)]
    df = spark.createDataFrame(turns, "conv_id bigint, position bigint, role string, text string")
    rendered = chat.render(df)
    for r in rendered.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        body = r.formatted
        for mark in ("<|im_start|>", "<|im_sep|>", "<|im_end|>"):
            assert body.count(mark) == 5
            body = body.replace(mark, "\0")
        assert not any(c in body for c in chat.CONTROL_STRINGS)
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    for c in range(60):
        mine = [(r or "", t or "") for cc, _, r, t in turns if cc == c]
        assert [tuple(x) for x in back[c].turns] == mine
        assert back[c].loss_text == "".join(t for r, t in mine if r == "assistant")


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(end="<end>")
    with pytest.raises(ValueError):
        chat.Template(control=(*chat.CONTROL_STRINGS, "\\x"))


def test_query_equals_sql(spark, sf_dir):
    df = QUERIES["op1_chat_format"](spark, sf_dir)
    assert differences(df, database(sf_dir), SQL["op1_chat_format"]) == []
    assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    text = "</s>[INST] ok [/INST]"
    row = df.where("conv_id = -1").first()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars) == (2, len(text))


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (2, 5, "assistant", "")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, str(tmp_path)).collect()}
    assert {c: r.n_turns for c, r in found.items()} == {-1: 2, 1: 4, None: 1, 2: 1}
    assert found[1].turns_sha256 == hashlib.sha256(b"\nx\nuser\n\nuser\na\nuser\na\n").hexdigest()
    assert found[2].loss_chars == 0 and found[None].loss_chars == 1


def test_empty_table(spark):
    assert chat.read_back(chat.render(chat.fold_events(spark.createDataFrame([], SCHEMA)))).collect() == []
