"""Layouts, the template and its way back."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listforge.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def _escape(t, role=False):
    t = t.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")
    return t.replace(">", "\\>") if role else t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab>\\<turn/ \n"), st.text("<turn/>\\ \nab")), max_size=4))
def test_template_is_reversible(turns):
    out = "".join(f"<turn {_escape(r, True)}>\n{_escape(t)}\n</turn>\n" for r, t in turns)
    assert list(chat.parse(out)) == turns


def test_layouts_of_tables(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    tables = [
        spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")], "x")],
                              "conv_id long, messages array<struct<role: string, content: string>>, extra string"),
        spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])],
                              "conv_id long, conversations array<struct<from: string, value: string>>"),
        spark.createDataFrame([(1, "hi", None, "yo")], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, "hi", "yo")], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], ROWS),
        spark.createDataFrame([(1, [("user", "hi")], [("assistant", "yo")])],
                              "conv_id long, prompt array<struct<role: string, content: string>>, "
                              "completion array<struct<role: string, content: string>>"),
    ]
    for t in tables:
        got = [(r["role"], r["text"]) for r in chat.canonical_turns(t).orderBy("turn").collect()]
        assert got == want, t.columns
    with pytest.raises(ValueError, match="no layout for fingerprint"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, other string"))


def test_json_records_of_mixed_layout(spark):
    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "k": 1})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]})),
        (3, json.dumps({"instruction": "a", "input": "c", "output": "b"})),
        (4, json.dumps({"prompt": "a", "response": "b", "system": "s"})),
        (5, "not json"), (6, None), (7, "[1]"),
    ]
    df = spark.createDataFrame(records, "conv_id long, j string")
    got = {}
    for r in chat.canonical_turns_of_json(df, "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "a"), ("assistant", "b")],
                   3: [("user", "a\nc"), ("assistant", "b")], 4: [("system", "s"), ("user", "a"), ("assistant", "b")],
                   5: [("unknown", "not json")], 6: [("unknown", "")], 7: [("unknown", "[1]")]}


def test_read_back_of_edge_rows(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\### Assistant: </turn> ok"),
            (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, 0, None, None), (2, 1, "assistant", None),
            (None, None, "assistant", "é\n<turn user>\nno"), (3, 0, "a>b", "x" * 300_000), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, ROWS)
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted_turns(chat.canonical_turns(df))).collect()}
    for conv in (1, 2, None, 3):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        said = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(said)
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    none = spark.createDataFrame([], ROWS)
    assert chat.read_back(chat.formatted_turns(chat.canonical_turns(none))).count() == 0
