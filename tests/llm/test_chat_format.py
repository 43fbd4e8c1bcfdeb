import hashlib
import json
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rasterloom.llm import chat_format as C

CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello <turn>\n</turn> \\ there"), (1, 2, "assistant", None), (2, 1, "assistant", "late"), (2, 0, "system", ""), (3, 0, None, "no role"), (3, 0, "user", "tie b"),
    (3, 0, "user", "tie a"), (None, 0, "assistant", "no id"), (4, None, "user", "no turn"), (4, 0, "ro\nle<", "é\U0001f600"), (5, 0, "user", "same"), (5, 0, "user", "same"),
]


def brute(rows):
    rows = [*rows, (-7, 0, "user", C.TRICKY), (-7, 1, "assistant", C.TRICKY)]
    out = []
    for i in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "", r[1]) for r in rows if r[0] == i]
        own.sort(key=lambda x: (x[2] is not None, x[2] or 0, C.render(x[0], x[1])[0].encode()))
        said = "".join(t for r, t, _ in own if r == "assistant")
        out.append((i, len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _ in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(C.render(r, t)[0]) for r, t, _ in own)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as piece", "'y' as record", "'z' as layout")
    assert sorted((tuple(r) for r in C.op4_chat_format(rows).collect()), key=repr) == brute(CONVERSATIONS)
    assert [r["conv_id"] for r in C.op4_chat_format(rows.where("false")).collect()] == [-7]


TEXT = st.text(st.characters(exclude_categories=["Cs"])) | st.text(st.sampled_from("\\\\</turn>\nx"))


@given(TEXT, TEXT)
def test_round_trip(role, text):
    piece, begin, end = C.render(role, text)
    assert C.parse(piece) == (role, text)
    assert C.unescape(piece[begin:end]) == (text if role == "assistant" else "")


@given(st.lists(st.tuples(TEXT, TEXT)))
def test_turns_of_a_whole_conversation_are_told_apart(turns):
    whole, at, got = "".join(C.render(*t)[0] for t in turns), 0, []
    while at < len(whole):
        end = next(m.end() for m in re.finditer(r"\\.|(</turn>\n)", whole[at:], re.DOTALL) if m.group(1)) + at  # the first unescaped mark
        got.append(C.parse(whole[at:end]))
        at = end
    assert got == turns


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": "7"}, "from_value", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done", "system": "be"}, "instruction", [("system", "be"), ("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": "c", "context": "k"}, "question_answer", [("user", "k\np"), ("assistant", "c")]),
    ({"messages": []}, "messages", []),
    ({"role": "user", "text": None}, "turn", [("user", "")]),
    ({"foo": 1}, None, []),
]


@pytest.mark.parametrize(("record", "layout", "turns"), RECORDS)
def test_layouts(record, layout, turns):
    assert C.turns(record) == (layout, turns)


def test_records_in_spark(spark):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, None), (91, "not json"), (92, "[1]")], "k int, record string")
    got = C.format_records(rows).orderBy("k", "seq").collect()
    want = [(i, layout, *t) for i, (_, layout, turns) in enumerate(RECORDS) for t in (turns or ([] if layout else [(None, None)]))] + [(k, None, None, None) for k in (90, 91, 92)]
    assert [(r["k"], r["layout"], *(C.parse(r["piece"]) if r["piece"] else (None, None))) for r in got] == want


def test_the_fingerprint_ignores_order_and_values():
    a = C.fingerprint(C.paths({"b": [{"x": 1}], "a": "s"}))
    assert a == C.fingerprint(C.paths({"a": None, "b": [{"x": "y"}, {"x": 2}]})) != C.fingerprint(C.paths({"a": None, "b": {"x": 2}}))
