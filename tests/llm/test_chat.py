from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import chat as op

ROOT = "/root/testdata/sf0.01"
PLAIN = op.Template()
SPECIAL = st.lists(st.sampled_from(["\\", "#", "##", "###", "</turn>", " </turn>\n", ": ", "=", "a", "é", "\n", "User"]), max_size=8).map("".join)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    by_id: dict = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by_id.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(learned), digest(learned)))
    return sorted(out, key=repr)


def rows(df):
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    source = spark.read.parquet(f"{ROOT}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    own = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = op.op9_chat_formatting(spark, ROOT)
    assert rows(got) == brute([*map(tuple, source), *own])
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got.collect())
    assert all(r["valid"] for r in got.collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), SPECIAL), SPECIAL), max_size=5))
def test_formatted_text_reads_back(turns):
    text = "".join(part for role, said in turns for part, _ in PLAIN.segments(role, said))
    pattern, at, found = PLAIN.reader(), 0, []
    while m := pattern.match(text, at):
        found.append((PLAIN.role_of(m[1]), PLAIN.unescaped(m[2])))
        at = m.end()
    assert at == len(text) and found == turns


@pytest.mark.parametrize(
    "roles,valid",
    [("ua", True), ("sua", True), ("uaua", True), ("u", True), ("sus", False), ("au", False), ("uua", False), ("usa", False), ("ss", False), ("uax", False)],
)
def test_machine(roles, valid):
    names, state = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}, "start"
    for role in roles:
        state = op.step(state, names[role])
    assert (state in op.ACCEPTED) == valid


def test_odd_rows(spark):
    source = [
        (1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 0, "user", "one"), (1, None, "system", "zero"),
        (None, 0, "user", "alone"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "tool: x", "###"),
        (4, 0, "user", "long " * 40000), (4, 1, "assistant", "</turn>" * 5000), *((5, k, "user", "x") for k in range(3000)),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in source], "conv_id long, turn long, role string, text string, position int")
    assert rows(op.digests(op.segments(frame))) == brute(source)
    texts = {r["conv_id"]: r for r in op.formatted(frame.where("conv_id = 1 or conv_id = 2")).collect()}
    assert texts[1]["text"] == "### System: zero </turn>\n### User: one </turn>\n### User: one </turn>\n### Assistant: two </turn>\n"
    assert not texts[1]["valid"]
    (span,) = texts[1]["loss"]
    assert texts[1]["text"][span["start"] : span["end"]] == "two"
    assert op.digests(op.segments(frame.limit(0))).count() == 0
    with pytest.raises(ValueError):
        op.Template(closing="\n")
