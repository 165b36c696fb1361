from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import quality_rules as op

ROOT = "/root/testdata/sf0.01"


def measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    spans = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(spans)
    hit = {k + j for k, s in enumerate(spans) if often[s] > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    marks = sum(text.count(c) for c in string.punctuation)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), len(lines), marks)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é.\x1f\x85 "), max_size=200))
def test_measures_equal_brute_force(text):
    assert op.measures(text.encode()) == measures(text)


def brute(rows, few=None):
    def low(v):
        return v if v < 1024 else (v >> (v.bit_length() - 10)) << (v.bit_length() - 10)

    docs = [(d, lang or "", src or "", measures(t)) for d, t, lang, src in rows]
    rate = lambda m: {
        "mark_rate": 1000 * m[6] // max(m[1], 1), "dup_line_rate": 1000 * m[3] // max(m[5], 1), "word_length": 100 * m[1] // max(m[0], 1)
    }
    held = defaultdict(list)
    for _, lang, src, m in docs:
        for name, v in rate(m).items() if m[0] else ():
            for key in ((0, lang, src), (1, lang), (2,)):
                if v or name != "dup_line_rate":
                    held[key, name].append(low(v))
    for values in held.values():
        values.sort()

    def quantile(values, q):
        places = [100 * (k + 1) for k in range(len(values))]
        return values[bisect_left(places, q * len(values))]

    enough = {"mark_rate": few or 200, "dup_line_rate": few or 20, "word_length": few or 200}
    multiple = {"mark_rate": (10, 1), "dup_line_rate": (5, 20), "word_length": (10, 2)}
    out = []
    for d, lang, src, m in docs:
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        kept = not failed
        for name, v in rate(m).items() if m[0] else ():
            near = [held[k, name] for k in ((0, lang, src), (1, lang)) if len(held[k, name]) >= enough[name]]
            values = [*near, held[(2,), name]][0]
            if not values:
                kept &= v <= 300
                continue
            first, middle, third = (quantile(values, q) for q in (25, 50, 75))
            many, least = multiple[name]
            far = many * max(least, min(middle - first, third - middle))
            kept &= v <= middle + far
            if name == "word_length":
                kept &= v >= max(middle - far, middle // 4)
        out.append((d, *m[:5], failed, kept))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    expected = brute([tuple(r) for r in documents])
    assert rows(op.op7_quality_rules(spark, ROOT)) == expected
    assert 0.5 < sum(r[-1] for r in expected) / len(expected) < 1


def test_good_documents_are_kept(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "quality")
    judged = op.op7_quality_rules(spark, root).join(labels, "doc_id").where("not base_failed")
    share = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.99
    assert share[0] < 0.05


def limits_of(spark, texts):
    rows = [(k, text, "en", source) for k, (source, text) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = op.cutoffs(op.measured(docs)).collect()
    return {r["source"]: {name: r[name] for name in found[0].asDict() if "_" in name} for r in found}


def some_texts(source, seed, lengths, n=300, marks=1):
    rnd = random.Random(seed)
    for _ in range(n):
        words = ["x" * rnd.choice(lengths) for _ in range(60)]
        for k in rnd.sample(range(60), marks * rnd.randint(1, 4)):
            words[k] += ","
        if rnd.random() < 0.3:
            words[30:30] = ["\nsame line\n"] * rnd.randint(1, 6)
        yield source, " ".join(words)


def test_sources_of_different_spread_have_different_cutoffs(spark):
    narrow, wide = list(some_texts("narrow", 1, [4, 5, 6])), list(some_texts("wide", 2, range(1, 10), marks=6))
    found = limits_of(spark, narrow + wide)
    for name in ("most_mark_rate", "most_word_length"):
        assert found["narrow"][name] < found["wide"][name]
    assert 0 < found["wide"]["least_word_length"] < found["narrow"]["least_word_length"]
    # No cutoff is the one of a spread at its least.
    assert found["narrow"]["most_word_length"] - 500 > 10 * op.RULES["word_length"].least
    assert all(limits["most_dup_line_rate"] != op.RULES["dup_line_rate"].otherwise for limits in found.values())


@pytest.mark.parametrize("junk", ["long" * 40, "z", "$$$ ### ***"])
def test_junk_does_not_loosen_its_own_source(spark, junk):
    clean = list(some_texts("s", 3, [3, 4, 5, 6, 7]))
    rotten = [("s", (junk + " ") * 60)] * 60  # a sixth of all
    before, after = limits_of(spark, clean)["s"], limits_of(spark, clean + rotten)["s"]
    for name, end in before.items():
        assert abs(after[name] - end) <= 0.35 * end
    judged = spark.createDataFrame([(k, t, "en", s) for k, (s, t) in enumerate(clean + rotten)], "doc_id long, text string, lang string, source string")
    stats = op.measured(judged).collect()
    outside = [
        not (after["least_word_length"] <= 100 * r["word_chars"] // r["n_words"] <= after["most_word_length"])
        or 1000 * r["n_marks"] // r["word_chars"] > after["most_mark_rate"]
        for r in sorted(stats, key=lambda r: r["doc_id"])
    ]
    assert all(outside[len(clean) :]) and sum(outside[: len(clean)]) <= 3


def test_cutoffs_of_the_test_tables_adapt(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = op.cutoffs(op.measured(documents)).collect()
    assert len(found) == 80
    assert min(r["least_word_length"] for r in found) > 300
    for name in ("most_mark_rate", "most_word_length", "least_word_length", "most_dup_line_rate"):
        assert len({r[name] for r in found if r["lang"] == "en"}) >= 3, name


TEXTS = [
    *((k, " ".join(f"word{j}{k}" for j in range(30)), "en", "a") for k in range(30)),
    (30, "### " * 40 + "word " * 25, "en", "a"),
    (30, "### " * 40 + "word " * 25, "en", "a"),
    (None, " ".join("abcdefgh") + " x" * 30, None, None),
    (31, None, None, "b"),
    (32, "", "en", None),
    (33, "one two three\n" * 30, "fr", "c"),
    (34, " ".join(f"w{j}" for j in range(30000)), "fr", "c"),
]


def test_odd_rows_and_both_joins(spark, monkeypatch):
    odd = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, lang string, source string, n_words string")
    expected = brute(TEXTS, few=5)
    assert rows(op.judged(odd, few=5)) == expected
    monkeypatch.setattr(op, "is_small", lambda df: False)
    assert rows(op.judged(odd, few=5)) == expected
    assert op.judged(odd.limit(0)).count() == 0


def test_sketches_merge(spark):
    values = [0, 5, 63, 64, 1023, 1024, 1025, 12345, 10**6]
    frame = spark.createDataFrame([(v,) for v in values], "v long").select("v", op.bucket(F.col("v")).alias("b"))
    for r in frame.collect():
        assert r["b"] == r["v"] or r["v"] > 1023
        assert r["b"] <= r["v"] <= r["b"] + r["b"] / 512


