from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

sys.path.append(str(Path(__file__).parents[1]))

from compare import connect, spark_rows, sql_rows  # noqa: E402

from shelfmark.llm import licenses as op  # noqa: E402
from shelfmark.llm.common import ALNUM_WORD  # noqa: E402

ROOT = "/root/testdata/sf0.01"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = op.rules()


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(UPPER, UPPER.lower())))


def brute(doc, text):
    words = words_of(text)
    places = []
    for phrase, label in op.BASE.items():
        parts = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(parts)] == parts]
    labels = {label for _, label in places}
    spans, best = [], 0.0
    joined = " " + " ".join(words) + " "
    if re.search(op.HINT, text or "", re.ASCII):
        for number, rule in enumerate(RULES):
            if f" {rule.keyword} " not in joined:
                continue
            for found in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", joined):
                first = joined.count(" ", 0, found.start()) - 1
                spans.append((first, first + found[0].count(" ") + 1, number))
    kept = [
        s
        for s in spans
        if not any(
            o[0] <= s[0] and o[1] >= s[1] and (o[:2] != s[:2] or o[2] < s[2]) for o in spans
        )
    ]
    every = labels | {RULES[n].label for _, _, n in kept}
    best = max((RULES[n].score for _, _, n in kept), default=0.0)
    starts = [k for k, _ in places]
    return (
        doc, len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(sorted(every)), best,
    )


def test_rules_are_hundreds_and_compile():
    assert len(RULES) > 300
    assert all(re.compile(rule.pattern) and 0 < rule.score <= 1 for rule in RULES)
    for rule in RULES:
        assert rule.keyword == rule.keyword.lower()


def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(brute(*r) for r in documents)
    assert sum(r[2] for r in expected) > 10
    assert sorted(map(tuple, op.op2_license_scans(spark, ROOT).collect())) == expected


TEXTS = [
    (1, "Licensed under the GNU  General-Public License, version 3 or later. MIT license"),
    (1, "Licensed under the GNU  General-Public License, version 3 or later. MIT license"),
    (None, "cc BY-nc-sa 4.0; CC-BY. apache\nlicense apache License 2.0"),
    (2, None),
    (3, ""),
    (4, "mit license " * 300 + "word " * 5000 + "mit license"),
    (5, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    (6, "submit license; mit licenses; émit license ccby"),
    (7, "SPDX-License-Identifier: Apache-2.0 / lgpl: gnu lesser general public licence v2.1"),
    (8, "released under the Creative Commons Attribution-ShareAlike 3.0 license"),
    (9, "ALL CAPS camelCase\u00c9t\u00e9 9x"),
]


def test_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame([(*r, "x", 1) for r in TEXTS], "doc_id long, text string, words string, found int")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op.op2_license_scans(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((brute(*r) for r in TEXTS), key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[1][6] == "gpl,gpl-3,mit"
    assert by_id[None][6] == "apache,apache-2.0,cc-by,cc-by-nc-sa-4.0"
    assert by_id[7][6] == "apache-2.0,lgpl-2.1"
    assert by_id[8][6] == "cc-by-sa-3.0"
    assert (by_id[2][1], by_id[3][1], by_id[9][1]) == (0, 0, 4)
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op.op2_license_scans(spark, f"{tmp_path}/none").count() == 0


def base_sql():
    """The columns of the base rules; those of the method's own rules have no SQL form."""
    phrases = " UNION ALL ".join(
        f"SELECT '{label}' AS label, {phrase.split()!r} AS parts" for phrase, label in op.BASE.items()
    )
    return f"""
        WITH doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{ALNUM_WORD}') AS ws
            FROM documents),
        place AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS k FROM doc),
        hit AS (
            SELECT doc_id, k - 1 AS k, label FROM place, ({phrases})
            WHERE ws[k] = parts[1] AND ws[k:k + len(parts) - 1] = parts)
        SELECT doc_id, len(ws) AS n_words, count(k) AS n_base, min(k) AS first_word, max(k) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM doc LEFT JOIN hit USING (doc_id) GROUP BY ALL"""


@pytest.mark.parametrize("root", ["/root/testdata/sf0.001", ROOT])
def test_base_columns_equal_sql(spark, root):
    found = op.op2_license_scans(spark, root).drop("labels", "score")
    names, rows = spark_rows(found)
    assert (names, rows) == sql_rows(connect(root), base_sql())


def test_only_built_in_functions(spark):
    plan = op.op2_license_scans(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def ungated(text):
    """Labels and score by every pattern, without keywords and hint."""
    joined = " " + " ".join(words_of(text)) + " "
    spans = [
        (found.start(), found.end(), number)
        for number, rule in enumerate(RULES)
        for found in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", joined)
    ]
    kept = [s for s in spans if not any(o[0] <= s[0] and o[1] >= s[1] and (o[:2] != s[:2] or o[2] < s[2]) for o in spans)]
    return ",".join(sorted({RULES[n].label for *_, n in kept})), max((RULES[n].score for *_, n in kept), default=0.0)


def test_keywords_and_hint_lose_nothing(spark, tmp_path):
    alternatives = [
        "Expat License", "licensed under the expat licence", "FreeBSD license", "released under the FreeBSD License",
        "0BSD license", "provided under the terms of the 0bsd licence", "MIT X11 license", "simplified bsd license",
        "zero clause BSD license", "gnu gpl v3", "wtfpl", "creative commons zero 1.0", "the unlicense", "public domain dedication and license",
        "dedicated to the public domain", "all rights reserved this software is proprietary", "cecill b license", "zlib libpng license",
    ]
    rows = [(k, f"some words {text} and more") for k, text in enumerate(alternatives)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in op.op2_license_scans(spark, str(tmp_path)).collect()}
    assert got == {k: ungated(text) for k, text in rows}
    assert [got[k] for k in (0, 1, 2, 4)] == [("mit", 0.7), ("mit", 0.9), ("bsd-2-clause", 0.7), ("bsd-0-clause", 0.7)]


def test_every_match_holds_its_keyword():
    def shortest(parts):
        """The words of every branch, repeats at their least, so that nothing optional helps."""
        out = [""]
        for kind, value in parts:
            name = str(kind)
            if name == "LITERAL":
                more = [chr(value)]
            elif name == "IN":
                more = ["x"] if str(value[0][0]) != "LITERAL" else [chr(value[0][1])]
            elif name == "BRANCH":
                more = [one for branch in value[1] for one in shortest(branch)]
            elif name == "SUBPATTERN":
                more = shortest(value[3])
            else:
                more = [one * max(value[0], 0) for one in shortest(value[2])] if value[0] else [""]
            out = [a + b for a in out for b in more]
        return out

    for rule in RULES:
        for text in shortest(re._parser.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, text) and f" {rule.keyword} " in f" {text} ", (rule, text)
            assert re.search(op.HINT, text, re.ASCII), (rule, text)
