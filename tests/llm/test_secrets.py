from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from shelfmark.llm import secrets as op
from shelfmark.llm.common import written

ROOT = "/root/testdata/sf0.01"


def spans_of(text, rules):
    found = []
    for rule in rules:
        kind = op.KINDS.index(rule.kind)
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def brute(doc, text):
    def shown(spans):
        return ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in spans)

    base = spans_of(text, op.BASE)
    counts = [sum(k == n for _, k, _ in base) for n in range(3)]
    every = sorted(base + spans_of(text, op.MORE))
    return (doc, *counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((brute(*r) for r in documents), key=repr)
    assert sum(r[1] + r[2] + r[3] for r in expected) > 5
    assert rows(op.op3_secret_scans(spark, ROOT)) == expected


KEY = "AKIA" + "ABCDEFGH12345678"
TEXTS = [
    (1, f"é𝒳 password: hunter22xx {KEY} and {KEY[:12]}"),
    (1, f"é𝒳 password: hunter22xx {KEY} and {KEY[:12]}"),
    (None, 'API_KEY = "abcd.efgh+ij/=" token=secret=abcdefgh1 TOKEN=a secret:longenough1'),
    (2, None),
    (3, ""),
    (4, ("deadbeef" * 5 + " ") * 400 + "z" * 20000 + "f" * 31),
    (5, "ghp_" + "a1" * 20 + " xoxb-123456789012 https://user:pw@host/ -----BEGIN RSA PRIVATE KEY-----"),
    (6, "eyJabcdefgh1.eyJabcdefgh1.abcdefgh1 AIza" + "x" * 35 + " sk_live_0123456789abcdef " + "0" * 32),
    (7, "paſſword=longenough1 toKen=longenough1 password =longenough1"),
]


def frame(spark, texts):
    return spark.createDataFrame([(*r, "x", 5, True) for r in texts], "doc_id long, text string, blob string, n_chars long, spans boolean")


def test_odd_rows(spark, tmp_path):
    frame(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(op.op3_secret_scans(spark, str(tmp_path))) == sorted((brute(*r) for r in TEXTS), key=repr)
    frame(spark, TEXTS).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op.op3_secret_scans(spark, f"{tmp_path}/none").count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    first = written(op.scan(frame(spark, TEXTS[:4])), "ledger")
    assert first.count() == 2 * 3  # two rule versions over three different texts
    more = written(op.scan(frame(spark, TEXTS), first), "ledger")
    assert more.join(first, ["blob", "rule_version"]).count() == 0
    assert more.count() == 2 * (len({t or "" for _, t in TEXTS}) - 3)
    ledger = first.unionByName(more)
    assert op.scan(frame(spark, TEXTS), ledger).count() == 0
    changed = {"base-1": op.BASE, "more-2": op.MORE[:1]}
    again = op.scan(frame(spark, TEXTS), ledger, changed)
    assert {r["rule_version"] for r in again.collect()} == {"more-2"}
    found = op.with_spans(frame(spark, TEXTS), op.findings(ledger.unionByName(again), changed))
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in found.collect()), key=repr)
    assert got == sorted(((d, sorted(spans_of(t, (*op.BASE, *op.MORE[:1])))) for d, t in TEXTS), key=repr)


def test_every_match_has_an_anchor(spark):
    for rule, text in [("assign", "x passwd=longenough1"), ("assign", "apikey:longenough1"), ("url-login", "ab://u:p@"),
                       ("jwt", TEXTS[7][1]), ("private-key", "-----BEGIN PRIVATE KEY-----"), ("git-token", "gho_" + "a" * 36)]:
        one = spark.createDataFrame([(text,)], "text string").select(op.anchored(F.col("text"))).first()[0]
        assert one, rule


def test_redaction(spark):
    got = op.without_secrets(frame(spark, TEXTS))
    assert got.columns == ["doc_id", "text", "blob", "n_chars", "spans"]

    def cleaned(text):
        if text is None:
            return None
        out, at = [], 0
        for a, _, b in spans_of(text, (*op.BASE, *op.MORE)):
            if a >= at:
                out.append(text[at:a] + "[SECRET]")
            at = max(at, b)
        return "".join(out) + text[at:]

    expected = [(d, cleaned(t), 5 if cleaned(t) == t else len(cleaned(t))) for d, t in TEXTS]
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_only_built_in_functions(spark):
    plan = op.op3_secret_scans(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    scan = op.scan(spark.read.parquet(f"{ROOT}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan + scan for word in ("Python", "Arrow"))
