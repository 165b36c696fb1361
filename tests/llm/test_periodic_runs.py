from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm import periodic_runs as op


def brute(words):
    """(start, length, period) of all runs, by trying every period at every place."""
    seen = {}
    for q in range(1, len(words) // 3 + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at > start and at - start + q >= max(24, 3 * q):
                seen.setdefault((start, at - start + q), q)
            at += 1 if at == start else 0
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda run: (run[0], run[2]))


def found(*docs):
    numbers = {word: k for k, word in enumerate(dict.fromkeys(word for words in docs for word in words))}
    return [list(map(tuple, one.tolist())) for one in op.runs([np.array([numbers[w] for w in words], np.int32) for words in docs])]


def test_cover_holds_every_difference():
    differences = {int(a - b) % op.CYCLE for a in op.COVER for b in op.COVER}
    assert differences == set(range(op.CYCLE))
    for i in range(op.CYCLE):
        for gap in range(op.CYCLE):
            k = int(op.AHEAD[i, gap])
            assert {(i + k) % op.CYCLE, (i + gap + k) % op.CYCLE} <= set(op.COVER.tolist())


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50])
def test_extensions_equal_brute_force(alphabet):
    rnd = np.random.default_rng(alphabet)
    codes = np.append(rnd.integers(0, alphabet, 400), -1).astype(np.int32)
    codes[200:300] = codes[40:140]
    i, j = rnd.integers(0, 400, 3000), rnd.integers(0, 400, 3000)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    expected = []
    for a, b in zip(i, j, strict=True):
        k = 0
        while codes[a + k] == codes[b + k]:
            k += 1
        expected.append(k)
    assert op.Extensions(codes)(i, j).tolist() == expected


def test_runs_equal_brute_force():
    rnd = random.Random(11)
    total = 0
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            n, kinds = rnd.choice([0, 1, 5, 23, 24, 25, 60, 200, 400]), rnd.choice([1, 2, 3, 20, 1000])
            words = [rnd.randrange(kinds) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n > 3 else 0):
                a = rnd.randrange(n)
                b, p = rnd.randint(a, n), rnd.randint(1, n // 3)
                words[a:b] = [words[a + (k - a) % min(p, n - a)] for k in range(a, b)]
            docs += [words, words[:]] if rnd.random() < 0.3 else [words]
        expected = [brute(words) for words in docs]
        total += sum(map(len, expected))
        assert found(*docs) == expected
    assert total > 200


def test_limits_of_a_run():
    noise = [f"n{k}" for k in range(40)]
    unit = [f"u{k}" for k in range(10)]
    assert found(noise + unit * 3 + noise[:3]) == [[(40, 30, 10)]]
    assert found(noise + (unit * 3)[:29] + ["x"]) == [[]]  # two periods and nine words
    assert found(["a"] * 23) == [[]] and found(["a"] * 24) == [[(0, 24, 1)]]
    assert found(["a", "b"] * 12) == [[(0, 24, 2)]]  # not with period 4, 6 or 8
    assert found(unit * 3, unit) == [[(0, 30, 10)], []]  # nothing crosses from one text to the next
    assert found(["a", "a", "b"] * 10) == [[(0, 30, 3)]]


def test_long_periodic_texts():
    assert found(["a"] * 100_000) == [[(0, 100_000, 1)]]
    unit = [f"w{k}" for k in range(30_000)]
    assert found(unit * 3) == [[(0, 90_000, 30_000)]]


def test_points_come_in_pieces(monkeypatch):
    words = ["x", "y", "z"] * 50 + [f"w{k}" for k in range(100)] + ["a"] * 30
    whole = found(words, words[10:])
    monkeypatch.setattr(op, "POINTS", 10)
    assert found(words, words[10:]) == whole == [brute(words), brute(words[10:])]


def brute_row(doc_id, text):
    words = [w for w in op.repeated_tail(doc_id, (text or "").encode().split())]
    every = brute(words)
    best = max(every, key=lambda run: (Fraction(run[1], run[2]), -run[0], -run[2]), default=(None, None, None))
    hidden = {k for s, n, q in every for k in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in every)
    kept = b" ".join(w for k, w in enumerate(words) if k not in hidden)
    milli = 1000 * best[1] // best[2] if every else None
    return (doc_id, len(every), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_odd_rows(spark, tmp_path):
    tail = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "a " * 40), (4, "a b " * 50), (4, "a b " * 50),
        (5, "é ü\x0bß " * 30 + "end"), (6, "one two"), (7, "w " * 100_000), (tail, " ".join(f"w{k}" for k in range(500))),
        (tail, None), (8, "x y " * 30),
    ]
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, start int")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((brute_row(*r) if r[0] != 7 else _one_word(r) for r in rows), key=repr)
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def _one_word(row):
    n = len(row[1].split())
    words = op.repeated_tail(row[0], row[1].encode().split())
    assert words == row[1].encode().split()
    run = f"0,{n},1\n".encode()
    return (row[0], 1, 0, n, 1, 1000 * n, hashlib.sha256(run).hexdigest(), hashlib.sha256(b"w").hexdigest())


def test_spans_and_texts(spark):
    rows = [(1, "say " + "a b c " * 10 + "end"), (2, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (list(map(tuple, r["runs"])), r["text"]) for r in op.periodic_runs(docs).collect()}
    assert got == {1: ([(1, 30, 3)], "say a b c end"), 2: ([], "nothing here")}


def test_nothing_is_shuffled(spark):
    plan = op.op11_periodic_runs(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
