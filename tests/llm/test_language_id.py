from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from shelfmark.llm import language_id as op

ROOT = "/root/testdata/sf0.1"


def step_by_step(network, text):
    """The mean chances of a text, one byte and one unit at a time."""
    w = {name: value.astype(float) for name, value in network.weights.items()}

    def logistic(x):
        return 1 / (1 + np.exp(-x))

    def read(symbols, way):
        state, states = np.zeros(w["state_new"].shape[-1]), []
        for symbol in symbols:
            row = symbol + 256 * way
            update = logistic(w["byte_update"][row] + state @ w["state_update"][way])
            reset = logistic(w["byte_reset"][row] + state @ w["state_reset"][way])
            new = np.tanh(w["byte_new"][row] + reset * (state @ w["state_new"][way]))
            state = (1 - update) * new + update * state
            states.append(state)
        return states

    text = text.lower()  # ASCII only in this test
    total = np.zeros(len(network.languages))
    for at in range(0, len(text), op.WINDOW):
        window = text[at : at + op.WINDOW].ljust(op.WINDOW, b"\xff")
        ahead, back = read(window, 0), read(window[::-1], 1)[::-1]
        for k in range(min(op.WINDOW, len(text) - at)):
            score = ahead[k] @ w["label"][0] + back[k] @ w["label"][1] + w["bias"][:, 0]
            total += np.exp(score) / np.exp(score).sum()
    return total / max(len(text), 1)


def test_pooled_equals_one_byte_at_a_time(monkeypatch):
    network = op.Network.untrained(["a", "b", "c"])
    found = [b"", b"x", b"Some Words " * 30, b"q" * op.WINDOW, b"z" * (op.WINDOW + 1), b""]
    expected = [step_by_step(network, text) for text in found]
    np.testing.assert_allclose(network.pooled(found), expected, atol=1e-5)
    monkeypatch.setattr(op, "BLOCK", 2)  # texts cross blocks
    np.testing.assert_allclose(network.pooled(found), expected, atol=1e-5)


def test_slopes_equal_differences():
    rnd = np.random.default_rng(3)
    network = op.Network.untrained(["a", "b", "c"], units=4)
    network.weights = {name: value.astype(np.float64) for name, value in network.weights.items()}
    windows = rnd.integers(60, 70, (5, op.WINDOW)).astype(np.uint8)
    windows[2, 40:] = op.FILLER
    labels = np.array([0, 1, 2, 1, 0])
    _, slope = op.slopes(network, windows, labels)
    for name, value in network.weights.items():
        moving = np.argsort(-np.abs(slope[name]).ravel())[:4]
        for place in moving:
            kept = value.flat[place]
            value.flat[place] = kept + 1e-5
            above, _ = op.slopes(network, windows, labels)
            value.flat[place] = kept - 1e-5
            below, _ = op.slopes(network, windows, labels)
            value.flat[place] = kept
            assert math.isclose((above - below) / 2e-5, slope[name].flat[place], rel_tol=1e-4, abs_tol=1e-9), name


def test_held_out_accuracy(spark):
    rows = op.op13_language_id(spark, ROOT).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(langs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    out = [r for r in rows if r["held_out"]]
    for lang in set(langs.values()):
        mine = [r for r in out if langs[r["doc_id"]] == lang]
        assert sum(r["lang_pred"] == lang for r in mine) >= 0.98 * len(mine) > 100


KIND = "doc_id long, text string, lang string, lang_pred string, score int"


def test_odd_rows(spark, tmp_path):
    english, german = "the thing that was there is here and then ", "und der die das ist nicht auch schon geöffnet "
    fit = [(k, (english if k % 2 else german) * 6, "en" if k % 2 else "de", "x", 1) for k in range(80)]
    odd = [
        (100, None, "en", "x", 1), (101, "", "en", "x", 1), (102, " 12 34 !? §", "en", "x", 1), (None, english * 3, "xx", "x", 1),
        (103, german, None, "x", 1), (104, english * 3000, "en", "x", 1), (105, english, "en", "x", 1), (105, english, "en", "x", 1),
        (106, "مرحبا", None, "x", 1),
    ]
    spark.createDataFrame(fit + odd, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    found = op.op13_language_id(spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(fit) + len(odd)
    by_id = {r["doc_id"]: r for r in rows}
    assert [(by_id[k]["lang_pred"], by_id[k]["score"]) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by_id[103]["lang_pred"] == "de" and by_id[104]["lang_pred"] == "en"
    assert by_id[None]["lang_pred"] == "en" and by_id[None]["held_out"] is False  # its own label was not learned
    assert len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 105}) == 1
    assert by_id[106]["lang_pred"] in ("de", "en")


def test_labels_of_held_out_rows_are_not_learned(spark, tmp_path):
    rows = [(k, "some words in a text", "zz" if zlib.crc32(str(k).encode()) % 4 == 2 else "en", "x", 1) for k in range(40)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    got = op.op13_language_id(spark, str(tmp_path)).collect()
    assert {r["lang_pred"] for r in got} == {"en"} and {r["held_out"] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "no label here", None, "x", 1)]])
def test_nothing_to_learn_from(spark, tmp_path, rows):
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    got = op.op13_language_id(spark, str(tmp_path)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * len(rows)


def test_sample_is_bounded_and_shared_out(spark):
    rows = [(k, f"text number {k} " * 20, "en" if k % 50 else "de") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {r["lang"]: r["count"] for r in op.sample_windows(docs, 200).groupBy("lang").count().collect()}
    assert 60 * op.ROW_WINDOWS < counts["en"] < 150 * op.ROW_WINDOWS
    assert counts["de"] == 100 * op.ROW_WINDOWS


def test_nothing_but_the_sample_is_shuffled(spark):
    plan = op.op13_language_id(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lang#" not in plan.split("FileScan")[0]
