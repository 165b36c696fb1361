from __future__ import annotations

import hashlib
import re
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import decontaminate as op

ROOT = "/root/testdata/sf0.01"


def words(text):
    lowered = (text or "").translate(str.maketrans(op_upper, op_upper.lower()))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


op_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute(documents, items, window=10):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in documents:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    documents = [tuple(r) for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute(documents, items)
    assert any(row[5] for row in expected)
    assert rows(op.op1_decontamination(spark, ROOT)) == expected


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("abcd"), max_size=25), max_size=6),
    st.lists(st.lists(st.sampled_from("abce"), max_size=12), max_size=5),
    st.integers(1, 6),
)
def test_shard_equals_brute_force(documents, items, window):
    class Sent:
        value = op.Block([(k, " ".join(w).encode()) for k, w in enumerate(items)], window)

    counts, hit, found, longest = op.shard_hits([" ".join(w).encode() for w in documents], [Sent])
    expected = brute(
        [(k, " ".join(w)) for k, w in enumerate(documents)], [(k, " ".join(w)) for k, w in enumerate(items)], window
    )
    got = [
        (k, counts[k], hit[k], len(found[k]), hashlib.sha256(",".join(sorted(found[k])).encode()).hexdigest(), hit[k] > 0)
        for k in range(len(documents))
    ]
    assert sorted(got, key=repr) == expected
    for k, document in enumerate(documents):
        best = 0
        for item in items:
            for i in range(len(item)):
                for j in range(len(document)):
                    n = 0
                    while i + n < len(item) and j + n < len(document) and item[i + n] == document[j + n]:
                        n += 1
                    if n >= min(window, len(item)):
                        best = max(best, n)
        assert longest[k] == best


def test_suffix_array_orders_suffixes():
    some = np.random.default_rng(1).integers(0, 3, 200)
    got = op.suffix_array(some, 200)
    assert got.tolist() == sorted(range(200), key=lambda k: some[k:].tolist())


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(
        [(1, "one two three", "x"), (1, "one two three", "x"), (None, "Two THREE four", "y"), (3, None, None),
         (4, "", "z"), (5, "w " * 30000 + "two three", "z")],
        "doc_id long, text string, n_words string",
    )


def test_odd_rows_blocks_and_empty_tables(spark, odd, monkeypatch):
    items = spark.createDataFrame(
        [(7, "two, three!"), (8, "two three"), (9, None), (10, " ! "), (11, "three four five")], "item_id long, text string"
    )
    monkeypatch.setattr(op, "BLOCK_BYTES", 20)
    found = {tuple(r) for r in op.contamination(odd, items).select("doc_id", "n_words", "n_hit", "items").collect() for r in
             [(r[0], r[1], r[2], tuple(r[3]))]}
    assert found == {(1, 3, 2, ("7", "8")), (None, 3, 2, ("7", "8")), (3, 0, 0, ()), (4, 0, 0, ()), (5, 30002, 2, ("7", "8"))}
    assert [r["doc_id"] for r in op.decontaminated(odd, items).orderBy("doc_id").collect()] == [3, 4]
    assert op.decontaminated(odd, items).columns == odd.columns
    assert op.decontaminated(odd, items.limit(0)).count() == 6
    assert op.contamination(odd.limit(0), items).count() == 0
    where = {tuple(r) for r in op.places(odd, items).where("doc_id is null").collect()}
    assert where == {(None, "7", 0, 2, 2), (None, "8", 0, 2, 2)}


def test_repeated_items_in_repeated_passages():
    """Each distinct window is searched once, however many items hold it."""
    passage = " ".join(f"w{k}" for k in range(40))
    items = [(f"item{k}", passage.encode()) for k in range(1600)]
    shard = [f"before x{k} {passage} after".encode() for k in range(4000)]
    block = op.Block(items, 10)
    assert len(block.begins) == 31

    class Sent:
        value = block

    tracemalloc.start()
    start = time.perf_counter()
    counts, hit, found, longest = op.shard_hits(shard, [Sent])
    took, peak = time.perf_counter() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(counts) == {43} and set(hit) == {40} and set(longest) == {40}
    assert len(found) == 4000 and all(one == found[0] for one in found) and found[0] == sorted(f"item{k}" for k in range(1600))
    assert took < 10 and peak < 300e6  # traced, which slows it down


def test_places_leave_in_pieces(monkeypatch):
    class Sent:
        value = op.Block([(k, b"one two three") for k in range(3)] + [(9, b"two three four")], 3)

    shard = [b"one two three four " * 20, b"two three four", b"x"]
    whole = op.shard_hits(shard, [Sent])
    monkeypatch.setattr(op, "PLACES", 2)
    assert len(list(op.found_in_shard(shard, Sent.value))) == 2  # one window, and the other
    assert op.shard_hits(shard, [Sent]) == whole
