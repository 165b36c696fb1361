from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from shelfmark.llm import simhash as op
from shelfmark.llm.common import smallest_reachable
from shelfmark.llm.components import linked_to

ROOT = "/root/testdata/sf0.01"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute_print(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(UPPER, UPPER.lower())))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    prints = np.array([p for _, p in rows], np.uint64)
    left, right = [], []
    for k in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= 3)
        left += [k] * len(near)
        right += near.tolist()
    label = smallest_reachable((np.array(left, int), np.array(right, int)), len(prints))
    smallest = {}
    for (doc, _), part in zip(rows, label.tolist(), strict=True):
        if doc is not None:
            smallest[part] = min(doc, smallest.get(part, doc))
    return {(doc, f"{p:016x}", smallest.get(part)) for (doc, p), part in zip(rows, label.tolist(), strict=True)}


def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_components([(d, brute_print(t)) for d, t in documents])
    assert len({c for _, _, c in expected}) < len(expected)
    assert {tuple(r) for r in op.op4_simhash_near_dedup(spark, ROOT).collect()} == expected


def test_anchors_meet_for_every_pair_within_three_bits():
    random = np.random.default_rng(5)
    one = random.integers(-(2**63), 2**63, 300, dtype=np.int64)
    flips = np.zeros(300, np.uint64)
    for k in range(300):
        for bit in random.choice(64, k % 4, replace=False):
            flips[k] |= np.uint64(1) << np.uint64(bit)
    other = (one.view(np.uint64) ^ flips).view(np.int64)
    index, anchor = op.homes(one)
    assert np.bincount(index, minlength=300).tolist() == [2] * 300
    home = {k: set() for k in range(300)}
    for i, a in zip(index.tolist(), anchor.tolist(), strict=True):
        home[i].add(a)
    index, anchor = op.anchors(other)
    reach = {k: set() for k in range(300)}
    for i, a in zip(index.tolist(), anchor.tolist(), strict=True):
        reach[i].add(a)
    assert all(home[k] & reach[k] for k in range(300))


@pytest.mark.parametrize("most_homes,buffer", [(2048, 200_000), (2, 200_000), (3, 16)])
def test_crowded_anchors_are_split_without_loss(spark, monkeypatch, most_homes, buffer):
    monkeypatch.setattr(op, "BUFFER_ROWS", buffer)
    monkeypatch.setattr(op, "PAIRS", 7)
    base = 0x0123456789ABCDEF
    near = [base ^ (1 << a) ^ (1 << b) for a in range(0, 20) for b in range(a, 24, 5)]
    chain = [0x7000000000000000 + ((1 << (3 * k)) - 1) for k in range(12)]
    prints = sorted({*near, *chain, 0, 5})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in linked_to(op.links(frame, 3, most_homes)).collect()}
    rows = [(p, p) for p in prints]
    expected = {d: c for d, _, c in brute_components(rows)}
    assert {p: roots.get(p, p) for p in prints} == expected


def test_components_of_long_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (1, 0)]
    got = {r["node"]: r["root"] for r in linked_to(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 160)}}
    assert linked_to(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    words = " ".join(f"w{k}" for k in range(70000))
    odd = spark.createDataFrame(
        [(5, "a b", 1), (5, "a b", 1), (None, "A\tB", 2), (7, None, 3), (8, " \n", 4), (9, words, 5), (10, "x y z w", None)],
        "doc_id long, text string, fp int",
    )
    expected = brute_components([(r["doc_id"], brute_print(r["text"])) for r in odd.collect()])
    got = op.near_duplicates(odd).collect()
    assert len(got) == 7
    assert {(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got} == expected
    kept = op.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(kept.collect(), key=repr) == sorted(
        [r for k, r in enumerate(odd.collect()) if k in (0, 2, 3, 5, 6)], key=repr
    )
    assert op.near_duplicates(odd.limit(0)).count() == 0
    assert op.one_of_each(odd.limit(0)).count() == 0
