from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from shelfmark.llm import near_copies as op
from shelfmark.llm.components import linked_to

ROOT = "/root/testdata/sf0.01"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(UPPER, UPPER.lower())))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    """The group of each text (its first text), by exact similarity of all pairs that share a shingle."""
    sets = [brute_set(text) for text in texts]
    holders, common = defaultdict(list), Counter()
    for k, one in enumerate(sets):
        for shingle in one or [""]:
            holders[shingle].append(k)
    for held in holders.values():
        common.update((a, b) for at, b in enumerate(held) for a in held[:at])
    label = list(range(len(texts)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    pairs = 0
    for (a, b), n in common.items():
        one, other = max(len(sets[a]), 1), max(len(sets[b]), 1)
        if 5 * n >= 4 * (one + other - n):
            pairs += sets[a] != sets[b]
            low, high = sorted((root(a), root(b)))
            label[high] = low
    return [root(k) for k in range(len(texts))], pairs


def test_stage_equals_brute_force(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet").orderBy("doc_id")
    rows = documents.select("doc_id", "text").collect()
    groups, pairs = brute_groups([r["text"] for r in rows])
    assert pairs > 5  # near copies of different texts, not only equal ones
    expected = [r["doc_id"] for k, r in enumerate(rows) if groups[k] == k]
    assert sorted(r["doc_id"] for r in op.one_of_each(documents).collect()) == expected


@pytest.mark.parametrize("home_bytes", [op.HOME_BYTES, 2000])
def test_chains_are_linked_by_exact_similarity(spark, home_bytes):
    words = [f"w{k}" for k in range(400)]
    # Each is near the next ones only, so most are far from the root of their cluster.
    texts = [" ".join(words[6 * k : 6 * k + 100]) for k in range(40)] + [" ".join(words[:80] + [f"x{k}" for k in range(25)])]
    texts += [f"Short text {k}" for k in range(5)] + ["short  TEXT 3", " ", None]
    groups, _ = brute_groups(texts)
    assert len(set(groups)) == 8
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["group"] for r in op.copies(documents, home_bytes).collect()}
    first = {}
    for k in range(len(texts)):
        first.setdefault(rows[k], k)
    assert [first[rows[k]] for k in range(len(texts))] == groups


def test_a_few_edited_words(spark):
    words = [f"w{k}" for k in range(120)]
    edited = words[:50] + ["other", "words"] + words[52:]
    far = [f"{w}x" if k % 8 == 0 else w for k, w in enumerate(words)]
    rows = [(k, " ".join(w)) for k, w in enumerate([words, edited, far])]
    kept = op.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_bands_of_similar_sets_meet():
    apart = 0
    for k in range(300):
        one = op.shingles(" ".join(f"a{k}x{j}" for j in range(104)).encode())
        other = op.shingles(" ".join(f"a{k}x{j}" for j in range(11, 115)).encode())
        common = len(set(one.tolist()) & set(other.tolist()))
        assert op.is_near(common, len(one), len(other))
        apart += not set(op.bands(one).tolist()) & set(op.bands(other).tolist())
    assert apart == 0


def test_rows_are_decided_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (7, c, 5), (7, a, 6), (None, a, 7), (None, a, 8)]
    kept = op.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert len(kept) == 5
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept)) == [(0, a), (0, a), (1, a), (5, b), (7, c)]


def test_cells_are_bounded_and_lose_no_link(spark, monkeypatch):
    """Texts that share a long passage but are no copies, with some true copies among them."""
    monkeypatch.setattr(op, "HOME_ROWS", 8)
    monkeypatch.setattr(op, "REPLICA_ROWS", 16)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage + [f"own{k}x{j}" for j in range(22)]) for k in range(90)]
    texts += [" ".join(passage + [f"own{k}x{j}" for j in range(20)] + ["changed", "end"]) for k in range(0, 90, 3)]
    groups, pairs = brute_groups(texts)
    assert pairs == 30
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["group"] for r in op.copies(documents).collect()}
    first = {}
    for k in range(len(texts)):
        first.setdefault(rows[k], k)
    assert [first[rows[k]] for k in range(len(texts))] == groups
