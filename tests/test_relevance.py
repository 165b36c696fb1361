from __future__ import annotations

import math
import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from small import plan, small_catalog

from shelfmark.operators import relevance
from shelfmark.operators.relevance import relevance_topk, relevant_datasets

DOCS = "id bigint, title string, description string"
QUERIES = "query_id int, query string"


def brute(docs, queries, k):
    """BM25 by hand, k1 = 1.5 and b = 0.75."""
    bags = {i: re.findall(r"\w+", " ".join(filter(None, texts)).lower()) for i, *texts in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    df = Counter(word for bag in bags.values() for word in set(bag))
    result = []
    for query_id, query in queries:
        asked = set(re.findall(r"\w+", query.lower()))
        scores = {}
        for i, bag in bags.items():
            hit = [w for w in asked if w in bag]
            if hit:
                scores[i] = sum(
                    math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                    * bag.count(w) * 2.5 / (bag.count(w) + 1.5 * (0.25 + 0.75 * len(bag) / mean))
                    for w in hit
                )
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        result += [(query_id, i, -s, rank + 1) for rank, (s, i) in enumerate(best)]
    return result


@pytest.mark.parametrize("small", [True, False, None])
def test_equals_brute_force(spark, monkeypatch, small):
    if small is not None:
        monkeypatch.setattr(relevance, "is_small", lambda df: small)
    random.seed(3)
    # "the" is in most texts: a hot word.
    word = lambda: random.choice(["the", "the", "cell", "scan", "lung", "x1", "nerf"])
    docs = [
        (i, " ".join(word() for _ in range(random.randint(0, 6))), random.choice([None, f"{word()}, {word()}!"]))
        for i in range(120)
    ]
    queries = [(0, "the lung"), (1, "CELL cell scan"), (2, "absent"), (3, "The x1 nerf"), (4, "...")]
    found = relevance_topk(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(queries, QUERIES), k=7, slots=3
    )
    rows = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect())
    expected = sorted((q, rank, i, score) for q, i, score, rank in brute(docs, queries, 7))
    assert [r[:3] for r in rows] == [e[:3] for e in expected]
    assert all(math.isclose(r[3], e[3], abs_tol=2e-6) for r, e in zip(rows, expected))


def test_scores_fit_their_type(spark):
    rows = relevant_datasets(small_catalog(spark), "ring", k=5).collect()
    assert [row["id"] for row in rows if row["rank"] == 1] == [1]
    assert max(row["relevance_score"] for row in rows) == Decimal("1.0000")
    assert all(0 <= row["relevance_score"] <= 1 for row in rows)
    # "ring" is a word of 1, 2 and 5; a substring, as in 4, does not count.
    assert sorted(row["id"] for row in rows) == [1, 2, 5]


def test_tasks_keep_only_k_rows_before_the_shuffle(spark):
    catalog = small_catalog(spark)
    queries = spark.createDataFrame([(1, "ring"), (2, "lung")], QUERIES)
    many = plan(relevance_topk(catalog.dataset, queries))
    assert re.search(r"WindowGroupLimit .* 5, Partial", many)
    one = plan(relevant_datasets(catalog, "ring"))
    for text in (many, one):
        assert "Cartesian" not in text


def test_any_k_is_ranked_in_pieces_and_texts_are_read_once(spark):
    docs = spark.createDataFrame([(i, "the cell", None) for i in range(50)], DOCS)
    queries = spark.createDataFrame([(1, "the"), (2, "cell")], QUERIES)
    found = relevance_topk(docs, queries, k=2000, slots=4)
    assert found.count() == 100
    text = plan(found)
    assert len(re.findall(r"Window .*row_number", text)) >= 2 and "_slot" in text
    assert "LocalTableScan" not in text and "ExistingRDD" in text
