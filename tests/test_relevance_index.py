from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from small import plan

from shelfmark.operators import relevance_index as index
from shelfmark.operators.relevance import relevance_topk
from shelfmark.sources.store import Store

DOCS = "id bigint, title string, description string"
QUERIES = "query_id int, query string"
ASKED = [(0, "the lung"), (1, "CELL cell scan"), (2, "absent"), (3, "The x1 nerf"), (4, "..."), (5, "rare")]


def documents(n, seed=3, first=0):
    rnd = random.Random(seed)

    def text(most):
        return " ".join(rnd.choice(["the", "the", "the", "cell", "scan", "lung", "x1", "nerf"]) for _ in range(rnd.randint(0, most)))

    rows = [(first + i, text(rnd.choice([3, 8, 60])), rnd.choice([None, text(3)])) for i in range(n)]
    return [*rows, (first + n, "rare the", None), (first + n + 1, None, None)]


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"], r["relevance_score"]) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    filler = " ".join(f"w{k}" for k in range(40))
    gold = [(5000 + k, f"{'gold ' * (9 if k % 100 == 0 else 1)}{filler}", None) for k in range(400)]
    docs = spark.createDataFrame(documents(1500) + gold, DOCS)
    version = Store(spark, str(tmp_path_factory.mktemp("index"))).open()
    return docs, index.add_documents(version, docs, block_docs=16, files=8).put()


@pytest.mark.parametrize("k", [1, 7, 5000])
@pytest.mark.parametrize("small", [True, False])
def test_equals_the_search_without_an_index(spark, built, monkeypatch, k, small):
    docs, version = built
    queries = spark.createDataFrame(ASKED, QUERIES)
    expected = rows(relevance_topk(docs, queries, k))
    if not small:
        monkeypatch.setattr(index, "is_small", lambda df: False)
        monkeypatch.setattr(index, "sent_if_small", lambda df: df)
        monkeypatch.setattr(index, "PUSHED_WORDS", 0)
    assert len(expected) > 3
    assert rows(index.indexed_topk(version, queries, k, slots=3)) == expected


def test_blocks_are_skipped(spark, built):
    _, version = built
    search = index.Search.of(version, spark.createDataFrame([(0, "lung"), (1, "the cell"), (2, "gold")], QUERIES))
    every = {r["query_id"]: r["count"] for r in search.blocks.groupBy("query_id").count().collect()}
    read = {r["query_id"]: r["count"] for r in search.chosen(3).groupBy("query_id").count().collect()}
    assert min(every.values()) > 20
    # Scores of the first two tie in many blocks.
    assert read[0] < 0.7 * every[0] and read[1] < every[1] and read[2] < every[2] / 4
    # No score in a block is above the block's bound.
    parts = search.parts(search.blocks.select("query_id", "segment", "block"))
    best = parts.groupBy("query_id", "_doc").agg(F.sum("part").alias("s")).groupBy("query_id").agg(F.max("s").alias("s"))
    top = search.blocks.groupBy("query_id").agg(F.max("bound").alias("b")).join(best, "query_id").collect()
    assert all(r["s"] <= r["b"] + 1e-9 for r in top)


def test_only_files_of_the_asked_words_are_read(spark, built):
    _, version = built
    rare = spark.createDataFrame([("rare",)], "word string")
    touched = version.touched(index.POSTINGS, rare).count()
    assert touched <= 2 < version.files(index.POSTINGS).count()
    text = plan(index._lists(version, rare).drop("docs"))
    assert "docs" not in text and "PushedFilters: [IsNotNull(word), EqualTo(word,rare)]" in text or "In(word, [rare])" in text


def test_an_added_segment_equals_a_rebuild(spark, tmp_path):
    old, new = documents(150), documents(60, seed=4, first=1000)
    queries = spark.createDataFrame(ASKED, QUERIES)
    first, second, every = (spark.createDataFrame(some, DOCS) for some in (old, new, old + new))
    base = index.add_documents(Store(spark, f"{tmp_path}/a").open(), first, block_docs=8).put()
    both = index.add_documents(base, second, block_docs=8).put()
    assert {r["segment"] for r in both.read(index.SEGMENTS).collect()} == {0, 1}
    found = rows(index.indexed_topk(both, queries, 4))
    assert found == rows(relevance_topk(every, queries, 4))
    whole = index.add_documents(Store(spark, f"{tmp_path}/b").open(), every, block_docs=8).put()
    assert found == rows(index.indexed_topk(whole, queries, 4))
    # The version before answers as before.
    assert rows(index.indexed_topk(base, queries, 4)) == rows(relevance_topk(first, queries, 4))


def test_empty_index(spark, tmp_path):
    version = index.add_documents(Store(spark, str(tmp_path)).open(), spark.createDataFrame([], DOCS))
    queries = spark.createDataFrame(ASKED, QUERIES)
    assert index.indexed_topk(version, queries).count() == 0
    later = index.add_documents(version, spark.createDataFrame([(1, "the lung", None)], DOCS))
    assert rows(index.indexed_topk(later, queries)) == rows(relevance_topk(spark.createDataFrame([(1, "the lung", None)], DOCS), queries))


def test_words_are_listed_where_their_documents_are(spark):
    """Documents move once, by block; their words do not move before they are in lists."""
    rows = [(k, 3, ["a", "b", f"w{k}"], k % 4) for k in range(20)]
    lists = index.listed_words(spark.createDataFrame(rows, "_doc long, _length int, _words array<string>, block long"), 3, 7)
    assert plan(lists).count("Exchange") == 1
    found = {(r["word"], r["block"]): [d["doc"] for d in r["docs"]] for r in lists.collect()}
    assert found["a", 1] == [1, 5, 9, 13, 17] and found["w6", 2] == [6] and len(found) == 8 + 20
