from __future__ import annotations

import random

import pytest
from small import ids, plan, small_catalog

from shelfmark.functions.skew import spread_join
from shelfmark.operators import batch
from shelfmark.operators.batch import batch_counts, batch_search, distinct_searches, with_search_key
from shelfmark.operators.requests import (
    check_requests,
    read_filters,
    rejected_requests,
    valid_requests,
)
from shelfmark.operators.search import find, search
from shelfmark.schemas import DATASET

REQUEST = (
    "request_id bigint, query string, anatomical_area_name string, record_count_min string, "
    "record_count_max string, modalities_list string, ml_tasks_list string, tags_list string, "
    "size_min string, size_max string, ordering array<string>"
)
ROUTES = {"sent": {}, "shuffled": {"small_rows": 0, "slots": 3}}


def requests_of(spark, rows):
    names = [part.split()[0] for part in REQUEST.split(", ")]
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], REQUEST)


def test_validity(spark):
    given = [
        {"query": "ok"},
        {"query": "x"},
        {"query": " x "},
        {"query": "   "},
        {"query": None},
        {"query": "q" * 100},
        {"query": "q" * 101},
        {"query": "ok", "anatomical_area_name": "A"},
        {"query": "ok", "anatomical_area_name": " "},
        {"query": "ok", "record_count_min": "many", "size_max": "1.5"},
        {"query": "ok", "record_count_min": "", "size_max": " 2.0 "},
        {"query": "ok", "ordering": ["a", "b", "c"]},
        {"query": "ok", "ordering": ["a"]},
        {"query": "o\x00k", "tags_list": "\x00"},
    ]
    df = requests_of(spark, [{"request_id": i, **row} for i, row in enumerate(given)])
    errors = {row["request_id"]: row["errors"] for row in check_requests(df).collect() if row["errors"]}
    assert errors == {
        1: ["query"],
        2: ["query"],
        3: ["query"],
        4: ["query"],
        6: ["query"],
        7: ["anatomical_area_name"],
        9: ["record_count_min", "size_max"],
        11: ["ordering"],
        13: ["query", "tags_list"],
    }
    assert ids(rejected_requests(df), "request_id") == sorted(errors)
    valid = {row["request_id"]: row for row in valid_requests(df).collect()}
    assert set(valid) == set(range(len(given))) - set(errors)
    assert valid[8]["anatomical_area_name"] is None
    assert valid[10]["record_count_min"] is None and valid[10]["size_max"] == 2


def test_saved_filters(spark):
    log = small_catalog(spark).user_search_queries
    rows = {row["id"]: row for row in read_filters(log).collect()}
    assert rows[1]["size_max"] == "40" and rows[1]["ordering"] is None
    assert rows[2]["size_max"] is None
    assert rows[3]["ordering"] == ["title"]


def test_equal_requests_share_a_key(spark):
    rows = [{"query": "Ring "}, {"query": "ring", "size_max": ""}, {"query": "ring", "size_max": "3"}]
    df = requests_of(spark, [{"request_id": i, **row} for i, row in enumerate(rows)])
    assert distinct_searches(df).count() == 2


def _single(catalog, row):
    fields = {k: v for k, v in row.items() if k not in ("request_id", "query", "ordering") and v}
    fields = {k: int(v) if k.endswith(("_min", "_max")) else v for k, v in fields.items()}
    return ids(find(catalog, row["query"].strip(), fields))


@pytest.mark.parametrize("route", ROUTES)
def test_batch_equals_single_searches(spark, route):
    catalog = small_catalog(spark)
    rows = [
        {"query": "ring"},
        {"query": " RING "},
        {"query": "ri", "record_count_min": "0"},
        {"query": "rin", "record_count_max": "20", "size_min": "1"},
        {"query": "a_b"},
        {"query": "50% of cases"},
        {"query": "ring", "anatomical_area_name": "Head"},
        {"query": "ring", "anatomical_area_name": "Nowhere"},
        {"query": "ring", "modalities_list": "CT,X"},
        {"query": "ring", "modalities_list": "nothing"},
        {"query": "ring", "modalities_list": "MRI", "ml_tasks_list": "detection", "tags_list": "public"},
        {"query": "ring", "size_max": "7", "tags_list": "public,large"},
        {"query": "not there"},
    ]
    rows = [{"request_id": i, **row} for i, row in enumerate(rows)]
    df = requests_of(spark, [*rows, {"request_id": 99, "query": "x"}])
    hits = batch_search(catalog, df, **ROUTES[route])
    keyed = with_search_key(df).select("request_id", "search_key")
    found = {row["request_id"]: [] for row in rows}
    for row in keyed.join(hits, "search_key").collect():
        found[row["request_id"]].append(row["dataset_id"])
    expected = {row["request_id"]: _single(catalog, row) for row in rows}
    assert {k: sorted(v) for k, v in found.items()} == expected
    counts = {r["request_id"]: r["count"] for r in batch_counts(catalog, df, **ROUTES[route]).collect()}
    assert counts == {k: len(v) for k, v in expected.items()}


@pytest.mark.parametrize("route", ROUTES)
def test_batch_equals_nested_loop_on_random_text(spark, route):
    random.seed(7)

    def text(low, high):
        # Few letters, so that grams repeat and one of them is in most texts.
        return "".join(random.choices("aab é", k=random.randint(low, high)))

    datasets = [
        (i, text(0, 12), random.choice([None, text(0, 30)]), None, None, i, i, None, None, None)
        for i in range(300)
    ]
    catalog = small_catalog(spark, dataset=datasets)
    queries = [text(2, 8).strip() for _ in range(80)]
    df = requests_of(spark, [{"request_id": i, "query": q} for i, q in enumerate(queries)])
    found = {
        (row["pattern"], row["dataset_id"])
        for row in batch_search(catalog, df, **ROUTES[route]).collect()
    }
    expected = {
        (q.upper(), row[0])
        for q in queries
        if 2 <= len(q) <= 100
        for row in datasets
        if q.upper() in row[1].upper() or (row[2] and q.upper() in row[2].upper())
    }
    assert expected and found == expected


@pytest.mark.parametrize("route", ROUTES)
def test_batch_of_nothing(spark, route):
    catalog = small_catalog(spark)
    df = requests_of(spark, [{"request_id": 1, "query": "x"}])
    assert batch_search(catalog, df, **ROUTES[route]).count() == 0
    assert batch_counts(catalog, df, **ROUTES[route]).count() == 0


def test_batch_never_loops(spark):
    catalog = small_catalog(spark)
    df = requests_of(spark, [{"request_id": 1, "query": "ring", "tags_list": "public"}])
    for how in ROUTES.values():
        text = plan(batch_search(catalog, df, **how))
        assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    hot = [(i, "hot" if i % 3 else f"k{i % 5}") for i in range(200)]
    large = spark.createDataFrame(hot, "n int, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k0", 3)], "k string, v int")
    plain = large.join(small, "k", how).select(*(["n", "k", "v"] if how in ("inner", "left") else ["n", "k"]))
    spread = spread_join(large, small, "k", spread="n", how=how, slots=4).select(*plain.columns)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, spread.collect()))


def test_dataset_schema_is_complete(spark):
    assert small_catalog(spark).dataset.columns == DATASET.names


def test_order_equals_single_searches(spark):
    catalog = small_catalog(spark)
    orders = [None, [], ["size"], ["size", "desc"], ["-title"], ["description"], ["anatomical_area", "desc"], ["-id", "desc"], ["created_at", "up"]]
    requests = [(k, "in", order) for k, order in enumerate(orders)] + [(90, "in", ["no_such"]), (91, "in", ["a", "b", "c"])]
    found = batch.batch_ordered(
        catalog, spark.createDataFrame(requests, "request_id int, query string, ordering array<string>")
    ).collect()
    got: dict = {}
    for row in sorted(found, key=lambda r: r["position"]):
        got.setdefault((row["order_by"], row["descending"]), []).append(row["dataset_id"])
    expected = {}
    for order in orders:
        name, *direction = order or ["created_at", "desc"]
        down = (direction == ["desc"]) != name.startswith("-")
        named = {"anatomical_area": "anatomical_area_id"}.get(name.lstrip("-"), name.lstrip("-"))
        single = search(catalog, "in", {"ordering": order} if order else {})
        expected[named, down] = [row["id"] for row in single.collect()]
    assert got == expected


def test_ordered_by_shuffle_equals_ordered_by_broadcast(spark):
    catalog = small_catalog(spark)
    requests = [(k, query, [name, way]) for k, query in enumerate(("in", "ring")) for name in ("title", "size", "created_at") for way in ("asc", "desc")]
    df = spark.createDataFrame(requests, "request_id int, query string, ordering array<string>")
    found = [sorted(map(tuple, batch.batch_ordered(catalog, df, **how).collect()), key=repr) for how in ({}, {"small_rows": 0})]
    assert found[0] == found[1] and len(found[0]) > 12


def test_rows_to_order_carry_no_texts_of_searches(spark, monkeypatch):
    """What is sorted and numbered names its search by a number."""
    seen = []
    number_rows = batch.number_rows

    def numbered(df, column="position"):
        seen.append(df.columns)
        return number_rows(df, column)

    monkeypatch.setattr(batch, "number_rows", numbered)
    batch.batch_ordered(small_catalog(spark), spark.createDataFrame([("ring",)], "query string")).collect()
    assert seen[-1] == ["_group", "dataset_id"]
