from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from small import ids, plan, small_catalog

from shelfmark.catalog import Catalog
from shelfmark.operators import accounts
from shelfmark.operators.detail import (
    DETAIL_COLUMNS,
    detail_by_ids,
    detail_of,
    detail_view,
    display_names,
    json_rows,
    lookup_rows,
)
from shelfmark.operators.facets import facets
from shelfmark.operators.search import search
from shelfmark.schemas import SCHEMAS
from shelfmark.sources.readers import read_tables
from shelfmark.sources.sinks import save_bucketed


@pytest.fixture(scope="module")
def catalog(spark):
    return small_catalog(spark)


def test_detail(catalog):
    rows = {row["id"]: row for row in detail_view(catalog).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert tuple(rows[1].asDict()) == DETAIL_COLUMNS
    assert rows[1]["anatomical_area"] == 1 and rows[1]["anatomical_area_name"] == "Head"
    assert [tuple(item) for item in rows[4]["modalities"]] == [(1, "CT"), (2, "MRI"), (3, " MRI")]
    assert rows[3]["anatomical_area_name"] is None
    assert rows[3]["modalities"] == [] and rows[3]["ml_tasks"] == [] and rows[3]["tags"] == []


def test_detail_of_some(spark, catalog):
    whole = {row["id"]: row for row in detail_view(catalog).collect()}
    wanted = spark.createDataFrame([(2,), (2,), (99,)], "id bigint")
    assert detail_by_ids(catalog, wanted).collect() == [whole[2]]
    assert detail_of(catalog, 4).collect() == [whole[4]]
    assert detail_of(catalog, 99).count() == 0
    hits = {row["id"]: row for row in detail_view(catalog, search(catalog, "ring")).collect()}
    assert hits == {i: whole[i] for i in (1, 2, 4, 5)}


def test_json(catalog):
    rows = {row["id"]: json.loads(row["json"]) for row in json_rows(detail_view(catalog)).collect()}
    assert list(rows[3]) == list(DETAIL_COLUMNS)
    assert rows[3]["anatomical_area_name"] is None and rows[3]["tags"] == []
    assert rows[1]["created_at"] == "2024-01-01T00:00:00Z"
    assert rows[2]["created_at"] == "2024-01-02T03:04:05.000600Z"
    assert rows[1]["modalities"] == [{"id": 1, "name": "CT"}, {"id": 2, "name": "MRI"}]


def test_bucketed_detail_needs_no_shuffle(spark):
    n = 4000
    datasets = [(i, f"title {i}", None, None, None, i, i, 1, None, None) for i in range(n)]
    links = [(i, 1 + i % 2) for i in range(n)] + [(i, 3) for i in range(n)]
    catalog = small_catalog(
        spark, dataset=datasets, dataset_modality=links, dataset_ml_task=links[:n], dataset_tag=links
    )
    spark.sql("CREATE DATABASE IF NOT EXISTS shelf")
    save_bucketed(catalog, "shelf", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")  # only the lookups fit
    try:
        view = detail_view(read_tables(spark, "shelf"))
        text = plan(view)
        assert view.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text
    assert "Exchange hashpartitioning" not in text


def test_lookup_and_names(catalog):
    assert ids(lookup_rows(catalog, "modality")) == [1, 2, 3, 4]
    labels = {(r["table_name"], r["id"]): r["label"] for r in display_names(catalog).collect()}
    assert labels["dataset", 2] == "Lung" and labels["tag", 3] == "unused"


def test_accounts(spark, catalog):
    assert [row["id"] for row in accounts.users(catalog).collect()] == [3, 2, 1]
    with_secret = catalog.replace(users=catalog.users.withColumn("password", F.lit("x")))
    assert "password" not in accounts.users(with_secret).columns
    member = {row["id"]: row["groups"] for row in accounts.users_with_groups(catalog).collect()}
    assert member == {1: [1, 2], 2: [2], 3: []}
    bare = Catalog(users=catalog.users, user_groups=catalog.user_groups)
    assert "permissions" not in accounts.users_with_groups(bare).columns
    allowed = catalog.replace(
        user_permissions=spark.createDataFrame([(1, 9), (1, 8)], SCHEMAS["user_permissions"]),
        group_permissions=spark.createDataFrame([(2, 7)], SCHEMAS["group_permissions"]),
    )
    may = {row["id"]: row["permissions"] for row in accounts.users_with_groups(allowed).collect()}
    assert may == {1: [8, 9], 2: [], 3: []}
    may = {row["id"]: row["permissions"] for row in accounts.groups_with_permissions(allowed).collect()}
    assert may == {1: [], 2: [7]}
    assert [row["name"] for row in accounts.groups(catalog).collect()] == ["guests", "staff"]
    assert ids(accounts.user_by_id(catalog, 2)) == [2]
    assert ids(accounts.group_by_id(catalog, 9)) == []


def test_facets(spark, catalog):
    def counts(df):
        return {(row["facet"], row["option"]): tuple(row)[2:] for row in df.collect()}

    found = counts(facets(catalog))
    assert found["modalities", "MRI"] == (3, None, None)
    assert found["tags", "unused"] == (0, None, None)
    assert found["anatomical_area", "Head"] == (2, None, None)
    assert found["record_count", None] == (4, 0, 30)
    assert found["size", None] == (4, 0, 50)
    links = sum(n for (facet, _), (n, _, _) in found.items() if facet == "modalities")
    assert links == catalog.dataset_modality.count()

    some = counts(facets(catalog, spark.createDataFrame([(1,), (2,)], "id bigint")))
    assert some["modalities", "CT"] == (1, None, None)
    assert some["size", None] == (2, 5, 50)

    none = counts(facets(catalog, spark.createDataFrame([], "id bigint")))
    assert none["size", None] == (0, None, None)

    twice = catalog.replace(dataset_tag=catalog.dataset_tag.union(catalog.dataset_tag))
    assert counts(facets(twice, pairs_unique=False))["tags", "public"] == (3, None, None)


@pytest.mark.parametrize("few", [True, False])
def test_details_of_many_are_dealt_in_more_parts(spark, monkeypatch, few):
    """A task has a bounded number of datasets, whatever the usual number of parts is."""
    catalog = small_catalog(spark)
    monkeypatch.setattr("shelfmark.operators.detail.PART_ROWS", 1)
    monkeypatch.setattr("shelfmark.operators.detail.is_small", lambda df: few)
    view = detail_view(catalog, catalog.dataset)
    dealt = [line for line in plan(view).split("\n") if "hashpartitioning(dataset_id" in line]
    assert len(dealt) >= 3 and all(", 5)" in line for line in dealt)
    assert sorted(map(str, view.collect())) == sorted(map(str, detail_view(catalog).collect()))
