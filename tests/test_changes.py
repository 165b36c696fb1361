from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from small import T1, T3, ids, plan, small_catalog

from shelfmark.catalog import Catalog
from shelfmark.operators import changes, quality
from shelfmark.schemas import APPLICATION_RULES, LINK_KEYS, SCRIPT_RULES, STRICT_KEYS

NOW = datetime(2025, 5, 5, 5)


@pytest.fixture(scope="module")
def catalog(spark):
    return small_catalog(spark)


def _report(df):
    return {(r["rule"], r["table_name"], r["key"], r["n_rows"]) for r in df.collect()}


def test_clean_catalog_has_no_violations(catalog):
    times = {("required created_at", "dataset", "5", 1), ("required updated_at", "dataset", "5", 1)}
    assert _report(quality.violations(catalog)) == times
    assert _report(quality.violations(catalog, SCRIPT_RULES)) == set()


def test_application_layout_has_no_roles(catalog):
    users = catalog.users.drop("role_id").union(catalog.users.drop("role_id").where("id = 1"))
    tables = {name: catalog.table(name) for name in catalog if name != "roles"}
    application = Catalog(**{**tables, "users": users})
    found = _report(quality.violations(application, APPLICATION_RULES))
    assert {("unique id", "users", "1", 2), ("unique username", "users", "ann", 2)} <= found
    assert not any("role" in rule for rule, *_ in found)


def test_violations(spark):
    broken = small_catalog(
        spark,
        modality=[(1, "CT"), (2, "CT"), (3, None), (4, "m" * 51), (5, "m" * 50)],
        dataset=[
            (1, "t" * 501, None, "p" * 1001, None, None, None, 9, T1, T1),
            (2, None, *[None] * 6, T1, T1),
            (2, "twice", *[None] * 6, T1, None),
            (None, "no id", *[None] * 6, T1, T1),
        ],
        users=[(1, "u" * 51, 1, T1), (2, "ok", 7, T1)],
        dataset_modality=[(1, 1), (1, 1), (1, None), (7, 2)],
        dataset_ml_task=[],
        dataset_tag=[],
        collection_datasets=[],
        user_dataset_collections=[],
        user_search_queries=[],
    )
    assert _report(quality.violations(broken)) == {
        ("unique name", "modality", "CT", 2),
        ("required name", "modality", "3", 1),
        ("length name", "modality", "4", 1),
        ("length title", "dataset", "1", 1),
        ("length external_path", "dataset", "1", 1),
        ("required title", "dataset", "2", 1),
        ("unique dataset_id,modality_id", "dataset_modality", '["1","1"]', 2),
        ("required modality_id", "dataset_modality", '["1",null]', 1),
        ("required updated_at", "dataset", "2", 1),
        ("required id", "dataset", "?", 1),
        ("unique id", "dataset", "2", 2),
        ("length username", "users", "1", 1),
        ("reference role_id", "users", "7", 1),
        ("reference anatomical_area_id", "dataset", "9", 1),
        ("reference dataset_id", "dataset_modality", "7", 1),
    }


def test_without_duplicates(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id int, name string")
    assert ids(quality.without_duplicates(df, ["name"])) == [1, 2, 4, 5]
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, None), (1, None)], "a int, b int")
    assert quality.without_duplicates(pairs, ["a", "b"]).count() == 3


def test_orphan_rows(catalog):
    some = catalog.dataset.where("id < 3")
    assert sorted(map(tuple, quality.orphan_rows(catalog.dataset_tag, "dataset_id", some).collect())) == [(4, 1)]


def test_blocked(spark, catalog):
    keys = spark.createDataFrame([(1,), (5,), (5,), (99,)], "id bigint")
    blocked = quality.blocked_deletes(catalog, "dataset", keys).collect()
    assert [tuple(row) for row in blocked] == [(1, "collection_datasets.dataset_id", 1)]
    strict = quality.blocked_deletes(catalog, "tag", spark.createDataFrame([(1,), (3,)], "id bigint"))
    assert [tuple(row) for row in strict.collect()] == [(1, "dataset_tag.tag_id", 3)]
    free = quality.blocked_deletes(catalog, "groups", keys)
    assert free.count() == 0 and free.columns == ["id", "referrer", "n_rows"]


def test_delete_dataset_takes_its_links(spark, catalog):
    keys = spark.createDataFrame([(1,), (4,)], "id bigint")
    left = changes.delete(catalog, "dataset", keys)
    assert ids(left.dataset) == [1, 2, 3, 5]  # 1 is in a collection
    assert ids(left.dataset_modality, "dataset_id") == [1, 1, 2]
    plain = Catalog(**{n: catalog.table(n) for n in ("dataset", "dataset_modality", "dataset_ml_task", "dataset_tag")})
    with pytest.raises(AttributeError, match="collection_datasets"):
        changes.delete(plain, "dataset", keys)
    left = changes.delete(plain, "dataset", keys, LINK_KEYS)
    assert ids(left.dataset) == [2, 3, 5]
    assert ids(left.dataset_modality, "dataset_id") == [2]
    assert ids(left.dataset_tag, "dataset_id") == [2, 2]


def test_delete_lookup(spark, catalog):
    key = spark.createDataFrame([(1,)], "id bigint")
    left = changes.delete(catalog, "tag", key)
    assert ids(left.tag) == [2, 3] and ids(left.dataset_tag, "tag_id") == [2]
    kept = changes.delete(catalog, "tag", key, STRICT_KEYS)
    assert ids(kept.tag) == [1, 2, 3]
    left = changes.delete(catalog, "anatomical_area", key)
    areas = {row["id"]: row["anatomical_area_id"] for row in left.dataset.collect()}
    assert areas == {1: None, 2: 2, 3: None, 4: None, 5: 2}
    assert left.dataset.columns == catalog.dataset.columns


def test_delete_chains(spark, catalog):
    free = catalog.replace(user_search_queries=catalog.user_search_queries.where("id <> 1"))
    left = changes.delete(free, "users", spark.createDataFrame([(1,), (2,)], "id bigint"))
    assert ids(left.users) == [2, 3]  # 2 is named in the log
    assert ids(left.user_dataset_collections) == [2]
    assert ids(left.collection_datasets, "dataset_id") == [3]


def test_upsert(spark, catalog):
    columns = [*catalog.dataset.columns, "saved_at"]
    row = lambda i, title, created, at: (i, title, *[None] * 6, created, None, at)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in catalog.dataset.schema)
    saves = spark.createDataFrame(
        [
            row(1, "first", None, T1),
            row(1, "last", None, T3),
            row(8, "new", None, T1),
            row(9, "dated", T1, T1),
        ],
        f"{kinds}, saved_at timestamp_ntz",
    )
    assert saves.columns == columns
    after = {r["id"]: r for r in changes.upsert(catalog.dataset, saves, now=NOW).collect()}
    assert sorted(after) == [1, 2, 3, 4, 5, 8, 9]
    assert after[1]["title"] == "last" and after[1]["created_at"] == T1 and after[1]["updated_at"] == NOW
    assert after[8]["created_at"] == NOW and after[9]["created_at"] == T1
    assert after[2]["updated_at"] != NOW


def test_inserts_without_id_all_stay(spark, catalog):
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in catalog.dataset.schema)
    row = lambda i, title: (i, title, *[None] * 8, T1)
    saves = spark.createDataFrame(
        [row(None, "new"), row(None, "new"), row(None, "other"), row(40, "given"), row(40, "given")],
        f"{kinds}, saved_at timestamp_ntz",
    )
    after = changes.upsert(catalog.dataset, saves, now=NOW)
    fresh = {r["id"]: r["title"] for r in after.where("id > 5").collect()}
    assert after.count() == 9 and after.where("id IS NULL").count() == 0
    assert fresh.pop(40) == "given"
    assert sorted(fresh) == [41, 42, 43] and sorted(fresh.values()) == ["new", "new", "other"]
    assert "SortAggregate" not in plan(changes.latest(saves, "id", ["saved_at"]))


def test_defaults_and_expiry(spark):
    schema = "id int, created_at timestamp_ntz, expires_at timestamp_ntz"
    df = spark.createDataFrame([(1, None, None), (2, T1, T3)], schema)
    rows = {r["id"]: r for r in changes.with_expiry(df).collect()}
    assert rows[1]["expires_at"] is None
    assert rows[2]["expires_at"] == T1 + timedelta(days=1)
    filled = {r["id"]: r["created_at"] for r in changes.with_defaults(df, NOW).collect()}
    assert filled == {1: NOW, 2: T1}
    stamped = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    clock = changes.with_defaults(df).where("id = 1").select(
        F.abs(stamped - F.unix_timestamp(F.current_timestamp())).alias("seconds")
    )
    assert clock.first()["seconds"] < 60


def test_values_are_looked_at_only_where_a_hash_came_twice(spark, monkeypatch):
    """Unique values are counted by hash; texts of those that came once are never grouped."""
    counted = []

    def kept(df, name):
        counted.append(df.collect())
        return df

    monkeypatch.setattr(quality, "kept", kept)
    catalog = small_catalog(spark, tag=[(1, "public"), (2, "public"), (3, "unused")])
    found = sorted(tuple(r) for r in quality.violations(catalog).collect() if r["rule"] == "unique name")
    assert found == [("unique name", "tag", "public", 2)]
    assert len(counted) == 1 and not [row for row in counted[0] if row["key"] in ("public", "unused")]
