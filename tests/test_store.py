from __future__ import annotations

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from small import T1, plan, small_catalog

from shelfmark.functions.bits import bit_words, is_set_in
from shelfmark.operators import changes, stored_changes
from shelfmark.operators.stored_changes import delete_rows, save_rows
from shelfmark.schemas import APPLICATION_KEYS, DATASET, LINK_KEYS, RELATIONS, STRICT_KEYS
from shelfmark.sources.folders import listed
from shelfmark.sources.store import Store

NOW = datetime(2025, 5, 5, 5)
KEYS = {
    "dataset_modality": ("dataset_id", "modality_id"), "dataset_ml_task": ("dataset_id", "ml_task_id"),
    "dataset_tag": ("dataset_id", "tag_id"), "user_groups": ("user_id", "group_id"),
    "user_permissions": ("user_id", "permission_id"), "group_permissions": ("group_id", "permission_id"),
    "collection_datasets": ("collection_id", "dataset_id"),
}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "a store"))  # a blank in the path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def numbers(spark, n):
    return spark.range(n).select("id", (F.col("id") * 2).alias("double"))


def data_files(store):
    return {p: p.read_bytes() for p in Path(store.root).rglob("data/**/*.parquet")}


def names(version, table):
    return {r["file"] for r in version.files(table).collect()}


def test_files_hold_ranges(spark, store):
    version = store.open().with_table("t", numbers(spark, 1000), ["id"], files=6).put()
    found = sorted((int(r["low"]), int(r["high"]), r["rows"]) for r in version.files("t").collect())
    assert len(found) == 6 and found[0][0] == 0 and found[-1][1] == 999 and sum(r[2] for r in found) == 1000
    assert all(a[1] < b[0] for a, b in zip(found, found[1:]))
    assert rows(store.open().read("t")) == rows(numbers(spark, 1000))
    few = spark.createDataFrame([(found[0][0],), (found[3][1],), (5000,), (None,)], "id long")
    assert version.touched("t", few).count() == 2
    assert version.read("t", few).count() == found[0][2] + found[3][2]


def test_a_hot_key_is_cut_into_files(spark, store):
    links = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("dataset_id"), F.col("id").alias("tag_id"))
    version = store.open().with_table("links", links, ["dataset_id", "tag_id"], files=6).put()
    assert max(r["rows"] for r in version.files("links").collect()) < 1000
    seven = spark.createDataFrame([(7,)], "dataset_id long")
    assert version.read("links", seven).where("dataset_id = 7").count() == 2000


def test_empty_tables_and_missing_versions(spark, store):
    version = store.open()
    assert version.number == 0 and store.versions() == []
    version = version.with_table("t", numbers(spark, 0), ["id"]).put()
    assert store.open().read("t").columns == ["id", "double"] and store.open().read("t").count() == 0
    assert store.open().rows("t", version.files("t"), marked=True).columns == ["id", "double", "_file", "_row"]
    added = save_rows(version, "t", spark.createDataFrame([(3, 4, 0)], "id long, double long, saved_at int"))
    assert rows(added.read("t")) == [(3, 4)]


def test_bitmaps_equal_a_filter(spark, store):
    """Rows over several buckets of a bitmap, deleted in two steps, then written anew."""
    n = 150_000
    version = store.open().with_table("t", numbers(spark, n), ["id"], files=2).put()
    state, gone = version, F.lit(False)
    for condition in ("id % 3 = 0", "id % 7 = 1 or id = 149999"):
        before = data_files(store)
        state = state.without("t", state.rows("t", state.files("t"), marked=True).where(condition)).put()
        gone = gone | F.expr(condition)
        assert data_files(store) == before
        left = numbers(spark, n).where(~gone)
        assert state.read("t").exceptAll(left).isEmpty() and state.read("t").count() == left.count()
        deleted = state.files("t").agg(F.sum("deleted"), F.sum("rows")).first()
        assert deleted[1] - deleted[0] == left.count()
    whole = state.compacted("t").put()
    assert rows(whole.files("t").select("deletes").distinct()) == [(None,)]
    assert whole.read("t").exceptAll(state.read("t")).isEmpty() and whole.read("t").count() == state.read("t").count()
    assert version.read("t").count() == n  # the version before is as it was


def test_one_bitmap_replaces_another(spark, store):
    version = store.open().with_table("t", numbers(spark, 100), ["id"], files=4).put()
    for k in (1, 2, 99, 50, 3):
        version = version.without("t", version.rows("t", version.files("t"), marked=True).where(f"id = {k}"))
    assert version.put().read("t").count() == 95
    assert version.read("t").where("id in (1, 2, 3, 50, 99)").isEmpty()


def test_two_writers(spark, store):
    first = store.open().with_table("t", numbers(spark, 10), ["id"]).put()
    one, other = (first.with_rows("t", spark.createDataFrame([(k, k)], "id long, double long")) for k in (100, 200))
    assert one.put().read("t").count() == 11
    with pytest.raises(FileExistsError):
        other.put()
    assert store.versions() == [1, 2] and store.open().read("t").where("id = 200").isEmpty()


def many_datasets(spark, n=400):
    made = [(k, f"title {k}", None, None, None, k % 9, k % 5, k % 4, T1 if k % 3 else None, T1) for k in range(0, 2 * n, 2)]
    return spark.createDataFrame(made, DATASET)


SAVES = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in DATASET)}, saved_at int"


def saves(spark, ids):
    return spark.createDataFrame([(k, f"saved {k} {at}", *[None] * 8, at) for at, k in enumerate(ids)], SAVES)


def test_a_save_leaves_other_files_alone(spark, store):
    datasets = many_datasets(spark)
    version = store.open().with_table("dataset", datasets, ["id"], files=8).put()
    before = data_files(store)
    some = saves(spark, [10, 11, 12, 12, 10, 799, 900, -5])
    after = save_rows(version, "dataset", some, now=NOW).put()
    assert rows(after.read("dataset")) == rows(changes.upsert(datasets, some, now=NOW))
    assert rows(version.read("dataset")) == rows(datasets)
    now = data_files(store)
    assert {path: now[path] for path in before} == before
    kept = names(version, "dataset") & names(after, "dataset")
    assert len(kept) == 6  # of 8: the first file and the last were touched
    # Only what was touched is read.
    assert plan(after.read("dataset", spark.createDataFrame([(400,)], "id long"))).count("FileScan") == 1


@pytest.mark.parametrize("few", [True, False])
def test_saves_equal_the_whole_upsert(spark, store, monkeypatch, few):
    if not few:
        monkeypatch.setattr(stored_changes, "is_small", lambda df: False)
    rnd = random.Random(few)
    table = many_datasets(spark, 60)
    version = store.open().with_table("dataset", table, ["id"], files=5)
    for _ in range(3):
        some = saves(spark, [rnd.choice([None, rnd.randint(-20, 200)]) for _ in range(rnd.randint(1, 25))])
        table = spark.createDataFrame(changes.upsert(table, some, now=NOW).collect(), DATASET)
        version = save_rows(version, "dataset", some, now=NOW)
        found = version.read("dataset")
        assert rows(found.where("id <= 200")) == rows(table.where("id <= 200"))
        assert found.count() == table.count() == found.select("id").distinct().count()
        # Which of the new rows gets which of the fresh ids is not fixed.
        assert rows(found.drop("id")) == rows(table.drop("id"))
    low_high = sorted((int(r["low"]), int(r["high"])) for r in version.files("dataset").collect())
    assert all(a[1] < b[0] for a, b in zip(low_high, low_high[1:]))


def test_a_failed_save_changes_nothing(spark, store):
    version = store.open().with_table("dataset", many_datasets(spark, 50), ["id"], files=3).put()
    broken = saves(spark, [4, 6]).withColumn("title", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        save_rows(version, "dataset", broken, now=NOW).put()
    assert store.versions() == [1]
    assert rows(store.open().read("dataset")) == rows(many_datasets(spark, 50))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The small catalog, whole and stored."""
    catalog = small_catalog(spark)
    version = Store(spark, str(tmp_path_factory.mktemp("small"))).open()
    for name in catalog:
        version = version.with_table(name, catalog.table(name), KEYS.get(name, ("id",)), files=2)
    return catalog, version.put()


@pytest.mark.parametrize(
    ("table", "gone", "rules"),
    [
        ("dataset", [1, 4, 77], LINK_KEYS), ("anatomical_area", [2], APPLICATION_KEYS), ("modality", [1, 2], APPLICATION_KEYS),
        ("users", [1, 2, 3], STRICT_KEYS), ("dataset", [1, 2, 3, 4, 5], STRICT_KEYS), ("user_search_queries", [1], STRICT_KEYS),
        ("tag", [], APPLICATION_KEYS),
    ],
)
def test_deletes_equal_those_on_whole_tables(spark, small, table, gone, rules):
    catalog, version = small
    before = data_files(version.store)
    keys = spark.createDataFrame([(k,) for k in gone], "id long")
    after = delete_rows(version, table, keys, rules)
    expected = changes.delete(catalog, table, keys, rules)
    concerned = [name for name in catalog if after.entries[name] is not version.entries[name]]
    assert bool(concerned) == any(fk.parent == table for fk in rules if gone)
    for name in {*concerned, table, *(fk.child for fk in rules if fk.parent == table)}:
        assert rows(after.read(name)) == rows(expected.table(name)), name
    for name in concerned:
        assert rows(version.read(name)) == rows(catalog.table(name)), name
    # Only references that became null are written again.
    assert bool(data_files(version.store).keys() - before.keys()) == (table == "anatomical_area")
    if table == "anatomical_area":
        assert rows(after.compacted("dataset").read("dataset")) == rows(expected.dataset)


def test_saves_after_deletes(spark, small):
    """A row set to null lies in a new file over the same range; saves find it there."""
    catalog, version = small
    version = delete_rows(version, "anatomical_area", spark.createDataFrame([(1,)], "id long"))
    left = changes.delete(catalog, "anatomical_area", spark.createDataFrame([(1,)], "id long"))
    some = saves(spark, [1, 4, 3])
    after = save_rows(version, "dataset", some, now=NOW)
    assert rows(after.read("dataset")) == rows(changes.upsert(left.dataset, some, now=NOW))


def test_links_of_deleted_datasets_are_found_by_range(spark, store):
    links = spark.range(5000).select((F.col("id") % 1000).alias("dataset_id"), F.col("id").alias("tag_id"))
    version = store.open().with_table("dataset", numbers(spark, 1000), ["id"], files=4)
    for name, relation in ((r.bridge, r) for r in RELATIONS.values()):
        version = version.with_table(name, links.withColumnRenamed("tag_id", relation.key), ["dataset_id", relation.key], files=5)
    version = version.put()
    gone = spark.createDataFrame([(3,), (5,)], "id long")
    after = delete_rows(version, "dataset", gone, [fk for fk in LINK_KEYS if fk.parent == "dataset"])
    holed = after.files("dataset_tag").where("deleted > 0").collect()
    assert len(holed) == 1 and holed[0]["deleted"] == 10
    assert listed(spark, f"{store.root}/nowhere") == []


def test_files_follow_the_rows(spark, tmp_path, monkeypatch):
    """No task sorts more rows because a table got larger, whatever number of files was asked for."""
    monkeypatch.setattr("shelfmark.sources.store.ROWS_PER_TASK", 100)
    version = Store(spark, str(tmp_path)).open().with_table("numbers", spark.range(1000), ["id"], files=2)
    files = version.files("numbers").collect()
    assert len(files) >= 10 and sum(row["rows"] for row in files) == 1000
    assert sorted(row["id"] for row in version.read("numbers").collect()) == list(range(1000))


def test_words_of_bitmaps(spark):
    rng = random.Random(3)
    bitmaps = [bytearray(rng.randbytes(n)) for n in (1, 2, 3, 4, 5, 4096)] + [bytearray(), None]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bitmaps)], "k int, bitmap binary")
    held = df.select("k", bit_words(F.col("bitmap")).alias("words")).select("k", F.explode(F.sequence(F.lit(0), F.lit(90))).alias("at"), "words")
    for row in held.select("k", "at", is_set_in(F.col("words"), F.col("at")).alias("bit")).collect():
        bits, at = bitmaps[row["k"]] or b"", row["at"]
        assert row["bit"] == (at // 8 < len(bits) and bool(bits[at // 8] >> at % 8 & 1))
