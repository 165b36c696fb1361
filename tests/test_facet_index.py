from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from small import plan, small_catalog

from shelfmark.functions.bits import is_set
from shelfmark.operators import facet_index
from shelfmark.operators.facets import facets
from shelfmark.operators.search import find
from shelfmark.schemas import DATASET, RELATIONS
from shelfmark.sources.store import Store

N = 400


def made(spark, seed=1):
    """Datasets over several buckets of ids, some of them far apart."""
    rnd = random.Random(seed)
    ids = [k if k < 200 else 40_000 + 997 * k for k in range(N)]
    datasets = [
        (i, rnd.choice(["Brain ring", "Lung", "a_b ring"]), rnd.choice([None, "RING of 50%"]), None, None, rnd.choice([None, *range(9)]),
         rnd.choice([None, 1, 5, 9]), rnd.choice([None, 1, 2]), None, None)
        for i in ids
    ]
    links = {
        relation.bridge: sorted({(rnd.choice(ids), rnd.randint(1, 3)) for _ in range(2 * N)}) + [(10**6, 1)] for relation in RELATIONS.values()
    }
    return small_catalog(spark, dataset=datasets, **links)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OWN = {"anatomical_area": "anatomical_area", "modalities": "modalities", "ml_tasks": "ml_tasks", "tags": "tags", "record_count": "record_count", "size": "size"}
SEARCHES = [
    {},
    {"modalities_list": "CT,MRI"},
    {"modalities_list": "CT", "ml_tasks_id_list": "2", "size_min": 2, "record_count_max": 6},
    {"anatomical_area_name": "Chest", "tags_list": "public,large", "record_count_min": 1},
    {"anatomical_area_id": 1, "tags_list": "nothing"},
]


def expected(catalog, query, params):
    """Each facet from a search without the parameters of its own field."""
    found = []
    for facet, field in OWN.items():
        left = {name: value for name, value in params.items() if not name.startswith(f"{field}_")}
        every = facets(catalog, find(catalog, query, left).select("id"))
        found += rows(every.where(F.col("facet") == facet))
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Some options as bitmaps and some as lists."""
    catalog = made(spark)
    version = Store(spark, str(tmp_path_factory.mktemp("facets"))).open()
    return catalog, facet_index.with_facets(version, catalog, files=4, few=20).put()


@pytest.mark.parametrize("params", SEARCHES, ids=range(len(SEARCHES)))
def test_equals_one_search_per_facet(indexed, params):
    catalog, version = indexed
    assert rows(facet_index.facets_in_progress(version, catalog, "ring", params)) == expected(catalog, "ring", params)


@pytest.mark.parametrize("few", [0, 10**6])
def test_bitmaps_or_lists_alone(indexed, tmp_path, few):
    catalog, version = indexed
    other = facet_index.with_facets(Store(version.store.spark, str(tmp_path)).open(), catalog, files=2, few=few)
    found = facet_index.facets_in_progress(other, catalog, "ring", SEARCHES[2])
    assert rows(found) == rows(facet_index.facets_in_progress(version, catalog, "ring", SEARCHES[2]))


def test_links_are_not_read(indexed):
    catalog, version = indexed

    def never():
        raise AssertionError("links were read")

    blind = catalog.replace(**{relation.bridge: never for relation in RELATIONS.values()})
    found = facet_index.facets_in_progress(version, blind, "ring", SEARCHES[2])
    assert found.count() == 2 + 4 + 2 + 3 + 2 and "Cartesian" not in plan(found)


def test_changes_build_only_their_buckets_anew(spark, tmp_path):
    before, after = made(spark), made(spark, seed=2)
    # Only datasets of the first bucket change.
    mixed = {
        name: before.table(name).where(f"{key} >= 200").unionByName(after.table(name).where(f"{key} < 200"))
        for name, key in [("dataset", "id"), *((r.bridge, "dataset_id") for r in RELATIONS.values())]
    }
    catalog = before.replace(**mixed)
    version = facet_index.with_facets(Store(spark, str(tmp_path)).open(), before, files=4, few=5).put()
    changed = spark.createDataFrame([(0,), (3,), (199,)], "id long")
    found = facet_index.with_changed(version, catalog, changed, few=5)
    assert rows(facet_index.facets_in_progress(found, catalog, "ring", SEARCHES[1])) == expected(catalog, "ring", SEARCHES[1])
    fresh = found.files(facet_index.OPTIONS).join(version.files(facet_index.OPTIONS).select("file"), "file", "left_anti")
    of_bucket = version.read(facet_index.OPTIONS).where("bucket <= 1").count()
    assert fresh.agg(F.sum("rows")).scalar() is not None and of_bucket < version.read(facet_index.OPTIONS).count() / 2


def test_bits(spark):
    numbers = [0, 1, 7, 8, 4095, 32767, 32768, 32769, 100_000]
    held = spark.createDataFrame([(n,) for n in numbers], "n long")
    bits = held.groupBy(F.bitmap_bucket_number("n").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("m"))
    asked = spark.range(110_000).withColumn("b", F.bitmap_bucket_number("id")).join(bits, "b", "left")
    found = asked.where(is_set(F.col("m"), F.bitmap_bit_position("id"))).select("id").collect()
    assert sorted(r["id"] for r in found) == numbers


def test_unknown_field(spark, indexed):
    catalog, version = indexed
    with pytest.raises(ValueError, match="colour"):
        facet_index.facets_in_progress(version, catalog, "ring", {"colour_list": "red"})
    assert DATASET.names[0] == "id"


def test_bitmaps_are_made_where_positions_have_met(spark):
    """No task sends a bitmap of full size for the few positions it has of a cell."""
    links = spark.createDataFrame([("tags", 1, k) for k in range(1, 10)] + [("tags", 2, 3)], "facet string, option long, id long")
    cells = facet_index._cells(links, 2)
    text = plan(cells)
    assert "bitmap_construct_agg" in text and "bitmap_construct_agg" not in text.split("Exchange")[-1]
    found = {r["option"]: r for r in cells.collect()}
    assert found[1]["bitmap"][:2] == bytes([255, 1]) and found[1]["positions"] is None
    assert found[2]["bitmap"] is None and found[2]["positions"] == [2]
