from __future__ import annotations

import json
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from small import T1, T3, ids, small_catalog

from shelfmark.operators import collections
from shelfmark.operators.changes import upsert
from shelfmark.operators.detail import detail_view
from shelfmark.schemas import SCHEMAS
from shelfmark.session import ensure_checkpoint_dir
from shelfmark.sources import sinks
from shelfmark.sources.readers import (
    APPLICATION_LAYOUT,
    SCRIPT_LAYOUT,
    DatabaseSource,
    read_database,
    read_files,
    read_layout,
)
from shelfmark.streaming.ingest import collection_stream, log_stream

NOW = datetime(2025, 5, 5, 5)


@pytest.fixture(scope="module")
def catalog(spark):
    return small_catalog(spark)


def test_manifest(catalog):
    rows = {row["collection_id"]: row for row in collections.manifest(catalog).collect()}
    assert (rows[1]["n_datasets"], rows[1]["archive_size_mb"]) == (2, 55)
    assert (rows[2]["n_datasets"], rows[2]["archive_size_mb"]) == (1, 0)  # no known size


def test_contents(catalog):
    rows = {(r["collection_id"], r["dataset_id"]): r for r in collections.contents(catalog).collect()}
    assert set(rows) == {(1, 1), (1, 2), (2, 3)}
    assert rows[2, 3]["query_text"] == "a_b" and rows[2, 3]["owner_id"] == 2


def test_build(spark, catalog):
    hits = spark.createDataFrame(
        [(1, 1, 0.25), (1, 1, 0.75), (1, 2, 1.0), (2, 4, 0.5), (3, 5, None)],
        "query_id bigint, dataset_id bigint, relevance_score double",
    )
    owners = spark.createDataFrame([(1, 1), (1, 3), (2, None), (3, 2), (4, 2)], "query_id bigint, user_id bigint")
    built = collections.build_collections(catalog, hits, owners, NOW)
    fresh = {r["id"]: r for r in built.user_dataset_collections.where("id > 2").collect()}
    assert sorted(fresh) == [3, 4, 5]
    assert sorted(r["user_id"] for r in fresh.values()) == [1, 2, 3]
    assert all(r["storage_path_hdfs"] == f"/collections/{i}" for i, r in fresh.items())
    assert all(r["expires_at"] == NOW + timedelta(days=1) for r in fresh.values())
    sizes = {r["user_id"]: r["archive_size_mb"] for r in fresh.values()}
    assert sizes == {1: 55, 3: 55, 2: 7}
    members = built.collection_datasets.where("collection_id > 2").collect()
    by_user = {(fresh[m["collection_id"]]["user_id"], m["dataset_id"]): m["relevance_score"] for m in members}
    assert by_user == {
        (1, 1): Decimal("0.75"), (1, 2): 1, (3, 1): Decimal("0.75"), (3, 2): 1, (2, 5): None,
    }
    plain = collections.build_collections(catalog, hits.drop("relevance_score"), owners, NOW)
    assert plain.collection_datasets.where("relevance_score IS NULL").count() == 6


def test_log(spark, catalog):
    schema = "query string, user_id bigint, performed_at timestamp_ntz"
    asked = spark.createDataFrame([("lung", 1, T1), ("brain", None, None)], schema)
    rows = sorted(collections.append_log(catalog, asked, NOW).collect(), key=lambda r: r["id"])
    assert [r["id"] for r in rows] == [4, 5]
    assert {r["query_text"]: (r["user_id"], r["filters"], r["performed_at"]) for r in rows} == {
        "lung": (1, None, T1),
        "brain": (None, None, NOW),
    }
    sizes = collections.saved_filter(catalog.user_search_queries, "$.size_max").collect()
    assert {r["id"]: r["value"] for r in sizes} == {1: 40, 2: None, 3: None}


def test_response(catalog, tmp_path):
    sinks.write_response(detail_view(catalog), str(tmp_path / "out"))
    lines = [line for f in (tmp_path / "out" / "results").glob("*.json") for line in f.read_text().splitlines()]
    rows = {row["id"]: row for row in map(json.loads, lines)}
    assert len(rows) == 5 and rows[3]["description"] is None and rows[3]["modalities"] == []
    assert rows[1]["created_at"] == "2024-01-01T00:00:00Z"
    counted = "".join(f.read_text() for f in (tmp_path / "out" / "count").glob("*.json"))
    assert json.loads(counted) == {"count": 5}


def test_archives(spark, catalog, tmp_path):
    path = str(tmp_path / "archives")
    sinks.write_archives(collections.archive_rows(catalog), path, rows_per_file=1)
    assert sorted(p.name for p in Path(path).glob("collection_id=*")) == ["collection_id=1", "collection_id=2"]
    assert len(list(Path(path).glob("collection_id=1/*.parquet"))) == 2
    assert ids(spark.read.parquet(path), "dataset_id") == [1, 2, 3]


def test_files_round_trip_and_versions(spark, catalog, tmp_path):
    root = str(tmp_path / "catalog")
    for name in catalog:
        catalog.table(name).write.parquet(f"{root}/{name}")
    stored = read_files(spark, root)
    assert sorted(map(repr, stored.dataset.collect())) == sorted(map(repr, catalog.dataset.collect()))
    saves = stored.dataset.where("id = 1").withColumn("title", F.lit("new")).withColumn("saved_at", F.lit(T3))
    where = sinks.save_version(upsert(stored.dataset, saves, now=NOW), root, "dataset-2")
    assert {r["title"] for r in spark.read.parquet(where).where("id = 1").collect()} == {"new"}
    assert {r["title"] for r in stored.dataset.where("id = 1").collect()} == {"Brain ring"}
    log = f"{root}/user_search_queries"
    sinks.append_rows(stored.user_search_queries, log)
    assert spark.read.parquet(log).count() == 6


def test_scan_prunes_and_pushes(spark, catalog, tmp_path):
    catalog.dataset.write.parquet(str(tmp_path / "dataset"))
    df = read_files(spark, str(tmp_path)).dataset.where("record_count >= 10").select("id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(record_count,10)" in text
    assert "ReadSchema: struct<id:bigint,record_count:int>" in text


def test_database_source():
    given = {"ENGINE": "postgresql", "HOST": "db", "PORT": "6000", "NAME": "cat", "USER": "u", "PASSWORD": "p"}
    source = DatabaseSource.from_environment({f"DB_{part}": value for part, value in given.items()})
    assert source.options() == {
        "url": "jdbc:postgresql://db:6000/cat",
        "driver": "org.postgresql.Driver",
        "user": "u",
        "password": "p",
    }
    assert "p'" not in repr(source)
    assert DatabaseSource.from_environment({"DB_NAME": "x.db"}).options()["url"] == "jdbc:sqlite:x.db"
    with pytest.raises(ValueError):
        DatabaseSource(engine="oracle").options()


def test_layouts(spark):
    stored = {
        "datasets": spark.createDataFrame(
            [(1, "Brain", None, "http://a", "/b", 3, 4, 1, datetime(2024, 1, 1, 12), None)],
            "id int, title string, description string, external_link string, local_storage_path string, "
            "record_count int, dataset_size_mb int, anatomical_area_id int, created_at timestamp, "
            "updated_at timestamp",
        ),
        "auth_user": spark.createDataFrame([(1, "ann")], "id int, username string"),
        "users": spark.createDataFrame(
            [(1, "ann", "secret", 2, datetime(2024, 1, 1))],
            "id int, login string, password_hash string, role_id int, created_at timestamp",
        ),
        "datasets_datasettag": spark.createDataFrame([(5, 1, 2)], "id long, dataset_id long, tag_id long"),
    }
    script = read_layout(stored.__getitem__, SCRIPT_LAYOUT)
    row = script.dataset.first()
    assert (row["external_path"], row["local_path"], row["size"]) == ("http://a", "/b", 4)
    assert dict(script.dataset.dtypes)["id"] == "bigint"
    assert dict(script.dataset.dtypes)["created_at"] == "timestamp_ntz"
    assert script.users.columns == ["id", "username", "role_id", "date_joined"]
    application = read_layout(stored.__getitem__, APPLICATION_LAYOUT)
    assert application.dataset_tag.columns == ["dataset_id", "tag_id"]
    with pytest.raises(AnalysisException):  # date_joined is missing, and only role_id may be
        application.table("users")


def test_every_stored_table_is_read_in_ranges(spark):
    asked = []

    class Source:
        def read(self, spark, table, partitions, column):
            asked.append((table, partitions, column))
            return spark.createDataFrame([(1, 2)], "dataset_id int, modality_id int")

    read_database(spark, Source(), SCRIPT_LAYOUT, partitions=7).table("dataset_modality")
    assert asked == [("dataset_modalities", 7, "dataset_id")]
    for layout in (APPLICATION_LAYOUT, SCRIPT_LAYOUT):
        for name, stored in layout.items():
            renamed = {new: old for old, new in stored.renamed.items()}
            known = {renamed.get(c, c) for c in SCHEMAS[name].names}
            assert stored.range_column in known or layout is APPLICATION_LAYOUT
    with pytest.raises(TypeError):
        read_database(spark, Source())


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("lung", 1), ("brain", None)], "query string, user_id bigint").write.parquet(source)
    stream = spark.readStream.schema("query string, user_id bigint").parquet(source)
    log_stream(stream, str(tmp_path / "log"), str(tmp_path / "log-state")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert {(r["query_text"], r["user_id"]) for r in rows} == {("lung", 1), ("brain", None)}
    assert all(r["performed_at"] is not None for r in rows)

    source = str(tmp_path / "made")
    schema = "id bigint, created_at timestamp_ntz, expires_at timestamp_ntz"
    spark.createDataFrame([(1, T1, T1)], schema).write.parquet(source)
    made = spark.readStream.schema(schema).parquet(source)
    collection_stream(made, str(tmp_path / "kept"), str(tmp_path / "kept-state")).awaitTermination(60)
    assert [r["expires_at"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == [T1 + timedelta(days=1)]


def test_checkpoints_go_where_the_session_says(spark):
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
