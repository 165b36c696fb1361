"""Collections of datasets put together from search hits, and the search log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.sizing import settled
from shelfmark.functions.skew import spread_join
from shelfmark.functions.times import moment
from shelfmark.operators.changes import with_expiry
from shelfmark.operators.numbering import assign_ids
from shelfmark.schemas import SCHEMAS

ARCHIVE_ROOT = "/collections"


def archive_sizes(collection_datasets: DataFrame, datasets: DataFrame) -> DataFrame:
    """``(collection_id, n_datasets, archive_size_mb)``; unknown sizes count as nothing."""
    sizes = datasets.select(F.col("id").alias("dataset_id"), "size")
    return (
        collection_datasets.join(sizes, "dataset_id")
        .groupBy("collection_id")
        .agg(
            F.count("*").alias("n_datasets"),
            F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("archive_size_mb"),
        )
    )


def build_collections(
    catalog: Catalog,
    hits: DataFrame,
    owners: DataFrame,
    now: datetime | None = None,
    root: str = ARCHIVE_ROOT,
) -> Catalog:
    """The catalog with one new collection per owner row that has hits.

    ``hits``: ``query_id, dataset_id`` and, if known, ``relevance_score``.
    ``owners``: ``query_id, user_id``; the query in the log and who it is for.
    Ids follow those in use, the archive path is ``<root>/<id>``, the size is
    that of the datasets collected, and the collection expires after one day.
    """
    score = F.max("relevance_score") if "relevance_score" in hits.columns else F.lit(None)
    picked = settled(
        hits.groupBy("query_id", "dataset_id").agg(score.cast("decimal(5,4)").alias("relevance_score"))
    )
    asked = owners.select("query_id", "user_id").where(F.col("user_id").isNotNull()).distinct()
    wanted = asked.join(picked.select("query_id").distinct(), "query_id", "left_semi")
    # Fresh ids must not change between their two uses, headers and members.
    headers = settled(assign_ids(wanted, catalog.user_dataset_collections))
    # A popular text has as many headers as askers, so those are cut into pieces.
    askers = headers.groupBy("query_id").agg(F.count("*").alias("n"))
    members = spread_join(
        headers.select("query_id", F.col("id").alias("collection_id")),
        picked,
        "query_id",
        spread="collection_id",
        counts=askers,
    ).select(*SCHEMAS["collection_datasets"].names)
    sizes = archive_sizes(members, catalog.dataset).select(
        F.col("collection_id").alias("id"), "archive_size_mb"
    )
    path = F.concat(F.lit(root + "/"), F.col("id").cast("string"))
    collections = with_expiry(
        headers.join(sizes, "id", "left").select(
            "id",
            "user_id",
            path.alias("storage_path_hdfs"),
            F.coalesce("archive_size_mb", F.lit(0)).cast("bigint").alias("archive_size_mb"),
            moment(now).alias("created_at"),
        )
    )
    return catalog.replace(
        user_dataset_collections=catalog.user_dataset_collections.unionByName(
            collections, allowMissingColumns=True
        ),
        collection_datasets=catalog.collection_datasets.unionByName(members),
    )


def manifest(catalog: Catalog) -> DataFrame:
    """Per collection, empty ones too: owner, number of datasets, total size, path and times."""
    sizes = archive_sizes(catalog.collection_datasets, catalog.dataset)
    return (
        catalog.user_dataset_collections.drop("archive_size_mb")
        .join(sizes.withColumnRenamed("collection_id", "id"), "id", "left")
        .select(
            F.col("id").alias("collection_id"),
            "user_id",
            "storage_path_hdfs",
            F.coalesce("n_datasets", F.lit(0)).cast("bigint").alias("n_datasets"),
            F.coalesce("archive_size_mb", F.lit(0)).cast("bigint").alias("archive_size_mb"),
            "created_at",
            "expires_at",
        )
    )


def contents(catalog: Catalog) -> DataFrame:
    """Every collected dataset with its collection's owner and the query that found it."""
    collections = catalog.user_dataset_collections.select(
        F.col("id").alias("collection_id"), F.col("user_id").alias("owner_id")
    )
    queries = catalog.user_search_queries.select(F.col("id").alias("query_id"), "query_text")
    datasets = catalog.dataset.select(F.col("id").alias("dataset_id"), "title", "size")
    return (
        catalog.collection_datasets.join(datasets, "dataset_id")
        .join(queries, "query_id")
        .join(collections, "collection_id")
        .select(
            "collection_id", "owner_id", "dataset_id", "title", "size", "relevance_score", "query_id", "query_text"
        )
    )


def archive_rows(catalog: Catalog) -> DataFrame:
    """What a collection's archive holds: its datasets' rows, keyed by collection."""
    datasets = catalog.dataset.withColumnRenamed("id", "dataset_id")
    return catalog.collection_datasets.select("collection_id", "dataset_id", "relevance_score").join(
        datasets, "dataset_id"
    )


def log_entries(requests: DataFrame, now: datetime | None = None) -> DataFrame:
    """Requests as rows for the search log, without ids.

    ``requests`` has ``query`` and may have ``user_id`` (null: anonymous),
    ``filters`` (JSON text) and ``performed_at`` (default: now).
    """
    performed = moment(now)
    if "performed_at" in requests.columns:
        performed = F.coalesce(F.col("performed_at"), performed)
    optional = {
        name: F.col(name) if name in requests.columns else F.lit(None)
        for name in ("user_id", "filters")
    }
    return requests.select(
        optional["user_id"].cast("bigint").alias("user_id"),
        F.col("query").alias("query_text"),
        optional["filters"].cast("string").alias("filters"),
        performed.alias("performed_at"),
    )


def append_log(catalog: Catalog, requests: DataFrame, now: datetime | None = None) -> DataFrame:
    """New log rows for ``requests``, numbered after those the log already has."""
    return assign_ids(log_entries(requests, now), catalog.user_search_queries)


def saved_filter(log: DataFrame, path: str, kind: str = "int") -> DataFrame:
    """``(id, value)``: one value of the saved JSON filters, null where it is absent."""
    return log.select("id", F.get_json_object("filters", path).try_cast(kind).alias("value"))
