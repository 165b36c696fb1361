"""Writing tables, responses, archives and the search log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.times import iso_utc
from shelfmark.schemas import RELATIONS

ROWS_PER_FILE = 5_000_000


def save_version(df: DataFrame, root: str, version: str) -> str:
    """Write a changed table beside the old one and return where it is.

    The rows usually come from the old version, so it must stay until readers
    have been pointed at the new path.
    """
    path = f"{root}/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def save_bucketed(catalog: Catalog, database: str, buckets: int) -> None:
    """Save datasets and links bucketed by dataset, lookups plain.

    The detail view and the link filters then join and aggregate on the dataset
    without shuffling either side.
    """
    bridges = {relation.bridge for relation in RELATIONS.values()}
    for name in catalog:
        df = catalog.table(name)
        writer = df.write.mode("overwrite").format("parquet")
        if name == "dataset" or name in bridges:
            key = "id" if name == "dataset" else "dataset_id"
            writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")


def write_response(detail: DataFrame, path: str) -> None:
    """A search response: ``<path>/count`` and ``<path>/results``, as JSON lines.

    The result is written once and counted from what was written. Nulls are kept
    and times are ISO text in UTC. Rows stay spread over the tasks that made
    them, so the response has no size limit.
    """
    times = {name: iso_utc(F.col(name)) for name in ("created_at", "updated_at") if name in detail.columns}
    results = f"{path}/results"
    detail.withColumns(times).write.mode("errorifexists").option("ignoreNullFields", "false").json(results)
    spark = detail.sparkSession
    written = spark.read.schema("id BIGINT").json(results).agg(F.count("*").alias("count"))
    written.write.mode("errorifexists").json(f"{path}/count")


def write_archives(rows: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per collection.

    The rebalance hint gathers a collection's rows so that it gets few files,
    and cuts a collection too large for one task into several.
    """
    (
        rows.hint("rebalance", "collection_id")
        .write.mode("append")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("collection_id")
        .parquet(path)
    )


def append_rows(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a stored table, such as the search log."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)
