"""The search log as a stream whose rows get ids, once each.

Every batch becomes one folder, put in place by one rename. The folder is named
by the batch and holds the next free id in its name, so the listing is the
ledger of ids: a batch that is run again finds its folder and does nothing, and
one that failed on the way left nothing and begins at the same id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.collections import log_entries
from shelfmark.operators.numbering import number_rows
from shelfmark.schemas import SCHEMAS
from shelfmark.sources.folders import listed, put_in_place

LOG = SCHEMAS["user_search_queries"]


def next_id(spark: SparkSession, path: str, first_id: int = 1) -> int:
    """The id the next row of the log at ``path`` gets."""
    batches = [name for name in listed(spark, f"{path}/rows") if name.startswith("batch=")]
    if not batches:
        return first_id
    (name,) = [name for name in listed(spark, f"{path}/rows/{batches[-1]}") if name.startswith("next=")]
    return int(name.removeprefix("next="))


def write_batch(entries: DataFrame, number: int, path: str, first_id: int = 1) -> None:
    """Append a batch of log entries with ids that follow those of the batches before it; again, it changes nothing."""
    spark = entries.sparkSession
    name = f"batch={number:012d}"
    if name in listed(spark, f"{path}/rows"):
        return
    start = next_id(spark, path, first_id)
    rows = number_rows(entries.drop("id"), "_number").withColumn("id", F.col("_number") + start)
    prepared = f"{path}/prepared/{uuid.uuid4().hex}"
    rows.select(*(F.col(field.name).cast(field.dataType) for field in LOG)).write.parquet(f"{prepared}/rows")
    count = spark.read.schema(LOG).parquet(f"{prepared}/rows").count()
    put_in_place(spark, f"{prepared}/rows", f"{prepared}/{name}/next={start + count}")
    put_in_place(spark, f"{prepared}/{name}", f"{path}/rows/{name}")


def numbered_log_stream(requests: DataFrame, path: str, checkpoint: str, first_id: int = 1, **trigger) -> StreamingQuery:
    """Append a stream of requests to the log at ``path``, each row with an id of its own from ``first_id`` on."""

    def write(batch: DataFrame, number: int) -> None:
        write_batch(log_entries(batch), number, path, first_id)

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def numbered_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the log at ``path``."""
    if not listed(spark, f"{path}/rows"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{path}/rows").select(*LOG.names)
