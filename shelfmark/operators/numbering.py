"""Consecutive numbers over a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.sources.folders import kept

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in its low 33 bits


def number_rows(df: DataFrame, column: str = "position") -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``column``, following partitions and their rows.

    Rows are never gathered in one task. Each is marked with its partition and
    its place there, the marks are fixed in files (so a lost executor cannot
    change them, and the rows are computed once), and one row per partition gives the offsets. Any
    distribution of the data is fine, a single hot value included.
    """
    marked = kept(
        df.withColumns(
            {
                "_part": F.spark_partition_id(),
                "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
            }
        ),
        "marked",
    )
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition of df, so neither the window's single task nor the
    # broadcast below grows with the rows.
    offsets = (
        marked.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    return marked.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_place")).cast("bigint").alias(column)
    )


def assign_ids(batch: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """``batch`` with fresh ids in ``key``, following the largest of ``existing``."""
    rows = batch.drop(key)
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).scalar()
    numbered = number_rows(rows, "_number").withColumn(key, F.col("_number") + 1 + top)
    return numbered.select(key, *rows.columns)
