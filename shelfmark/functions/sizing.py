"""Counting a table before it is sent to every executor, and fixing it in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import ensure_checkpoint_dir

SMALL_ROWS = 100_000
SMALL_BYTES = 32 * 1024 * 1024


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes of content.

    Each task counts its own rows and sends one row on. Meant for tables that
    are cheap to read, such as a :func:`settled` one.
    """
    content = sum(
        (F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) for name in df.columns),
        F.lit(8 * len(df.columns)),
    )
    found = (
        df.select(content.cast("bigint").alias("content"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("content"), F.lit(0)).alias("size"))
        .first()
    )
    return found["n"] <= rows and found["size"] <= size


def sent_if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast when it is small; otherwise as it is.

    For tables that are cheap to count. The unmarked table joins by shuffle.
    """
    return F.broadcast(df) if is_small(df) else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder.

    For a result that several joins of one plan read, such as the hits of a
    search: they then share one computation and one set of rows, and its size
    can be counted for little.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
