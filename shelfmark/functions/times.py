"""Timestamps: the current moment, expiry, and their text form in responses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(now: datetime | None = None) -> Column:
    """The given moment, or the time of the query, as a UTC wall-clock timestamp."""
    if now is not None:
        return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def expiry(created_at: Column) -> Column:
    """One day after creation; null stays null."""
    return created_at + F.expr("INTERVAL 1 DAY")


def iso_utc(column: Column) -> Column:
    """ISO text ending in ``Z``, with microseconds only where there are any."""
    micros = F.date_format(column, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
