"""Rows that arrive over time: searches for the log, and new collections.

Both are stateless per-row rules, so they run unchanged on a stream; the
checkpoint folder of a query must be on storage all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.changes import with_defaults, with_expiry
from shelfmark.operators.collections import log_entries


def log_stream(requests: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of requests to the log at ``path``.

    Rows get no id here: numbering needs the whole log, and is done by
    :func:`~shelfmark.operators.collections.append_log` or when the log is read.
    """
    return _append(log_entries(requests), path, checkpoint, trigger)


def collection_stream(collections: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of new collections to ``path``, each set to expire after a day."""
    return _append(with_expiry(with_defaults(collections)), path, checkpoint, trigger)


def _append(rows: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append")
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
