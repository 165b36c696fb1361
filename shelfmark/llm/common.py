"""What several operators share: word splitting, batch sizes, shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The word classes of the result contracts.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK_WORD = r"[^\x20\x09-\x0D]+"

_ALNUM = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
# Lower-cases A-Z and turns every ASCII character outside 0-9 and a-z into a blank.
ALNUM_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in _ALNUM)
LOWER_TABLE = _ALNUM

BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 * 1024 * 1024


def bounded_batches(spark: SparkSession) -> None:
    """Keep what one Python worker receives at once small, also for long texts."""
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def alnum_words(text: bytes) -> list[bytes]:
    """Words of 0-9, a-z (A-Z lowered) and everything beyond ASCII."""
    return text.translate(ALNUM_TABLE).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words between blanks and the controls 9 to 13."""
    return text.split()


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(rows: Iterable[tuple], size, limit: int) -> Iterator[list[tuple]]:
    """Cut a stream of rows into lists whose summed size stays near ``limit``."""
    block: list[tuple] = []
    total = 0
    for row in rows:
        block.append(row)
        total += size(row)
        if total >= limit:
            yield block
            block, total = [], 0
    if block:
        yield block


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def ragged_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def smallest_reachable(edges: Sequence[np.ndarray], n: int) -> np.ndarray:
    """For nodes 0..n-1, the smallest node each one is linked to by a path."""
    label = np.arange(n)
    left, right = edges
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label
