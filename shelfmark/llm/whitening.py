"""Whitening of embeddings by distributed block matrices.

Entries become whole numbers, so that sums, means and deviations are exact. The
fit list is each distinct vector once; its rows are numbered, centred and cut
into the blocks of a ``BlockMatrix``. The product of its transpose with itself
is the scatter matrix, as small as the vectors are wide: only that is taken to
the driver and decomposed. A second product, of all numbered rows with the
whitening matrix, projects them, and a third, of the projected fit list with
itself, measures how far the result is from being white.

The scatter product is cut along the rows into as many parts as there are
partitions, each summed before the parts meet, so no task holds more than its
blocks. Rows are joined with their projection by their number, which no two
share, so repeated vectors make no key hot.

Defined cases: rows whose vector is null, or holds null, NaN or infinite
entries, are left out; so are empty vectors and those of another length than
most rows' (of equally common lengths the largest counts); whole numbers are cut off
at 2 ** 52 either way; a deviation beyond a long is null; components without
variance (less than 1e-12 of the largest) are zero for every row and count as
white; repeated rows and null vec_ids are kept; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import bounded_batches, first_of_runs, written
from shelfmark.operators.numbering import number_rows

# How an entry becomes a whole number.
SCALE, OFFSET = 64, 1_000_000

COMPONENTS = 16
BLOCK_ROWS = 1024
FLAT = 1e-12
MOST = 1 << 52
LOW_BITS = 26


def whole_numbers(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, the whole numbers of every usable vector of the usual length."""
    value = F.col(column).cast("array<double>")
    usable = F.forall(value, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_column).alias("vec_id"), value.alias("value")).where(
        F.col("value").isNotNull() & (F.size("value") > 0) & usable
    )
    usual = rows.groupBy(F.size("value").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return rows.select("vec_id", F.col("value").cast("array<bigint>").alias("x"))
    limit = float(MOST)
    # Cut off before the cast, which refuses what no long can hold.
    x = F.transform(
        "value", lambda c: F.floor(F.least(F.greatest(SCALE * c, F.lit(-limit)), F.lit(limit))).cast("bigint") + OFFSET
    )
    return rows.where(F.size("value") == usual["n"]).select("vec_id", x.alias("x"))


@dataclass(frozen=True)
class Fit:
    """What the fit list says: its size, the sum and range of each dimension."""

    n: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]

    @classmethod
    def of(cls, distinct: DataFrame) -> "Fit":
        """One row per dimension and task is added up; sums are kept in two halves, so none overflows."""
        width = len(distinct.first()["x"])

        def partial(batches):
            n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
            least, most = np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
            for batch in batches:
                x = _matrix(batch.column(0), width)
                if len(x):
                    n += len(x)
                    high += (x >> LOW_BITS).sum(axis=0)
                    low += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
                    least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
            if n:
                columns = [np.arange(width), np.full(width, n), high, low, least, most]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        names = ["dimension", "n", "high", "low", "least", "most"]
        parts = distinct.select("x").mapInArrow(partial, ", ".join(f"{name} long" for name in names))
        rows = (
            parts.groupBy("dimension")
            .agg(*(F.sum(name).alias(name) for name in names[1:4]), F.min("least").alias("least"), F.max("most").alias("most"))
            .orderBy("dimension")
            .collect()
        )
        return cls(
            rows[0]["n"],
            tuple((r["high"] << LOW_BITS) + r["low"] for r in rows),
            tuple(r["least"] for r in rows),
            tuple(r["most"] for r in rows),
        )

    def fits_long(self) -> bool:
        """Whether no deviation, and nothing on the way to it, can leave the range of a long."""
        far = (
            max(abs(self.n * end - total) for end in ends)
            for total, *ends in zip(self.sums, self.low, self.high, strict=True)
        )
        reach = self.n * max(*map(abs, self.low), *map(abs, self.high))
        return sum(d * d for d in far) < 1 << 63 and reach < 1 << 62


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centred(x: np.ndarray, fit: Fit, sums: np.ndarray, narrow: bool) -> tuple[np.ndarray, list[int | None]]:
    """The centred rows and their deviations, from exact whole numbers."""
    far = fit.n * (x if narrow else x.astype(object)) - sums
    square = (far * far).sum(axis=1).tolist()
    # Dividing whole numbers rounds once, however large the mean is.
    return (far / fit.n).astype(np.float64), square if narrow else [int(s) if s < 1 << 63 else None for s in square]


def deviations(rows: DataFrame, fit: Fit) -> DataFrame:
    """``rows`` with ``deviation`` in place of ``x``."""
    narrow = fit.fits_long()
    sums = np.array(fit.sums, np.int64 if narrow else object)
    kept = [field for field in rows.schema if field.name != "x"]
    schema = T.StructType([*kept, T.StructField("deviation", T.LongType())])
    source = rows.select(*(field.name for field in kept), "x")

    def measure(batches):
        for batch in batches:
            _, square = _centred(_matrix(batch.column(len(kept)), len(sums)), fit, sums, narrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(square, pa.int64())], names=schema.names)

    return source.mapInArrow(measure, schema)


def blocks(rows: DataFrame, fit: Fit, block_rows: int | None = None) -> BlockMatrix:
    """The centred rows as a block matrix; ``number`` is a row's place in it, from 0 without gaps.

    A block is as wide as a row and leaves its task as one value.
    """
    size = block_rows or BLOCK_ROWS
    narrow, width = fit.fits_long(), len(fit.sums)
    sums = np.array(fit.sums, np.int64 if narrow else object)
    block = F.expr(f"number div {size}").cast("int").alias("block")
    dealt = rows.select(block, "number", "x").repartition("block").sortWithinPartitions("block", "number")

    def build(batches):
        at, parts = None, []

        def finished():
            moved, _ = _centred(np.concatenate(parts), fit, sums, narrow)
            columns = [pa.array([at], pa.int32()), pa.array([len(moved)], pa.int32()), pa.array([moved.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "size", "values"])

        for batch in batches:
            numbers, x = batch.column(0).to_numpy(), _matrix(batch.column(2), width)
            starts = first_of_runs(numbers)
            for a, b in zip(starts, [*starts[1:], len(numbers)], strict=True):
                if at is not None and numbers[a] != at:
                    yield finished()
                    parts = []
                at = int(numbers[a])
                parts.append(x[a:b])
        if parts:
            yield finished()

    def as_block(row):
        return (row["block"], 0), DenseMatrix(row["size"], width, np.frombuffer(row["values"]), isTransposed=True)

    built = dealt.mapInArrow(build, "block int, size int, values binary")
    return BlockMatrix(built.rdd.map(as_block), size, width)


def scatter(matrix: BlockMatrix, partitions: int) -> np.ndarray:
    """The transpose times the matrix, cut along the rows into ``partitions`` sums."""
    turned = matrix.transpose()
    # The Python method does not pass on the number of cuts, without which one task sums all blocks.
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, partitions)
    found = BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (found + found.T) / 2


@dataclass(frozen=True)
class Whitening:
    """Projection (width x components) and, for each component, the share of the variance and whether it has any."""

    matrix: np.ndarray
    explained: tuple[float, ...]
    live: tuple[bool, ...]

    @classmethod
    def of(cls, covariance: np.ndarray, components: int) -> "Whitening":
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        live = values > FLAT * max(values[0], 0.0)
        scaled = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
        total = float(np.trace(covariance))
        share = np.where(live, values, 0.0) / total if total > 0 else np.zeros(len(values))
        return cls(scaled, tuple(share.tolist()), tuple(live.tolist()))


def projected(spark: SparkSession, matrix: BlockMatrix, whitening: Whitening) -> BlockMatrix:
    """The rows times the whitening matrix, which is one block and goes to every block of rows."""
    width, components = whitening.matrix.shape
    local = Matrices.dense(width, components, whitening.matrix.ravel("F"))
    return matrix.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), width, components))


def rows_of(spark: SparkSession, matrix: BlockMatrix) -> DataFrame:
    """``number`` and ``values`` of every row."""
    size, width = matrix.rowsPerBlock, matrix.colsPerBlock

    def as_row(block):
        (at, _), values = block
        return at, values.toArray().tobytes()

    def cut(batches):
        for batch in batches:
            for at, held in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                values = pa.array(np.frombuffer(held))
                n = len(values) // width
                numbers = pa.array(np.arange(n, dtype=np.int64) + at * size)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), values)
                yield pa.RecordBatch.from_arrays([numbers, lists], names=["number", "values"])

    found = spark.createDataFrame(matrix.blocks.map(as_row), "block int, values binary")
    return found.mapInArrow(cut, "number long, values array<double>")


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row.

    One row per vector and component, from the component of the largest variance on.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    found = whole_numbers(vectors)
    rows = written(number_rows(found, "number"), "vectors")
    distinct = written(number_rows(rows.select("x").distinct(), "number"), "fit")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if distinct.isEmpty():
        return spark.createDataFrame(
            [],
            f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double",
        )
    fit = Fit.of(distinct)
    parts = max(distinct.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    # Read by both sides of a product and again; a lost executor's blocks are built anew.
    fitted = blocks(distinct, fit).persist(StorageLevel.MEMORY_AND_DISK)
    whitening = Whitening.of(scatter(fitted, parts) / fit.n, components)
    white = projected(spark, fitted, whitening).persist(StorageLevel.MEMORY_AND_DISK)
    covariance = scatter(white, parts) / fit.n
    for matrix in (white, fitted):
        matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
    error = float(np.abs(covariance - np.diag(np.array(whitening.live, float))).max())
    values = rows_of(spark, projected(spark, blocks(rows, fit), whitening))
    share = F.array(*map(F.lit, whitening.explained))
    return (
        deviations(rows, fit)
        .join(values, "number")
        .select("vec_id", "deviation", F.posexplode("values").alias("place", "whitened"))
        .select(
            "vec_id",
            (F.col("place") + 1).alias("component"),
            F.lit(fit.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(share, F.col("place")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
