"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.sizing import sent_if_small, settled

SLOTS = 32
SLOT_ROWS = 100_000


def spread_join(
    large: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    spread: str | Sequence[str],
    how: str = "inner",
    slots: int = SLOTS,
    counts: DataFrame | None = None,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Join on ``on`` with the keys of ``large`` cut into pieces.

    A row's piece follows from a hash of its ``spread`` columns, so a recomputed
    task puts it in the same place; ``small`` is repeated once per piece. Each
    row of ``large`` meets each partner exactly once, so ``inner``, ``left``,
    ``left_semi`` and ``left_anti`` give the rows of the plain join.

    With ``counts`` (the key columns and ``n``, its rows in ``large``) only keys
    of more than ``slot_rows`` rows are cut, into pieces of that size, and rows
    of other keys are not repeated. Without, every key has ``slots`` pieces.
    """
    on = [on] if isinstance(on, str) else list(on)
    spread = [spread] if isinstance(spread, str) else list(spread)
    if counts is None:
        pieces = F.lit(slots)
    else:
        hot = counts.where(F.col("n") > slot_rows)
        hot = sent_if_small(settled(hot.select(*on, F.ceil(F.col("n") / slot_rows).alias("_pieces"))))
        large, small = large.join(hot, on, "left"), small.join(hot, on, "left")
        pieces = F.coalesce("_pieces", F.lit(1))
    cut = large.withColumn("_slot", F.pmod(F.xxhash64(*spread), pieces).cast("int"))
    repeated = small.withColumn("_slot", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))))
    return cut.drop("_pieces").join(repeated.drop("_pieces"), [*on, "_slot"], how).drop("_slot")
