"""Order given by a caller, as sort columns with a stated place for nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order used when a request names none.
DEFAULT_ORDERING = ("created_at", "desc")


def order_columns(
    ordering: str | Sequence[str], columns: Sequence[str], tie_break: str = "id"
) -> list[Column]:
    """Sort columns for ``[column]``, ``[column, direction]`` or ``"-column"``.

    Only ``desc`` descends. Nulls count as the largest value, so they come last
    going up and first going down. Equal rows are told apart by ``tie_break``,
    which also lets a range partitioner cut through a run of equal values.
    """
    parts = [ordering] if isinstance(ordering, str) else list(ordering)
    if not 1 <= len(parts) <= 2:
        raise ValueError("ordering takes a column and, if wanted, a direction")
    name = parts[0]
    descending = len(parts) == 2 and parts[1] == "desc"
    if name.startswith("-"):
        name, descending = name[1:], not descending
    if name not in columns:
        raise ValueError(f"cannot order by unknown column {name!r}")
    first = F.desc_nulls_first(name) if descending else F.asc_nulls_last(name)
    return [first] if name == tie_break else [first, F.col(tie_break)]
