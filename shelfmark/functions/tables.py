"""Putting tables of one shape together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; halving the list keeps the plan shallow."""
    if len(parts) == 1:
        return parts[0]
    middle = len(parts) // 2
    return stacked(parts[:middle]).unionByName(stacked(parts[middle:]))
