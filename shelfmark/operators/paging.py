"""Page-number paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.ordering import DEFAULT_ORDERING, order_columns
from shelfmark.functions.sizing import SMALL_ROWS, settled
from shelfmark.operators.numbering import number_rows

# Rows on a page.
PAGE_SIZE = 20

DIRECT_ROWS = 10_000


def page(
    df: DataFrame,
    number: int,
    ordering: str | Sequence[str] = DEFAULT_ORDERING,
    size: int = PAGE_SIZE,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Page ``number`` (from 1) of ``df`` in the given order.

    Near the front each task keeps its best rows and the driver merges them
    (``TakeOrderedAndProject``). That merge grows with the page number, so past
    ``direct_rows`` the order columns alone are sorted across the cluster and
    numbered, and the page's ids are looked up.
    """
    if number < 1 or size < 1:
        raise ValueError("pages are numbered from 1 and hold at least one row")
    order = order_columns(ordering, df.columns)
    first = (number - 1) * size
    if first + size <= direct_rows:
        return df.orderBy(*order).offset(first).limit(size)
    name = ordering if isinstance(ordering, str) else ordering[0]
    # Kept before sorting: a sort reads its input twice, to find the ranges first.
    keys = settled(df.select(*dict.fromkeys(["id", name.lstrip("-")]))).orderBy(*order)
    place = number_rows(keys).where(F.col("position").between(first, first + size - 1)).select("id")
    if size <= SMALL_ROWS:
        place = F.broadcast(place)
    return df.join(place, "id", "left_semi").orderBy(*order)
