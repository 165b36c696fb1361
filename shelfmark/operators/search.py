"""One keyword search over the catalog, its count, and its shortcuts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.ordering import DEFAULT_ORDERING, order_columns
from shelfmark.functions.sizing import settled
from shelfmark.operators.detail import detail_view
from shelfmark.operators.filters import (
    AS_WRITTEN,
    INTENDED,
    apply_conditions,
    parse_parameters,
    text_match,
)
from shelfmark.operators.requests import checked_request
from shelfmark.schemas import DATASET


def find(
    catalog: Catalog,
    query: str,
    params: Mapping[str, object] | None = None,
    semantics: str = INTENDED,
) -> DataFrame:
    """Datasets whose text contains ``query`` and that meet ``params``, in no order.

    ``"as_written"`` keeps the historic answers: one copy of a dataset per
    combination of matching links, and the parameter quirks described in
    :func:`~shelfmark.operators.filters.parse_parameters`. Either way texts are
    trimmed and a request that breaks a rule is refused, as in a batch; see
    :func:`~shelfmark.operators.requests.checked_request`.
    """
    query, params = checked_request(query, params)
    conditions = parse_parameters(params, semantics).conditions
    matched = catalog.dataset.where(text_match(query))
    found = apply_conditions(matched, catalog, conditions, copies=semantics == AS_WRITTEN)
    return found.select(*catalog.dataset.columns)


def _ordered(rows: DataFrame, params: Mapping[str, object] | None) -> DataFrame:
    ordering = parse_parameters(params or {}).ordering or DEFAULT_ORDERING
    name, *direction = [ordering] if isinstance(ordering, str) else ordering
    # The area's key is called differently before and after details are added.
    for here, there in (("anatomical_area", "anatomical_area_id"), ("anatomical_area_id", "anatomical_area")):
        if name == here and here not in rows.columns:
            name = there
    return rows.orderBy(*order_columns([name, *direction], rows.columns))


def search(
    catalog: Catalog,
    query: str,
    params: Mapping[str, object] | None = None,
    semantics: str = INTENDED,
) -> DataFrame:
    """:func:`find`, ordered as ``params["ordering"]`` says, newest first by default.

    A result nobody reads in order (a join input, a count) should come from
    :func:`find`, which spares the range shuffle of the sort, and one of which
    only a page is read from :func:`~shelfmark.operators.paging.page` over
    ``find``. The hits are computed once and kept, because a sort reads its
    input twice: to find the ranges, and to sort. ``"as_written"`` never applied
    the order.
    """
    found = find(catalog, query, params, semantics)
    if semantics == AS_WRITTEN:
        return found
    return _ordered(settled(found), params)


def search_details(
    catalog: Catalog,
    query: str,
    params: Mapping[str, object] | None = None,
    semantics: str = INTENDED,
) -> DataFrame:
    """What a search responds with: the detail view of its hits, in its order."""
    details = detail_view(catalog, find(catalog, query, params, semantics))
    if semantics == AS_WRITTEN:
        return details
    return _ordered(details, params)


def search_count(
    catalog: Catalog,
    query: str,
    params: Mapping[str, object] | None = None,
    semantics: str = INTENDED,
) -> DataFrame:
    """One row: how many datasets a search returns (copies included as written)."""
    return find(catalog, query, params, semantics).agg(F.count("*").alias("count"))


def newest(catalog: Catalog, n: int = 5, ascending: bool = False) -> DataFrame:
    """The ``n`` datasets created last, or first with ``ascending``."""
    ordering = ("created_at", "asc" if ascending else "desc")
    return catalog.dataset.orderBy(*order_columns(ordering, DATASET.names)).limit(n)
