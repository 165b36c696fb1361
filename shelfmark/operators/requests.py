"""Search requests kept as a table: reading, checking and normalising them."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import WHITESPACE, parse_int, strip

TEXT_FIELDS = ("anatomical_area_name", "modalities_list", "ml_tasks_list", "tags_list")
NUMBER_FIELDS = ("record_count_min", "record_count_max", "size_min", "size_max")
FIELDS = TEXT_FIELDS + NUMBER_FIELDS

# Limits a request must keep.
QUERY_LENGTH = (2, 100)
AREA_NAME_LENGTH = 2
ORDERING_ITEMS = 2


class InvalidRequest(ValueError):
    """A search that is refused; ``fields`` names what breaks a rule."""

    def __init__(self, fields: list[str]):
        super().__init__(f"invalid search: {', '.join(fields)}")
        self.fields = fields


def checked_request(query: str, params: Mapping[str, object] | None = None) -> tuple[str, dict[str, object]]:
    """One search in normal form, by the rules :func:`valid_requests` has for a table of them.

    Raises :class:`InvalidRequest` where that function leaves a request out.
    """
    params, broken = dict(params or {}), []
    query = query.strip(WHITESPACE) if isinstance(query, str) else ""
    if not QUERY_LENGTH[0] <= len(query) <= QUERY_LENGTH[1] or "\x00" in query:
        broken.append("query")
    for name in TEXT_FIELDS:
        if isinstance(params.get(name), str):
            value = params[name].strip(WHITESPACE)
            if "\x00" in value or (name == "anatomical_area_name" and 0 < len(value) < AREA_NAME_LENGTH):
                broken.append(name)
            params[name] = value or None
    for name in NUMBER_FIELDS:
        if isinstance(params.get(name), str):
            value = params[name].strip(WHITESPACE)
            whole = re.fullmatch(r"([+-]?[0-9]+)(\.0*)?", value, re.ASCII)
            number = int(whole[1]) if whole else None
            if value and (number is None or not -(2**63) <= number < 2**63):
                broken.append(name)
            params[name] = number
    ordering = params.get("ordering")
    if ordering and not isinstance(ordering, str) and len(ordering) > ORDERING_ITEMS:
        broken.append("ordering")
    if broken:
        raise InvalidRequest(broken)
    return query, params


def _listed(text: Column) -> Column:
    """The items of a JSON list, or null where the text is none."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>"))


def read_filters(log: DataFrame, column: str = "filters") -> DataFrame:
    """A search log with each saved filter in a column of its own, as text.

    Lists may be saved as comma lists or as JSON lists, and an order as a JSON
    list or as the name of a column.
    """
    names = ", ".join(f"{name} STRING" for name in (*FIELDS, "ordering"))
    parsed = log.withColumn("_saved", F.from_json(column, names))
    found = {name: F.col("_saved")[name] for name in (*FIELDS, "ordering")}
    for name in TEXT_FIELDS:
        if name.endswith("_list"):
            found[name] = F.coalesce(F.array_join(_listed(found[name]), ","), found[name])
    order = found["ordering"]
    found["ordering"] = F.coalesce(_listed(order), F.when(order.isNotNull(), F.array(order)))
    return parsed.select(*log.columns, *(value.alias(name) for name, value in found.items()))


def _is_whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def _broken_rules(requests: DataFrame) -> dict[str, Column]:
    """Per field, whether it breaks its rule (null: it does not)."""
    query = strip(F.col("query"))
    bad_query = ~F.length(query).between(*QUERY_LENGTH) | F.contains(query, F.lit("\x00"))
    rules = {"query": F.col("query").isNull() | bad_query}
    for name in TEXT_FIELDS:
        if name in requests.columns:
            bad = F.contains(F.col(name), F.lit("\x00"))
            if name == "anatomical_area_name":
                bad = bad | F.length(strip(F.col(name))).between(1, AREA_NAME_LENGTH - 1)
            rules[name] = bad
    for name in NUMBER_FIELDS:
        if name in requests.columns and not _is_whole(requests, name):
            text = F.col(name).cast("string")
            rules[name] = (strip(text) != "") & parse_int(text).isNull()
    if "ordering" in requests.columns:
        rules["ordering"] = F.size("ordering") > ORDERING_ITEMS
    return rules


def check_requests(requests: DataFrame) -> DataFrame:
    """``requests`` with ``errors``, the names of the fields that break a rule.

    Strings are trimmed first. The query must have 2 to 100 characters, an area
    name at least 2 (blank asks for nothing), bounds must be whole numbers, and
    an order has at most two items. Fields the table lacks are not checked.
    """
    named = [F.when(broken, F.lit(name)) for name, broken in _broken_rules(requests).items()]
    return requests.withColumn("errors", F.array_compact(F.array(*named)))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests without errors, in normal form.

    The query and texts are trimmed, blanks are null, bounds are whole numbers,
    and a field the table lacks is null, so equal requests have equal rows.
    """
    kept = requests
    for broken in _broken_rules(requests).values():
        kept = kept.where(~F.coalesce(broken, F.lit(False)))
    normal = {"query": strip(F.col("query"))}
    for name in TEXT_FIELDS:
        given = name in requests.columns
        normal[name] = F.nullif(strip(F.col(name)), F.lit("")) if given else F.lit(None).cast("string")
    for name in NUMBER_FIELDS:
        if name not in requests.columns:
            normal[name] = F.lit(None).cast("bigint")
        elif _is_whole(requests, name):
            normal[name] = F.col(name).cast("bigint")
        else:
            normal[name] = parse_int(F.col(name).cast("string"))
    return kept.withColumns(normal)


def rejected_requests(requests: DataFrame) -> DataFrame:
    """Requests with at least one error, and which."""
    return check_requests(requests).where(F.size("errors") > 0)
