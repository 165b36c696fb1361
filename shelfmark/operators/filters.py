"""The filter language: parameter names end in a suffix that says how to compare.

====================  =====================================================
``x_id_list``         related id is one of a comma list
``x_list``            related name is one of a comma list
``x_name``, ``x_id``  related name / id equals
``x_min``, ``x_max``  column is at least / at most
``x_ex``              ignored
``order...``          order of the result
any other name        column equals
====================  =====================================================
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.text import icontains
from shelfmark.schemas import RELATIONS

INTENDED, AS_WRITTEN = "intended", "as_written"

TO_ONE = {"anatomical_area": "anatomical_area_id"}


@dataclass(frozen=True)
class Condition:
    """``field op value``; ``attribute`` is set when ``field`` is a relation."""

    field: str
    op: str  # "eq", "ge", "le" or "in"
    value: object
    attribute: str | None = None


@dataclass(frozen=True)
class Parameters:
    conditions: list[Condition] = field(default_factory=list)
    ordering: Sequence[str] | None = None


# (suffix, operator, attribute of the relation), tried longest suffix first.
_SUFFIXES = sorted(
    [
        ("_id_list", "in", "id"),
        ("_list", "in", "name"),
        ("_name", "eq", "name"),
        ("_id", "eq", "id"),
        ("_min", "ge", None),
        ("_max", "le", None),
    ],
    key=lambda rule: -len(rule[0]),
)


def _condition(name: str, value: object) -> Condition:
    for suffix, op, attribute in _SUFFIXES:
        if name.endswith(suffix) and len(name) > len(suffix):
            if op == "in":
                value = value.split(",") if isinstance(value, str) else list(value)
            return Condition(name[: -len(suffix)], op, value, attribute)
    return Condition(name, "eq", value)


def parse_parameters(params: Mapping[str, object], semantics: str = INTENDED) -> Parameters:
    """Conditions and order asked for by ``params``, in the order they are given.

    Empty values (``None``, ``""``, empty lists) ask for nothing. With
    ``"as_written"`` a bound of zero counts as empty too, and once a list has
    been seen every later condition that is not a list is left out.
    """
    if semantics not in (INTENDED, AS_WRITTEN):
        raise ValueError(f"unknown semantics {semantics!r}")
    conditions: list[Condition] = []
    ordering = None
    for name, value in params.items():
        empty = value is None or (isinstance(value, (str, list, tuple)) and len(value) == 0)
        if empty or name.endswith("_ex"):
            continue
        if semantics == AS_WRITTEN and not value:
            continue
        if name.startswith("order"):
            ordering = value
            continue
        condition = _condition(name, value)
        if semantics == AS_WRITTEN and condition.op != "in":
            if any(earlier.op == "in" for earlier in conditions):
                continue
        conditions.append(condition)
    return Parameters(conditions, ordering)


def text_match(query: str | Column) -> Column:
    """Title or description contains the text; a title hit survives a null description."""
    needle = F.lit(query) if isinstance(query, str) else query
    return icontains(F.col("title"), needle) | icontains(F.col("description"), needle)


def compared(column: Column, condition: Condition) -> Column:
    value = condition.value
    if condition.op == "in":
        items = [int(item) for item in value if str(item).strip()] if condition.attribute == "id" else value
        return column.isin(items)
    if condition.op == "ge":
        return column >= F.lit(value)
    if condition.op == "le":
        return column <= F.lit(value)
    return column == F.lit(value)


def _column_of(condition: Condition, columns: Sequence[str]) -> str | None:
    """The dataset's own column a condition can be tested on, if there is one."""
    if condition.attribute is None:
        name = TO_ONE.get(condition.field, condition.field)
    elif condition.attribute == "id":
        name = TO_ONE.get(condition.field)
    else:
        name = None
    return name if name in columns else None


def linked_ids(catalog: Catalog, condition: Condition) -> DataFrame:
    """``dataset_id`` of every link whose far side meets a condition on a relation."""
    relation = RELATIONS[condition.field]
    bridge = catalog.table(relation.bridge)
    if condition.attribute == "id":
        hits = bridge.where(compared(F.col(relation.key), condition))
    else:
        wanted = catalog.table(relation.target).where(compared(F.col("name"), condition))
        hits = bridge.join(
            wanted.select(F.col("id").alias(relation.key)), relation.key, "left_semi"
        )
    return hits.select(F.col("dataset_id").alias("id"))


def apply_conditions(
    datasets: DataFrame, catalog: Catalog, conditions: Sequence[Condition], copies: bool = False
) -> DataFrame:
    """Rows of ``datasets`` that meet every condition.

    Conditions on own columns come first, where they reach the scan. A relation
    is a semi-join, so a dataset appears once however many links match; with
    ``copies`` it is an inner join and appears once per combination of matches.
    """
    related = []
    for condition in conditions:
        name = _column_of(condition, datasets.columns)
        if name is not None:
            datasets = datasets.where(compared(F.col(name), condition))
        elif condition.attribute and condition.field in (*RELATIONS, *TO_ONE):
            related.append(condition)
        else:
            raise ValueError(f"no such field: {condition.field!r}")
    for condition in related:
        if condition.field in TO_ONE:
            key = TO_ONE[condition.field]
            targets = catalog.table(condition.field).where(compared(F.col("name"), condition))
            datasets = datasets.join(targets.select(F.col("id").alias(key)), key, "left_semi")
        else:
            hits = linked_ids(catalog, condition)
            datasets = datasets.join(hits, "id", "inner" if copies else "left_semi")
    return datasets
