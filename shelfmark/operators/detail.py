"""The denormalised detail view: a dataset with its area and three nested lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.sizing import is_small, sent_if_small, settled
from shelfmark.functions.tables import stacked
from shelfmark.functions.times import iso_utc
from shelfmark.schemas import RELATIONS, ManyToMany

# Columns of the detail view, in order.
DETAIL_COLUMNS = (
    "id",
    "title",
    "description",
    "external_path",
    "local_path",
    "record_count",
    "size",
    "anatomical_area",
    "anatomical_area_name",
    "modalities",
    "ml_tasks",
    "tags",
    "created_at",
    "updated_at",
)

# Datasets of one task; their lists are what its memory holds.
PART_ROWS = 5_000

_NO_ITEMS = "array<struct<id:bigint,name:string>>"


def _items(catalog: Catalog, relation: ManyToMany, only: DataFrame | None, parts: int | None = None) -> DataFrame:
    """``(dataset_id, items)``: the named far side of a relation, sorted by id.

    The links keep any bucketing on ``dataset_id`` up to the aggregation, which
    then needs no shuffle; the lookup table joins by whatever its size allows.
    """
    bridge = catalog.table(relation.bridge)
    names = catalog.table(relation.target).select(F.col("id").alias(relation.key), "name")
    if parts is None:
        if only is not None:
            bridge = bridge.join(only, "dataset_id", "left_semi")
        named = bridge.join(names, relation.key)
    elif is_small(names):
        named = bridge.repartition(parts, "dataset_id").join(only, "dataset_id", "left_semi").join(F.broadcast(names), relation.key)
    else:  # names come first, as a join by shuffle would deal the links anew
        named = bridge.join(names, relation.key).repartition(parts, "dataset_id").join(only, "dataset_id", "left_semi")
    item = F.struct(F.col(relation.key).alias("id"), F.col("name").alias("name"))
    return (
        named.groupBy("dataset_id")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )


def detail_view(catalog: Catalog, datasets: DataFrame | None = None) -> DataFrame:
    """One row per dataset with ``{id, name}`` lists; no items is ``[]``, not null.

    Each relation is aggregated before it is joined, so the three fan-outs never
    multiply. Given ``datasets`` (a search result, say), they are computed once,
    and links of other datasets are dropped: in the scan if the ids are few
    enough to send there, else where the links are shuffled to be grouped.
    """
    rows, only, parts = catalog.dataset, None, None
    if datasets is not None:
        rows = settled(datasets)
        only = rows.select(F.col("id").alias("dataset_id"))
        parts = _parts(rows)
        # Dealt once, by as many tasks as the datasets need; the joins below then move nothing.
        rows, only = (rows.repartition(parts, "id"), only.repartition(parts, "dataset_id")) if parts else (rows, sent_if_small(only))
    return _with_details(catalog, rows, only, parts)


def _parts(rows: DataFrame) -> int | None:
    """Into how many parts to deal datasets and links, so that a task has at most ``PART_ROWS`` datasets; none if the usual number does."""
    parts = -(-rows.count() // PART_ROWS)
    return parts if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _with_details(catalog: Catalog, rows: DataFrame, only: DataFrame | None, parts: int | None) -> DataFrame:
    areas = catalog.anatomical_area.select(
        F.col("id").alias("anatomical_area"), F.col("name").alias("anatomical_area_name")
    )
    detail = rows.withColumnRenamed("anatomical_area_id", "anatomical_area").join(
        areas, "anatomical_area", "left"
    )
    for field, relation in RELATIONS.items():
        items = _items(catalog, relation, only, parts).select(
            F.col("dataset_id").alias("id"), F.col("items").alias(field)
        )
        detail = detail.join(items, "id", "left").withColumn(
            field, F.coalesce(F.col(field), F.array().cast(_NO_ITEMS))
        )
    return detail.select(*DETAIL_COLUMNS)


def detail_by_ids(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """The detail view of the datasets whose ``id`` is in ``ids``."""
    return detail_view(catalog, catalog.dataset.join(ids.select("id"), "id", "left_semi"))


def detail_of(catalog: Catalog, dataset_id: int) -> DataFrame:
    """The detail view of one dataset; the id reaches every scan as a pushed filter."""
    tables = {"dataset": catalog.dataset.where(F.col("id") == dataset_id)}
    for relation in RELATIONS.values():
        bridge = catalog.table(relation.bridge)
        tables[relation.bridge] = bridge.where(F.col("dataset_id") == dataset_id)
    return detail_view(catalog.replace(**tables))


def lookup_rows(catalog: Catalog, table: str) -> DataFrame:
    """All fields of a lookup table."""
    return catalog.table(table).select("id", "name")


def display_names(catalog: Catalog) -> DataFrame:
    """``(table_name, id, label)``: what each catalog row is shown as."""
    shown = {"anatomical_area": "name", "modality": "name", "ml_task": "name", "tag": "name", "dataset": "title"}
    return stacked(
        [
            catalog.table(table).select(F.lit(table).alias("table_name"), "id", F.col(column).alias("label"))
            for table, column in shown.items()
        ]
    )


def labels(items: Column) -> Column:
    """A nested list as one string, ``1:CT,4:MRI``."""
    return F.concat_ws(
        ",", F.transform(items, lambda item: F.concat(item["id"].cast("string"), F.lit(":"), item["name"]))
    )


def json_rows(detail: DataFrame) -> DataFrame:
    """``(id, json)``: each row as a response prints it, nulls kept."""
    times = {name: iso_utc(F.col(name)) for name in ("created_at", "updated_at")}
    shaped = detail.withColumns({name: text for name, text in times.items() if name in detail.columns})
    row = F.struct(*(F.col(name) for name in detail.columns))
    return shaped.select("id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))
