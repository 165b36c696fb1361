"""Which filter options exist, and how many datasets each would leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.sizing import sent_if_small, settled
from shelfmark.functions.tables import stacked
from shelfmark.schemas import RELATIONS

_SCHEMA = ("facet", "option", "n_datasets", "low", "high")


def options(facet: str, names: DataFrame, counts: DataFrame) -> DataFrame:
    """Every name of a lookup table with its count, 0 where nothing uses it."""
    return names.join(counts, "id", "left").select(
        F.lit(facet).alias("facet"),
        F.col("name").alias("option"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_datasets"),
        F.lit(None).cast("int").alias("low"),
        F.lit(None).cast("int").alias("high"),
    )


def value_range(datasets: DataFrame, name: str) -> DataFrame:
    """The facet of a number: how many datasets have it, and its range."""
    return datasets.agg(
        F.lit(name).alias("facet"),
        F.lit(None).cast("string").alias("option"),
        F.count(name).alias("n_datasets"),
        F.min(name).alias("low"),
        F.max(name).alias("high"),
    )


def facets(
    catalog: Catalog, ids: DataFrame | None = None, pairs_unique: bool = False
) -> DataFrame:
    """``(facet, option, n_datasets, low, high)`` over the catalog, or over ``ids`` only.

    Name facets count datasets per option; ``record_count`` and ``size`` give
    their range and how many datasets have a value. Counts are taken per key
    before names are joined, so map-side aggregation reduces each task to one
    row per option however hot an option is. A dataset counts once
    per option however often it is linked; ``pairs_unique=True`` spares the
    shuffle of the links where their pairs are known to be unique.
    """
    datasets = catalog.dataset
    if ids is not None:
        ids = sent_if_small(settled(ids.select("id")))
        datasets = datasets.join(ids, "id", "left_semi")
    per_area = datasets.groupBy("anatomical_area_id").agg(
        F.count("*").alias("n"),
        *(
            measure(name).alias(f"{label}_{name}")
            for name in ("record_count", "size")
            for label, measure in (("n", F.count), ("low", F.min), ("high", F.max))
        ),
    )
    parts = [
        options(
            "anatomical_area",
            catalog.anatomical_area,
            per_area.select(F.col("anatomical_area_id").alias("id"), "n"),
        )
    ]
    for field, relation in RELATIONS.items():
        bridge = catalog.table(relation.bridge)
        if ids is not None:
            bridge = bridge.join(ids, bridge["dataset_id"] == ids["id"], "left_semi")
        used = F.count("*") if pairs_unique else F.count_distinct("dataset_id")
        counts = bridge.groupBy(F.col(relation.key).alias("id")).agg(used.alias("n"))
        parts.append(options(field, catalog.table(relation.target), counts))
    ranges = per_area.agg(
        *(
            F.struct(
                F.lit(name).alias("facet"),
                F.lit(None).cast("string").alias("option"),
                F.coalesce(F.sum(f"n_{name}"), F.lit(0)).cast("bigint").alias("n_datasets"),
                F.min(f"low_{name}").alias("low"),
                F.max(f"high_{name}").alias("high"),
            ).alias(name)
            for name in ("record_count", "size")
        )
    ).select(F.inline(F.array("record_count", "size")))
    parts.append(ranges.select(*_SCHEMA))
    return stacked(parts)
