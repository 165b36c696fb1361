"""Filter options of a search in progress, counted from stored bitmaps.

For every option of a filter the index holds the ids of its datasets, as one
bitmap per 32,768 ids, or as a list where there are few. A search reads the
dataset table once, for its text, and never the links: list filters are bits to
look up, and counts are bits in common between an option and the hits.

Each facet is counted without its own filter, as somebody who chose one option
wants to know what the others would give instead.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.bits import bit_words, is_set, is_set_in
from shelfmark.functions.sizing import sent_if_small, settled
from shelfmark.functions.tables import stacked
from shelfmark.operators.facets import options, value_range
from shelfmark.operators.filters import Condition, compared, parse_parameters, text_match
from shelfmark.operators.requests import checked_request
from shelfmark.schemas import RELATIONS
from shelfmark.sources.folders import kept
from shelfmark.sources.store import Version

OPTIONS = "facet_options"
FEW = 1024  # ids of a bucket that take as much room as a bitmap
AREA = "anatomical_area"
RANGES = ("record_count", "size")
_TARGETS = {AREA: AREA, **{field: relation.target for field, relation in RELATIONS.items()}}


def _links(catalog: Catalog) -> DataFrame:
    """``facet``, ``option`` and ``id`` of every dataset with the option."""
    parts = [catalog.dataset.select(F.lit(AREA).alias("facet"), F.col("anatomical_area_id").alias("option"), "id")]
    for field, relation in RELATIONS.items():
        bridge = catalog.table(relation.bridge)
        parts.append(bridge.select(F.lit(field).alias("facet"), F.col(relation.key).alias("option"), F.col("dataset_id").alias("id")))
    return stacked(parts).where("option IS NOT NULL AND id IS NOT NULL")


def _cells(links: DataFrame, few: int) -> DataFrame:
    at = F.bitmap_bit_position("id").cast("int")
    # A group has at most one position per id of a bucket, however hot the option is.
    cell = ["facet", "bucket", "option"]
    grouped = links.groupBy("facet", F.bitmap_bucket_number("id").alias("bucket"), "option").agg(F.collect_set(at).alias("positions"))
    is_sparse = F.size("positions") <= few
    sparse = grouped.where(is_sparse).select(*cell, F.lit(None).cast("binary").alias("bitmap"), F.sort_array("positions").alias("positions"))
    # Bitmaps are made where a cell's positions have met: every task would send one of full size otherwise.
    each = grouped.where(~is_sparse).select(*cell, F.explode(F.col("positions").cast("array<long>")).alias("at"))
    dense = each.groupBy(*cell).agg(F.bitmap_construct_agg("at").alias("bitmap"))
    return sparse.unionByName(dense.withColumn("positions", F.lit(None).cast("array<int>")))


def with_facets(version: Version, catalog: Catalog, files: int | None = None, few: int = FEW) -> Version:
    """The store with the options of all datasets of ``catalog``."""
    return version.with_table(OPTIONS, _cells(_links(catalog), few), ["facet", "bucket", "option"], files)


def with_changed(version: Version, catalog: Catalog, ids: DataFrame, few: int = FEW) -> Version:
    """The store after datasets or links of ``ids`` (``id``) changed: only buckets that hold one are built anew."""
    changed = settled(ids.select(F.bitmap_bucket_number("id").alias("bucket")).distinct())
    links = _links(catalog).withColumn("bucket", F.bitmap_bucket_number("id")).join(sent_if_small(changed), "bucket", "left_semi")
    old = version.rows(OPTIONS, version.files(OPTIONS), marked=True).join(sent_if_small(changed), "bucket", "left_semi")
    return version.without(OPTIONS, settled(old.select("_file", "_row"))).with_rows(OPTIONS, _cells(links, few))


def _filter_bits(version: Version, catalog: Catalog, condition: Condition, name: str) -> DataFrame:
    """``bucket`` and, as ``name``, the bitmap of the datasets with any of the options a condition names."""
    if condition.attribute == "id":
        wanted = compared(F.col("option"), condition)
        cells = version.read(OPTIONS).where((F.col("facet") == condition.field) & wanted)
    else:
        targets = catalog.table(_TARGETS[condition.field])
        chosen = targets.where(compared(F.col("name"), condition)).select(F.col("id").alias("option"))
        cells = version.read(OPTIONS).where(F.col("facet") == condition.field).join(chosen, "option", "left_semi")
    listed = cells.where("bitmap IS NULL").select("bucket", F.explode(F.col("positions").cast("array<long>")).alias("at"))
    sparse = listed.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    dense = cells.where("bitmap IS NOT NULL").select("bucket", "bitmap")
    return sparse.unionByName(dense).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias(name))


def _hits(version: Version, catalog: Catalog, query: str, conditions: list[Condition]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Datasets whose text matches, with a column per condition saying whether it is met; those columns by facet."""
    found = catalog.dataset.where(text_match(query)).withColumns(
        {"bucket": F.bitmap_bucket_number("id"), "at": F.bitmap_bit_position("id")}
    )
    met: dict[str, list[str]] = {}
    for number, condition in enumerate(conditions):
        name = f"met_{number}"
        if condition.field in _TARGETS and condition.attribute:
            found = found.join(sent_if_small(_filter_bits(version, catalog, condition, "bits")), "bucket", "left")
            test = is_set(F.col("bits"), F.col("at"))
        elif condition.field in catalog.dataset.columns and condition.attribute is None:
            test = F.coalesce(compared(F.col(condition.field), condition), F.lit(False))
        else:
            raise ValueError(f"no such field: {condition.field!r}")
        found = found.withColumn(name, test).drop("bits")
        met.setdefault(condition.field, []).append(name)
    columns = [name for names in met.values() for name in names]
    return kept(found.select("id", "bucket", "at", *RANGES, *columns), "hits"), met


def facets_in_progress(version: Version, catalog: Catalog, query: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """:func:`~shelfmark.operators.facets.facets` of a search, each facet without its own filters."""
    query, params = checked_request(query, params)
    hits, met = _hits(version, catalog, query, parse_parameters(params).conditions)

    def others(facet: str) -> Column:
        wanted = [F.col(name) for field, names in met.items() if field != facet for name in names]
        return reduce(Column.__and__, wanted, F.lit(True))

    bits = hits.groupBy("bucket").agg(
        *(F.bitmap_construct_agg(F.when(others(facet), F.col("at"))).alias(f"hits_{facet}") for facet in _TARGETS)
    )
    bits = bits.select("*", *(bit_words(F.col(f"hits_{facet}")).alias(f"words_{facet}") for facet in _TARGETS))
    bits = sent_if_small(kept(bits, "bits"))
    def own(kind: str) -> Column:
        return F.coalesce(*(F.when(F.col("facet") == facet, F.col(f"{kind}_{facet}")) for facet in _TARGETS))

    cells = version.read(OPTIONS).join(bits, "bucket").select(
        "facet", "option", "bucket", "bitmap", "positions", own("hits").alias("hits"), own("words").alias("words")
    )
    dense = (
        cells.where("bitmap IS NOT NULL")
        .select("facet", "option", "bucket", F.explode(F.array("bitmap", "hits")).alias("bitmap"))
        .groupBy("facet", "option", "bucket")
        .agg(F.bitmap_count(F.bitmap_and_agg("bitmap")).alias("n"))
    )
    common = F.size(F.filter("positions", lambda at: is_set_in(F.col("words"), at))).cast("bigint")
    sparse = cells.where("bitmap IS NULL").select("facet", "option", common.alias("n")).where("n > 0")
    counts = dense.select("facet", "option", "n").unionByName(sparse).groupBy("facet", "option").agg(F.sum("n").alias("n"))
    counts = settled(counts)  # one row per option
    parts = [
        options(facet, catalog.table(target), counts.where(F.col("facet") == facet).select(F.col("option").alias("id"), "n"))
        for facet, target in _TARGETS.items()
    ]
    parts += [value_range(hits.where(others(name)), name) for name in RANGES]
    return stacked(parts)
