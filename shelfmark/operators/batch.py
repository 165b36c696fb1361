"""Many saved searches at once.

A nested loop over requests and datasets would cost their product. A legal query
has at least two characters, so a text containing it contains every gram (run of
two to four characters) of it as well. Each query is therefore filed under one
of its grams, found by an equality join, and verified with ``contains``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.ordering import DEFAULT_ORDERING
from shelfmark.functions.sizing import SMALL_BYTES, SMALL_ROWS, is_small, sent_if_small, settled
from shelfmark.functions.skew import SLOTS, spread_join
from shelfmark.functions.text import grams, split_list
from shelfmark.operators.numbering import number_rows
from shelfmark.operators.requests import FIELDS, valid_requests
from shelfmark.schemas import RELATIONS
from shelfmark.sources.folders import kept

GRAM_LENGTHS = (2, 3, 4)

_MATCHED = ("id", "record_count", "size", "anatomical_area_id")


def with_search_key(requests: DataFrame) -> DataFrame:
    """Valid requests with ``pattern`` (the query in upper case) and ``search_key``.

    Requests that ask for the same thing share a key, so each distinct search is
    evaluated once however often it was made.
    """
    normal = valid_requests(requests).withColumn("pattern", F.upper("query"))
    asked = F.to_json(F.struct("pattern", *FIELDS), {"ignoreNullFields": "false"})
    return normal.withColumn("search_key", F.sha2(asked, 256))


def distinct_searches(requests: DataFrame) -> DataFrame:
    """One row per distinct search; repeats are merged before the shuffle."""
    return with_search_key(requests).select("search_key", "pattern", *FIELDS).distinct()


@dataclass(frozen=True)
class _Load:
    """What one look at the distinct searches tells about the join to choose."""

    small: bool
    gram_lengths: tuple[int, ...]
    fields: frozenset[str]

    @classmethod
    def of(cls, searches: DataFrame, rows: int, size: int) -> "_Load":
        text_bytes = sum(
            (F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) for name in searches.columns),
            F.lit(0),
        )
        found = searches.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(text_bytes.cast("bigint")), F.lit(0)).alias("size"),
            F.collect_set(_gram_length(F.col("pattern"))).alias("lengths"),
            *(F.count(name).alias(name) for name in FIELDS),
        ).first()
        return cls(
            small=found["n"] <= rows and found["size"] <= size,
            gram_lengths=tuple(sorted(found["lengths"])),
            fields=frozenset(name for name in FIELDS if found[name]),
        )


def _gram_length(pattern: Column) -> Column:
    return F.least(F.length(pattern), F.lit(GRAM_LENGTHS[-1]))


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """``(pattern, gram)``: the grams a query may be filed under, all of one length."""
    choices = F.coalesce(
        *(
            F.when(_gram_length(F.col("pattern")) == n, grams(F.col("pattern"), n))
            for n in GRAM_LENGTHS
        )
    )
    return patterns.select("pattern", F.explode(F.array_distinct(choices)).alias("gram"))


def filed_by_rarest(choices: DataFrame, frequency: DataFrame) -> DataFrame:
    """``(pattern, gram)`` with the gram that ``frequency`` counts least."""
    rank = F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))
    return (
        choices.join(frequency, "gram", "left")
        .groupBy("pattern")
        .agg(F.min(rank)["gram"].alias("gram"))
    )


def text_grams(lengths: tuple[int, ...]) -> Column:
    """Distinct grams of title and description; none spans the gap between them."""
    found = [
        F.coalesce(grams(F.col(text), n), F.array().cast("array<string>"))
        for text in ("_title", "_description")
        for n in lengths
    ]
    return F.array_distinct(F.concat(*found))


def upper_texts(datasets: DataFrame) -> DataFrame:
    return datasets.withColumns({"_title": F.upper("title"), "_description": F.upper("description")})


def holds(candidates: DataFrame) -> DataFrame:
    """The candidates whose text does contain their pattern."""
    found = F.contains("_title", "pattern") | F.contains("_description", "pattern")
    return candidates.where(found).select("pattern", *_MATCHED)


def text_matches(
    datasets: DataFrame, patterns: DataFrame, lengths: tuple[int, ...], small: bool, slots: int = SLOTS
) -> DataFrame:
    """``(pattern, id, ...)`` for every dataset whose title or description contains a pattern.

    With few patterns (``small``: their number and bytes were counted) they go
    to every task and the texts move once, to be dealt evenly. Otherwise the grams some
    pattern has are taken from the texts once, with ids only; they are counted,
    joined by shuffle with grams of many texts cut into pieces, and the
    candidates meet the texts once more to be verified, in ``slots`` pieces, as
    a long text may be one of many candidates.
    """
    # Texts are dealt anew, as few files of them would mean few tasks for all their grams.
    texts = upper_texts(datasets.repartition("id"))
    choices = settled(pattern_grams(patterns))
    # explode_outer: a plain explode would take the grams of every text a second
    # time, to test that there are any. The joins drop the null of an empty text.
    each_gram = F.explode_outer(text_grams(lengths))
    if small:
        by_request = choices.groupBy("gram").agg(F.count("*").alias("n"))
        filed = F.broadcast(filed_by_rarest(choices, by_request))
        candidates = texts.withColumn("gram", each_gram).join(filed, "gram")
        return holds(candidates)
    wanted = sent_if_small(settled(choices.select("gram").distinct()))
    exploded = settled(texts.select("id", each_gram.alias("gram")).join(wanted, "gram", "left_semi"))
    by_text = settled(exploded.groupBy("gram").agg(F.count("*").alias("n")))
    filed = settled(filed_by_rarest(choices, by_text))
    exploded = exploded.join(sent_if_small(filed.select("gram").distinct()), "gram", "left_semi")
    found = spread_join(exploded, filed, "gram", spread="id", counts=by_text).select("pattern", "id")
    candidates = settled(found)
    by_id = candidates.groupBy("id").agg(F.count("*").alias("n"))
    return holds(spread_join(candidates, texts, "id", spread="pattern", counts=by_id))


def _resolved(searches: DataFrame, catalog: Catalog, fields: frozenset[str]) -> DataFrame:
    """``searches`` with the ids its area and list names stand for.

    A given name nobody has leaves null (area) or an empty list, which no
    dataset matches.
    """
    if "anatomical_area_name" in fields:
        areas = catalog.anatomical_area.select(
            F.col("name").alias("anatomical_area_name"), F.col("id").alias("_area")
        )
        searches = searches.join(areas, "anatomical_area_name", "left")
    for field, relation in RELATIONS.items():
        listed = f"{field}_list"
        if listed not in fields:
            continue
        targets = catalog.table(relation.target).select("name", F.col("id").alias("_target"))
        ids = (
            searches.select("search_key", F.explode(split_list(F.col(listed))).alias("name"))
            .join(targets, "name")
            .groupBy("search_key")
            .agg(F.collect_set("_target").alias(f"_{field}"))
        )
        known = F.coalesce(F.col(f"_{field}"), F.array().cast("array<bigint>"))
        searches = searches.join(ids, "search_key", "left").withColumn(
            f"_{field}", F.when(F.col(listed).isNotNull(), known)
        )
    return searches


def _meets(fields: frozenset[str]) -> list[Column]:
    """Conditions on a dataset's own columns; a field not given asks for nothing."""
    tests = {
        "anatomical_area_name": F.col("anatomical_area_id") == F.col("_area"),
        "record_count_min": F.col("record_count") >= F.col("record_count_min"),
        "record_count_max": F.col("record_count") <= F.col("record_count_max"),
        "size_min": F.col("size") >= F.col("size_min"),
        "size_max": F.col("size") <= F.col("size_max"),
    }
    return [F.col(name).isNull() | test for name, test in tests.items() if name in fields]


def batch_search(
    catalog: Catalog,
    requests: DataFrame,
    small_rows: int = SMALL_ROWS,
    small_bytes: int = SMALL_BYTES,
    slots: int = SLOTS,
    matches: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every distinct search with every dataset it finds.

    ``requests`` has ``query`` and any of the filter fields; invalid rows find
    nothing. Returns ``search_key``, ``pattern``, the filter fields and
    ``dataset_id``, one row per hit; :func:`with_search_key` leads from a
    request to its key. Equal to running a single search per request.
    ``matches``, from :mod:`shelfmark.operators.gram_index`, finds texts by a
    stored index instead.
    """
    return _hits(catalog, settled(distinct_searches(requests)), small_rows, small_bytes, slots, matches)[0]


def _hits(
    catalog: Catalog,
    searches: DataFrame,
    small_rows: int,
    small_bytes: int,
    slots: int,
    matches: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, _Load]:
    """The hits of settled distinct searches, with their ``_search`` if they have one, and what was seen of them."""
    load = _Load.of(searches.drop("_search"), small_rows, small_bytes)
    patterns = searches.select("pattern").distinct()
    if matches is not None:
        found = matches(patterns)
    else:
        found = text_matches(catalog.dataset, patterns, load.gram_lengths or GRAM_LENGTHS, load.small, slots)
    resolved = _resolved(searches, catalog, load.fields)
    if load.small:
        hits = found.join(F.broadcast(resolved), "pattern")
    else:
        hits = spread_join(found, resolved, "pattern", spread="id", slots=slots)
    for condition in _meets(load.fields):
        hits = hits.where(condition)
    for field, relation in RELATIONS.items():
        if f"{field}_list" in load.fields:
            hits = _with_any_link(hits, catalog.table(relation.bridge), relation.key, f"_{field}", slots)
    numbers = [name for name in ("_search",) if name in searches.columns]
    return hits.select("search_key", "pattern", *FIELDS, *numbers, F.col("id").alias("dataset_id")), load


def _with_any_link(hits: DataFrame, bridge: DataFrame, key: str, wanted: str, slots: int) -> DataFrame:
    """Hits whose dataset has a link to one of ``wanted``; null asks for nothing.

    The links of a dataset are one list, of at most as many ids as the lookup
    table has, which its hits meet once; a dataset many searches find is cut
    into ``slots`` pieces.
    """
    links = bridge.groupBy(F.col("dataset_id").alias("id")).agg(F.collect_set(key).alias("_links"))
    joined = spread_join(hits, links, "id", spread="search_key", how="left", slots=slots)
    linked = F.coalesce(F.arrays_overlap("_links", wanted), F.lit(False))
    return joined.where(F.col(wanted).isNull() | linked).drop("_links")


_NUMBERS = ("id", "record_count", "size", "anatomical_area_id")
_TIMES = ("created_at", "updated_at")
_TEXTS = ("title", "description", "external_path", "local_path")


def _asked_orders(requests: DataFrame) -> DataFrame:
    """``(search_key, order_by, descending)``: the orders each distinct search is wanted in."""
    keyed = with_search_key(requests)
    default = F.array(*(F.lit(part) for part in DEFAULT_ORDERING))
    given = F.col("ordering") if "ordering" in keyed.columns else F.lit(None).cast("array<string>")
    ordering = F.when(F.size(given) > 0, given).otherwise(default)
    minus = F.get(ordering, 0).startswith("-")
    name = F.regexp_replace(F.get(ordering, 0), "^-", "")
    named = F.when(name == "anatomical_area", F.lit("anatomical_area_id")).otherwise(name)
    down = F.coalesce(F.get(ordering, 1) == "desc", F.lit(False))
    orders = keyed.select("search_key", named.alias("order_by"), (down != minus).alias("descending"))
    return orders.where(F.col("order_by").isin(*_NUMBERS, *_TIMES, *_TEXTS)).distinct()


def batch_ordered(
    catalog: Catalog,
    requests: DataFrame,
    small_rows: int = SMALL_ROWS,
    small_bytes: int = SMALL_BYTES,
    slots: int = SLOTS,
) -> DataFrame:
    """:func:`batch_search` with each hit's ``position``, from 0, in the order asked for.

    ``requests`` may have ``ordering``, a list as a single search takes it; one
    search asked for in several orders has its hits once per order, named by
    ``order_by`` and ``descending``. An order by an unknown column finds nothing.
    All hits are sorted and numbered as one table, and joined by counted keys, so
    a search with very many hits is spread over tasks like the rest. Searches and
    their orders go by numbers meanwhile; what they ask for is put back at the end.
    """
    searches = kept(number_rows(distinct_searches(requests), "_search"), "searches")
    asked = _asked_orders(requests).join(searches, "search_key")
    orders = kept(number_rows(asked, "_group"), "orders")
    few = is_small(orders, small_rows, small_bytes)
    wanted = orders.select("_search", "_group", "order_by", "descending")
    found = _hits(catalog, searches, small_rows, small_bytes, slots)[0]
    hits = kept(found.select("_search", "dataset_id"), "hits")
    by_search, by_dataset = (settled(hits.groupBy(key).agg(F.count("*").alias("n"))) for key in ("_search", "dataset_id"))
    held = catalog.dataset.select(F.col("id").alias("dataset_id"), *_NUMBERS, *_TIMES, *_TEXTS)

    def value(names: tuple[str, ...], read=lambda column: column) -> Column:
        return F.coalesce(*(F.when(F.col("order_by") == name, read(F.col(name))) for name in names))

    micros = value(_TIMES, lambda column: F.unix_micros(column.cast("timestamp")))
    number = F.coalesce(value(_NUMBERS).cast("bigint"), micros)
    text, down = value(_TEXTS), F.col("descending")
    nothing = number.isNull() & text.isNull()
    # Nulls count as the largest value.
    by = [
        (nothing != down).alias("_null"),
        F.when(down, -number).otherwise(number).alias("_number"),
        F.when(~down, text).alias("_up"),
        F.when(down, text).alias("_down"),
    ]
    # A search may have a third of all hits, and a dataset be found by a third of all searches.
    rows = spread_join(hits, held, "dataset_id", spread="_search", counts=by_dataset)
    if few:
        rows = rows.join(F.broadcast(wanted), "_search")
    else:
        rows = spread_join(rows, wanted, "_search", spread="dataset_id", counts=by_search)
    rows = rows.select("_group", "dataset_id", *by)
    ordered = rows.orderBy("_group", "_null", "_number", "_up", F.desc("_down"), "dataset_id")
    numbered = number_rows(ordered.select("_group", "dataset_id"), "_place")
    first = settled(numbered.groupBy("_group").agg(F.min("_place").alias("_first"), F.count("*").alias("n")))
    group = ["search_key", "order_by", "descending"]
    named = orders.select("_group", *group, "pattern", *FIELDS).join(first, "_group")
    if few:
        placed = numbered.join(F.broadcast(named.drop("n")), "_group")
    else:
        placed = spread_join(numbered, named.drop("n"), "_group", spread="_place", counts=first.drop("_first"))
    return placed.select(*group, "pattern", *FIELDS, "dataset_id", (F.col("_place") - F.col("_first")).alias("position"))


def batch_counts(
    catalog: Catalog,
    requests: DataFrame,
    id_column: str = "request_id",
    small_rows: int = SMALL_ROWS,
    small_bytes: int = SMALL_BYTES,
    slots: int = SLOTS,
) -> DataFrame:
    """``(request id, count)`` for every valid request, 0 where nothing is found."""
    keyed = settled(with_search_key(requests).select(id_column, "search_key", "pattern", *FIELDS))
    searches = settled(keyed.drop(id_column).distinct())
    hits, load = _hits(catalog, searches, small_rows, small_bytes, slots)
    counts = hits.groupBy("search_key").agg(F.count("*").alias("count"))
    asked = keyed.select(id_column, "search_key")
    if load.small:
        counted = asked.join(F.broadcast(counts), "search_key", "left")
    else:
        counted = spread_join(asked, counts, "search_key", spread=id_column, how="left", slots=slots)
    return counted.select(id_column, F.coalesce("count", F.lit(0)).alias("count"))
