"""The registered queries: each operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.tables import stacked
from shelfmark.functions.text import split_list, words
from shelfmark.operators import accounts, batch, changes, collections, facets, quality, relevance
from shelfmark.operators import search as searching
from shelfmark.operators.detail import detail_by_ids, detail_view, display_names, json_rows, labels
from shelfmark.operators.filters import apply_conditions, parse_parameters, text_match
from shelfmark.operators.numbering import assign_ids, number_rows
from shelfmark.operators.paging import page
from shelfmark.operators.requests import FIELDS, check_requests, read_filters
from shelfmark.schemas import LINK_KEYS, RELATIONS, STRICT_KEYS
from shelfmark.sources.fixtures import documents, fixture_catalog, logged_requests

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime(2025, 1, 1)

TEXT = "rin"
PARAMS = {
    "record_count_min": 25,
    "modalities_list": "NATION_1,NATION_2,NATION_3",
    "ml_tasks_list": "1-URGENT,2-HIGH,5-LOW",
}
SIZED = {**PARAMS, "size_max": 30}

DOCUMENT_QUERIES = ("the by anat", "die und der", "la de que", "thereon", "Eauouon à côté")

_REGISTRY: dict[str, Query] = {}


def _query(function: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
    """Register a query over the catalog under its function's name."""
    name = function.__name__.removesuffix("_query")
    _REGISTRY[name] = lambda spark, root: function(fixture_catalog(spark, root))
    return function


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# Predicates and the filter language


@_query
def icontains_or(c: Catalog) -> DataFrame:
    return c.dataset.where(text_match(TEXT)).select("id", "title", "description")


def _filtered(c: Catalog, **params: object) -> DataFrame:
    return apply_conditions(c.dataset, c, parse_parameters(params).conditions)


@_query
def area_exact(c: Catalog) -> DataFrame:
    return _filtered(c, anatomical_area_name="ASIA").select("id", "title")


@_query
def range_bounds(c: Catalog) -> DataFrame:
    bounds = {"record_count_min": 25, "record_count_max": 35, "size_min": 10, "size_max": 40}
    return _filtered(c, **bounds).select("id", "record_count", "size")


@_query
def list_any_of(c: Catalog) -> DataFrame:
    wanted = {
        "modalities_list": "NATION_1,NATION_2,,NATION_2, NATION_4",
        "ml_tasks_list": "1-URGENT,5-LOW",
        "tags_list": "Supplier#000000001,Supplier#000000007",
    }
    parts = [
        _filtered(c, **{name: value}).select(F.lit(name).alias("parameter"), "id")
        for name, value in wanted.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query
def id_list(c: Catalog) -> DataFrame:
    return _filtered(c, modalities_id_list="1,2,3", anatomical_area_id=2).select("id", "title")


@_query
def equality_fallback(c: Catalog) -> DataFrame:
    return _filtered(c, title="red ring", unused_ex="x", description=None).select("id", "title")


@_query
def split_items(c: Catalog) -> DataFrame:
    items = split_list(F.translate("title", " e", ",,"))
    return c.dataset.select("id", F.posexplode(items).alias("position", "item"))


# Search


@_query
def search_set(c: Catalog) -> DataFrame:
    found = searching.search(c, TEXT, PARAMS).select("id", "title", "record_count", "created_at")
    return number_rows(found)


@_query
def search_set_size(c: Catalog) -> DataFrame:
    return number_rows(searching.search(c, TEXT, {**SIZED, "ordering": ["size", "asc"]}).select("id", "size"))


@_query
def search_untrimmed(c: Catalog) -> DataFrame:
    params = {"record_count_min": " 25.0 ", "anatomical_area_name": "\tASIA ", "tags_list": "  ", "size_max": ""}
    return searching.find(c, f"  {TEXT}\n", params).select("id", "title")


@_query
def search_bag(c: Catalog) -> DataFrame:
    return searching.find(c, TEXT, SIZED, "as_written").select("id", "title", "size")


@_query
def search_count(c: Catalog) -> DataFrame:
    counts = [
        searching.search_count(c, TEXT, SIZED, how).select(F.lit(how).alias("semantics"), "count")
        for how in ("intended", "as_written")
    ]
    return counts[0].unionByName(counts[1])


@_query
def newest(c: Catalog) -> DataFrame:
    return searching.newest(c).select("id", "title", "created_at")


@_query
def oldest(c: Catalog) -> DataFrame:
    return searching.newest(c, ascending=True).select("id", "title", "created_at")


@_query
def page_query(c: Catalog) -> DataFrame:
    return page(c.dataset, 2).select("id", "created_at")


@_query
def page_by_record_count(c: Catalog) -> DataFrame:
    return page(c.dataset, 3, ["record_count", "desc"]).select("id", "record_count")


@_query
def deep_page(c: Catalog) -> DataFrame:
    return page(c.dataset, 30, ["title", "asc"], direct_rows=100).select("id", "title")


# Detail


def _as_text(detail: DataFrame) -> DataFrame:
    return detail.withColumns({name: labels(F.col(name)) for name in ("modalities", "ml_tasks", "tags")})


@_query
def detail_view_query(c: Catalog) -> DataFrame:
    return _as_text(detail_view(c))


@_query
def detail_by_ids_query(c: Catalog) -> DataFrame:
    collected = c.collection_datasets.select(F.col("dataset_id").alias("id")).distinct()
    return _as_text(detail_by_ids(c, collected))


@_query
def detail_of_search(c: Catalog) -> DataFrame:
    return number_rows(_as_text(searching.search_details(c, TEXT, {"record_count_min": 25})))


@_query
def response_rows(c: Catalog) -> DataFrame:
    return json_rows(detail_view(c))


@_query
def shown_as(c: Catalog) -> DataFrame:
    return display_names(c)


# Users and groups


@_query
def users_newest(c: Catalog) -> DataFrame:
    return number_rows(accounts.users(c))


@_query
def user_groups(c: Catalog) -> DataFrame:
    listed = accounts.users_with_groups(c)
    return listed.select("id", F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups"))


def _ids_text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@_query
def user_permissions(c: Catalog) -> DataFrame:
    return accounts.users_with_groups(c).select("id", _ids_text("permissions"))


@_query
def group_permissions(c: Catalog) -> DataFrame:
    return accounts.groups_with_permissions(c).select("id", "name", _ids_text("permissions"))


@_query
def groups_by_name(c: Catalog) -> DataFrame:
    return number_rows(accounts.groups(c))


@_query
def account_by_id(c: Catalog) -> DataFrame:
    user = accounts.user_by_id(c, 42).select("id", F.col("username").alias("name"))
    return user.unionByName(accounts.group_by_id(c, 13))


# Facets


@_query
def facets_query(c: Catalog) -> DataFrame:
    return facets.facets(c)


@_query
def facets_of_search(c: Catalog) -> DataFrame:
    return facets.facets(c, searching.find(c, TEXT).select("id"))


# Integrity


@_query
def dup_names_query(c: Catalog) -> DataFrame:
    return quality.duplicates(c.dataset, ["title"], "dataset")


@_query
def dup_pairs_query(c: Catalog) -> DataFrame:
    pairs = c.collection_datasets.select("query_id", "dataset_id")
    return quality.duplicates(pairs, ["query_id", "dataset_id"], "collection_datasets")


@_query
def unique_titles(c: Catalog) -> DataFrame:
    return quality.without_duplicates(c.dataset.select("id", "title", "size"), ["title"])


@_query
def missing_query(c: Catalog) -> DataFrame:
    return quality.missing(c.dataset, ["description", "record_count", "anatomical_area_id"], "dataset")


def _without_area(c: Catalog) -> Catalog:
    """Datasets lose the rows without an area, so that references to them dangle."""
    return c.replace(dataset=c.dataset.where(F.col("anatomical_area_id").isNotNull()))


@_query
def orphans_query(c: Catalog) -> DataFrame:
    return quality.orphans(c.dataset_modality, "dataset_id", _without_area(c).dataset, "dataset_modality")


@_query
def orphaned_rows(c: Catalog) -> DataFrame:
    return quality.orphan_rows(c.dataset_tag, "dataset_id", _without_area(c).dataset)


def _faulty(c: Catalog) -> Catalog:
    """A catalog with rows that break every kind of rule."""
    areas, links, users = c.anatomical_area, c.user_groups, c.users
    name, id_ = F.col("name"), F.col("id")
    bad = [
        areas.select(id_, name),
        areas.select(F.lit(None).cast("bigint").alias("id"), name),
        areas.select(id_ + 100, F.lit(None).cast("string")),
        areas.select(id_ + 200, F.repeat(name, 100)),
    ]
    bad_links = [
        links.where("user_id % 7 = 0"),
        links.where("user_id % 7 = 1").withColumn("group_id", F.lit(None).cast("bigint")),
    ]
    role = F.when(F.col("id") % 11 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("role_id"))
    return _without_area(c).replace(
        anatomical_area=reduce(DataFrame.union, bad, areas),
        user_groups=reduce(DataFrame.unionByName, bad_links, links),
        users=users.withColumn("role_id", role),
    )


@_query
def all_violations(c: Catalog) -> DataFrame:
    return quality.violations(_faulty(c))


@_query
def delete_blocked(c: Catalog) -> DataFrame:
    return quality.blocked_deletes(c, "dataset", c.dataset.select("id"))


@_query
def delete_blocked_roles(c: Catalog) -> DataFrame:
    return quality.blocked_deletes(c, "roles", c.roles.select("id"))


# Changes


@_query
def delete_cascade(c: Catalog) -> DataFrame:
    """Deletes datasets without an area under the rules of an application that has no collections."""
    return rows_left(changes.delete(c, "dataset", c.dataset.where("anatomical_area_id IS NULL"), LINK_KEYS))


def rows_left(left: Catalog) -> DataFrame:
    links = [(relation.bridge, "dataset_id") for relation in RELATIONS.values()]
    rows = stacked(
        [
            left.table(name).select(F.lit(name).alias("table_name"), F.col(key).alias("dataset_id"))
            for name, key in (("dataset", "id"), *links)
        ]
    )
    return rows.groupBy("table_name", "dataset_id").agg(F.count("*").alias("n_rows"))


@_query
def delete_set_null(c: Catalog) -> DataFrame:
    areas = c.anatomical_area.where(F.col("name").startswith("A")).select("id")
    left = changes.delete(c, "anatomical_area", areas)
    return left.dataset.select("id", "anatomical_area_id")


@_query
def delete_users(c: Catalog) -> DataFrame:
    """Users who never searched go, and their collections with them."""
    return collections_left(changes.delete(c, "users", idle_users(c), STRICT_KEYS))


def idle_users(c: Catalog) -> DataFrame:
    searched = c.user_search_queries.select(F.col("user_id").alias("id"))
    return c.users.select("id").join(searched, "id", "left_anti")


def collections_left(left: Catalog) -> DataFrame:
    kept = left.user_dataset_collections.groupBy("user_id").agg(F.count("*").alias("n_collections"))
    rows = left.collection_datasets.join(
        left.user_dataset_collections.select(F.col("id").alias("collection_id"), "user_id"), "collection_id"
    )
    held = rows.groupBy("user_id").agg(F.count("*").alias("n_datasets"))
    return kept.join(held, "user_id", "left").select(
        "user_id", "n_collections", F.coalesce("n_datasets", F.lit(0)).alias("n_datasets")
    )


def saves(c: Catalog) -> DataFrame:
    """One save per logged search: its text becomes the title of a dataset."""
    log = c.user_search_queries
    return log.select(
        (F.col("id") * 7 % 5003).alias("id"),
        F.concat_ws(" ", "query_text", F.col("id").cast("string")).alias("title"),
        F.col("filters").alias("description"),
        F.lit(None).cast("string").alias("external_path"),
        F.lit(None).cast("string").alias("local_path"),
        F.get_json_object("filters", "$.k").cast("int").alias("record_count"),
        F.lit(None).cast("int").alias("size"),
        F.lit(None).cast("bigint").alias("anatomical_area_id"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.col("performed_at").alias("saved_at"),
        F.col("id").alias("save_id"),
    )


@_query
def upsert_latest(c: Catalog) -> DataFrame:
    saved = changes.upsert(c.dataset, saves(c), order=("saved_at", "save_id"), now=NOW)
    return saved.select("id", "title", "description", "record_count", "created_at", "updated_at")


@_query
def insert_without_id(c: Catalog) -> DataFrame:
    """Every logged search saved as a new dataset: none is lost, and each gets an id of its own."""
    new = saves(c).withColumns({"id": F.lit(None).cast("bigint"), "title": F.regexp_replace("title", " [0-9]+$", "")})
    saved = changes.upsert(c.dataset, new, order=("saved_at", "save_id"), now=NOW)
    top = c.dataset.agg(F.max("id")).scalar()
    fresh = (F.col("id") > top).alias("fresh")
    return saved.groupBy("title", "description", "record_count", "created_at", "updated_at", fresh).agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids")
    )


@_query
def default_times(c: Catalog) -> DataFrame:
    blank = c.user_dataset_collections.select(
        "id", F.when(F.dayofmonth("created_at") > 15, F.col("created_at")).alias("created_at")
    )
    return changes.with_defaults(blank, NOW)


@_query
def assign_ids_query(c: Catalog) -> DataFrame:
    fresh = assign_ids(c.user_search_queries.select("query_text"), c.dataset)
    return fresh.agg(
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.count_distinct("id").alias("n_ids"),
        F.count("*").alias("n_rows"),
    )


@_query
def expiry_query(c: Catalog) -> DataFrame:
    given = c.user_dataset_collections.select(
        "id",
        F.when(F.dayofmonth("created_at") > 1, F.col("created_at")).alias("created_at"),
        F.col("created_at").alias("expires_at"),
    )
    return changes.with_expiry(given)


# Collections and the log


@_query
def archive_size(c: Catalog) -> DataFrame:
    return collections.archive_sizes(c.collection_datasets, c.dataset)


@_query
def collection_manifest(c: Catalog) -> DataFrame:
    return collections.manifest(c)


@_query
def collection_contents(c: Catalog) -> DataFrame:
    rows = collections.contents(c)
    return rows.withColumn("relevance_score", F.col("relevance_score").cast("double"))


@_query
def archive_contents(c: Catalog) -> DataFrame:
    return collections.archive_rows(c).select("collection_id", "dataset_id", "title", "size")


@_query
def built_collections(c: Catalog) -> DataFrame:
    fresh = _built(c).user_dataset_collections.where(F.col("created_at") == F.lit(NOW).cast("timestamp_ntz"))
    return fresh.groupBy("user_id", "created_at", "expires_at").agg(
        F.count("*").alias("n_collections"), F.sum("archive_size_mb").alias("total_mb")
    )


@_query
def built_headers(c: Catalog) -> DataFrame:
    """Every new collection's owner, size, expiry, and whether path and id agree; ids follow those in use."""
    top = c.user_dataset_collections.agg(F.max("id")).scalar()
    fresh = _built(c).user_dataset_collections.where(F.col("id") > top)
    return fresh.select(
        "user_id",
        "archive_size_mb",
        "created_at",
        "expires_at",
        (F.col("storage_path_hdfs") == F.concat(F.lit("/collections/"), F.col("id").cast("string"))).alias("path_fits"),
    )


@_query
def built_members(c: Catalog) -> DataFrame:
    """Every dataset of every new collection, by its owner and query."""
    top = c.user_dataset_collections.agg(F.max("id")).scalar()
    built = _built(c)
    owners = built.user_dataset_collections.select(F.col("id").alias("collection_id"), "user_id")
    return (
        built.collection_datasets.where(F.col("collection_id") > top)
        .join(owners, "collection_id")
        .select("user_id", "query_id", "dataset_id", F.col("relevance_score").cast("double").alias("relevance_score"))
    )


def _built(c: Catalog) -> Catalog:
    """A collection for everyone who searched, from the five best datasets per text."""
    texts = c.user_search_queries.groupBy("query_text").agg(F.min("id").alias("query_id"))
    ranked = relevance.relevance_topk(c.dataset, texts.withColumnRenamed("query_text", "query"))
    hits = ranked.select("query_id", F.col("id").alias("dataset_id"), "relevance_score")
    askers = c.user_search_queries.where(F.col("user_id").isNotNull()).select("query_text", "user_id")
    owners = texts.join(askers.distinct(), "query_text").select("query_id", "user_id")
    before = c.replace(
        user_dataset_collections=c.user_dataset_collections, collection_datasets=c.collection_datasets
    )
    return collections.build_collections(before, hits, owners, NOW)


@_query
def log_filters(c: Catalog) -> DataFrame:
    return collections.saved_filter(c.user_search_queries, "$.k")


@_query
def log_append(c: Catalog) -> DataFrame:
    asked = c.user_search_queries.select(
        "user_id",
        F.col("query_text").alias("query"),
        "filters",
        F.lit(None).cast("timestamp_ntz").alias("performed_at"),
    )
    added = collections.append_log(c, asked, NOW)
    return added.groupBy("user_id", "query_text", "performed_at").agg(F.count("*").alias("n_rows"))


# Requests


def _raw_requests(c: Catalog) -> DataFrame:
    """Every logged search as raw text input, good and bad, by turns of its id."""
    turn = F.col("id") % 8
    text = F.col("query_text")
    query = (
        F.when(turn == 0, F.concat(F.lit("  "), text, F.lit("\t")))
        .when(turn == 1, F.lit(" z "))
        .when(turn == 2, F.lit(" \n "))
        .when(turn == 3, F.repeat(F.lit("q"), (F.col("id") % 60 + 70).cast("int")))
        .when(turn == 4, F.lit(None).cast("string"))
        .otherwise(text)
    )
    k = F.col("k")
    least = (
        F.when(turn == 5, F.concat(k, F.lit(".0")))
        .when(turn == 6, F.concat(k, F.lit(".5")))
        .when(turn == 7, F.lit("many"))
        .when(turn == 0, F.concat(F.lit(" -"), k))
        .otherwise(F.lit(""))
    )
    area = F.when(F.col("id") % 3 == 0, F.lit("A")).when(F.col("id") % 3 == 1, F.lit(" ASIA "))
    log = c.user_search_queries.withColumn("k", F.get_json_object("filters", "$.k"))
    return log.select(
        F.col("id").alias("request_id"),
        query.alias("query"),
        area.alias("anatomical_area_name"),
        least.alias("record_count_min"),
    )


@_query
def request_validity(c: Catalog) -> DataFrame:
    checked = check_requests(_raw_requests(c))
    return checked.select("request_id", F.array_join("errors", ",").alias("errors"))


@_query
def saved_requests(c: Catalog) -> DataFrame:
    log = c.user_search_queries.withColumn(
        "filters",
        F.when(
            F.col("id") % 2 == 0,
            F.concat(
                F.lit('{"record_count_min": "'),
                F.get_json_object("filters", "$.k"),
                F.lit('", "modalities_list": ["CT", "MRI"], "tags_list": "a,b", "ordering": "size"}'),
            ),
        ),
    )
    ordering = F.array_join("ordering", ",").alias("ordering")
    return read_filters(log).select(
        "id", "query_text", "record_count_min", "size_max", "modalities_list", "tags_list", ordering
    )


# Batch search


@_query
def batch_search(c: Catalog) -> DataFrame:
    found = batch.batch_search(c, logged_requests(c))
    return found.select("pattern", "record_count_min", "dataset_id")


@_query
def batch_search_shuffled(c: Catalog) -> DataFrame:
    found = batch.batch_search(c, logged_requests(c), small_rows=0)
    return found.select("pattern", "record_count_min", "dataset_id")


def _listed_requests(c: Catalog) -> DataFrame:
    k = F.col("id") % 100
    return c.user_search_queries.select(
        F.col("id").alias("request_id"),
        F.col("query_text").alias("query"),
        F.when(k % 4 != 0, F.concat(F.lit("NATION_"), (k % 25).cast("string"), F.lit(",NATION_1"))).alias(
            "modalities_list"
        ),
        F.when(k % 3 == 0, F.lit("1-URGENT,none such")).alias("ml_tasks_list"),
        F.when(k % 5 == 0, F.lit("ASIA")).when(k % 5 == 1, F.lit("ATLANTIS")).alias("anatomical_area_name"),
        (k % 50).alias("size_max"),
    )


@_query
def batch_search_lists(c: Catalog) -> DataFrame:
    found = batch.batch_search(c, _listed_requests(c))
    return found.select("pattern", *(name for name in FIELDS if name in _LISTED), "dataset_id")


_LISTED = ("modalities_list", "ml_tasks_list", "anatomical_area_name", "size_max")


@_query
def batch_ordered(c: Catalog) -> DataFrame:
    """The logged searches, each in one of four orders by turns of its id."""
    orders = (["size", "asc"], ["title", "desc"], ["-record_count"], None)
    turn = F.col("request_id") % len(orders)
    wanted = F.coalesce(
        *(F.when(turn == k, F.array(*map(F.lit, order))) for k, order in enumerate(orders) if order)
    )
    found = batch.batch_ordered(c, logged_requests(c).withColumn("ordering", wanted))
    return found.select("pattern", "record_count_min", "order_by", "descending", "dataset_id", "position")


@_query
def batch_counts(c: Catalog) -> DataFrame:
    return batch.batch_counts(c, logged_requests(c))


# Relevance


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("relevance_score", F.col("relevance_score").cast("double"))


@_query
def relevance_top5(c: Catalog) -> DataFrame:
    texts = c.user_search_queries.select(F.col("query_text").alias("query")).distinct()
    found = relevance.relevance_topk(c.dataset, texts.withColumn("query_id", F.col("query")))
    return ranked(found)


def document_queries(spark: SparkSession) -> DataFrame:
    asked = F.posexplode(F.array(*(F.lit(text) for text in DOCUMENT_QUERIES)))
    return spark.range(1).select(asked.alias("query_id", "query"))


def relevance_documents(spark: SparkSession, root: str) -> DataFrame:
    found = relevance.relevance_topk(
        documents(spark, root), document_queries(spark), text_columns=("text",), id_column="doc_id"
    )
    return ranked(found)


def relevance_many(spark: SparkSession, root: str) -> DataFrame:
    """More hits per query than a task keeps by a per-task limit."""
    found = relevance.relevance_topk(
        documents(spark, root), document_queries(spark), 2000, text_columns=("text",), id_column="doc_id"
    )
    return ranked(found)


def long_documents(spark: SparkSession, root: str) -> DataFrame:
    return quality.too_long(documents(spark, root), {"text": 500, "source": 3}, "documents", ["doc_id"])


_REGISTRY["relevance_documents"] = relevance_documents
_REGISTRY["relevance_many"] = relevance_many
_REGISTRY["too_long"] = long_documents


def batch_search_words(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct word of the documents as a search of the datasets."""
    word = F.explode(words(F.col("text"))).alias("query")
    requests = documents(spark, root).select(word).distinct()
    return batch.batch_search(fixture_catalog(spark, root), requests).select("pattern", "dataset_id")


_REGISTRY["batch_search_words"] = batch_search_words


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """One search end to end: text, lists and a bound, in order, with details."""
    catalog = fixture_catalog(spark, root)
    return _as_text(searching.search_details(catalog, TEXT, PARAMS))
