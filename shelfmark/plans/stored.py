"""Registered queries over stored tables and indexes: each has the result of a query that reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.text import words
from shelfmark.operators import facet_index, gram_index, relevance_index
from shelfmark.operators.batch import batch_search
from shelfmark.operators.collections import log_entries
from shelfmark.operators.stored_changes import delete_rows, save_rows
from shelfmark.plans import queries
from shelfmark.schemas import LINK_KEYS, RELATIONS, STRICT_KEYS
from shelfmark.sources.fixtures import documents, fixture_catalog, logged_requests
from shelfmark.sources.folders import shared_folder
from shelfmark.sources.store import Store, Version
from shelfmark.streaming.numbered import numbered_log, write_batch

# Files per stored table, enough for the test tables to have ranges.
FILES = 8

SORTED_BY = {relation.bridge: ("dataset_id", relation.key) for relation in RELATIONS.values()}
SORTED_BY["collection_datasets"] = ("collection_id", "dataset_id")


def _stored(c: Catalog, *names: str) -> Version:
    spark = c.table(names[0]).sparkSession
    version = Store(spark, shared_folder(spark, "store")).open()
    for name in names:
        version = version.with_table(name, c.table(name), SORTED_BY.get(name, ("id",)), FILES)
    return version.put()


def stored_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Two saves in a row, each rewriting the files it touches."""
    c = fixture_catalog(spark, root)
    saves, order = queries.saves(c), ("saved_at", "save_id")
    # The later saves of a dataset may lie in either half; the last one overall has to win.
    last = saves.groupBy("id").agg(F.max(F.struct(*order)).alias("last"))
    final = saves.join(last, "id").where(F.struct(*order) == F.col("last")).select(*saves.columns)
    version = save_rows(_stored(c, "dataset"), "dataset", saves.join(final, ["save_id"], "left_anti"), order, queries.NOW).put()
    after = save_rows(version, "dataset", final, order, queries.NOW).put()
    return after.read("dataset").select("id", "title", "description", "record_count", "created_at", "updated_at")


def stored_delete_cascade(spark: SparkSession, root: str) -> DataFrame:
    c = fixture_catalog(spark, root)
    version = _stored(c, "dataset", *(relation.bridge for relation in RELATIONS.values()))
    gone = c.dataset.where("anatomical_area_id IS NULL").select("id")
    links = [fk for fk in LINK_KEYS if fk.parent == "dataset"]
    return queries.rows_left(delete_rows(version, "dataset", gone, links).put().catalog())


def stored_delete_set_null(spark: SparkSession, root: str) -> DataFrame:
    c = fixture_catalog(spark, root)
    areas = c.anatomical_area.where(F.col("name").startswith("A")).select("id")
    rules = [fk for fk in LINK_KEYS if fk.parent == "anatomical_area"]
    left = delete_rows(_stored(c, "dataset", "anatomical_area"), "anatomical_area", areas, rules).put()
    return left.read("dataset").select("id", "anatomical_area_id")


def stored_delete_users(spark: SparkSession, root: str) -> DataFrame:
    c = fixture_catalog(spark, root)
    concerned = ("users", "user_search_queries", "user_dataset_collections", "collection_datasets")
    rules = [fk for fk in STRICT_KEYS if fk.parent in concerned and fk.child in concerned]
    left = delete_rows(_stored(c, *concerned), "users", queries.idle_users(c), rules).put()
    return queries.collections_left(left.catalog())


def relevance_indexed(spark: SparkSession, root: str) -> DataFrame:
    """Documents indexed in two segments, one added to the other."""
    docs, english = documents(spark, root), F.coalesce(F.col("lang") == "en", F.lit(False))
    version = Store(spark, shared_folder(spark, "index")).open()
    for part in (english, ~english):
        version = relevance_index.add_documents(version, docs.where(part), ("text",), "doc_id").put()
    return queries.ranked(relevance_index.indexed_topk(version, queries.document_queries(spark), id_column="doc_id"))


def _gram_indexed(c: Catalog) -> Callable[[DataFrame], DataFrame]:
    """An index of the datasets as they were before each seventh got a new title, and then of those."""
    spark, changed = c.dataset.sparkSession, F.col("id") % 7 == 0
    before = c.dataset.withColumn("title", F.when(changed, F.concat(F.lit("old "), "title")).otherwise(F.col("title")))
    version = gram_index.add_datasets(Store(spark, shared_folder(spark, "grams")).open(), before, FILES).put()
    version = gram_index.add_datasets(version, c.dataset.where(changed), FILES)
    version = version.with_table("dataset", c.dataset, ("id",), FILES).put()
    return gram_index.matcher(version, gram_index.stored_datasets(version))


def batch_search_indexed(spark: SparkSession, root: str) -> DataFrame:
    c = fixture_catalog(spark, root)
    found = batch_search(c, logged_requests(c), matches=_gram_indexed(c))
    return found.select("pattern", "record_count_min", "dataset_id")


def batch_words_indexed(spark: SparkSession, root: str) -> DataFrame:
    c = fixture_catalog(spark, root)
    requests = documents(spark, root).select(F.explode(words(F.col("text"))).alias("query")).distinct()
    return batch_search(c, requests, matches=_gram_indexed(c)).select("pattern", "dataset_id")


def _faceted(c: Catalog) -> Version:
    """Options indexed while each fifth dataset had another area, and then brought up to date."""
    changed = F.col("id") % 5 == 0
    before = c.replace(dataset=c.dataset.withColumn("anatomical_area_id", F.when(~changed, F.col("anatomical_area_id"))))
    spark = c.dataset.sparkSession
    version = facet_index.with_facets(Store(spark, shared_folder(spark, "facets")).open(), before, FILES).put()
    return facet_index.with_changed(version, c, c.dataset.where(changed).select("id")).put()


def facets_indexed(spark: SparkSession, root: str) -> DataFrame:
    c = fixture_catalog(spark, root)
    return facet_index.facets_in_progress(_faceted(c), c, queries.TEXT)


def facets_in_progress(spark: SparkSession, root: str) -> DataFrame:
    """Each facet of a search without the filters on that facet."""
    c = fixture_catalog(spark, root)
    return facet_index.facets_in_progress(_faceted(c), c, queries.TEXT, queries.SIZED)


def log_numbered(spark: SparkSession, root: str) -> DataFrame:
    """The searches logged in four batches, one of them twice: who asked what how often, and the ids given."""
    asked = fixture_catalog(spark, root).user_search_queries.select(
        "id", "user_id", F.col("query_text").alias("query"), "filters", "performed_at"
    )
    path = shared_folder(spark, "log")
    for number in (0, 1, 1, 2, 3):
        write_batch(log_entries(asked.where(F.col("id") % 4 == number).drop("id")), number, path, first_id=1)
    log = numbered_log(spark, path)
    ids = log.agg(F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    counts = log.groupBy("user_id", "query_text").agg(F.count("*").alias("n_rows"))
    return counts.join(F.broadcast(ids))  # a single row


# Each query with the one whose result it must have.
SAME_AS = {
    stored_upsert: "upsert_latest",
    stored_delete_cascade: "delete_cascade",
    stored_delete_set_null: "delete_set_null",
    stored_delete_users: "delete_users",
    relevance_indexed: "relevance_documents",
    batch_search_indexed: "batch_search",
    batch_words_indexed: "batch_search_words",
    facets_indexed: "facets_of_search",
    facets_in_progress: "facets_in_progress",
    log_numbered: "log_numbered",
}
