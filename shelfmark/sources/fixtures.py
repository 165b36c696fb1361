"""The catalog as views over the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.times import expiry

# Columns of the test tables.
DRIVER_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}

# Search texts dealt out over the events, in order of event_id % 6.
QUERY_TEXTS = ("ring", "ECON", "red ", "bolt", "brand#1", "zz")

# Group ids of a customer's second membership, by nation % 5.
# They are the ids the segment names below give: A, B, F, H, M.
_GROUP_IDS = (1, 2, 6, 8, 13)


class Tables:
    """The test tables of one scale, read with declared schemas."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")

    @lru_cache(maxsize=None)
    def __call__(self, name: str) -> DataFrame:
        schema = DRIVER_SCHEMAS[name]
        return self._spark.read.schema(schema).parquet(f"{self._root}/{name}.parquet")


def _lookup(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(name).alias("name"))


def _priority_id(column: str = "o_orderpriority"):
    return F.substring(column, 1, 1).cast("bigint")


def _group_id():
    return (F.ascii("c_mktsegment") - 64).cast("bigint")


def _dataset(table: Tables) -> DataFrame:
    use = (
        table("lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.count("*").cast("int").alias("n"),
            F.min("l_shipdate").alias("created_at"),
            F.max("l_shipdate").alias("updated_at"),
        )
    )
    key = F.col("p_partkey")
    return (
        table("part")
        .join(use, "p_partkey", "left")
        .select(
            key.alias("id"),
            F.col("p_name").alias("title"),
            F.when(key % 7 != 0, F.concat("p_type", F.lit(" "), "p_brand")).alias("description"),
            F.concat(F.lit("http://example.org/ds/"), key.cast("string")).alias("external_path"),
            F.lit(None).cast("string").alias("local_path"),
            F.when(key % 5 != 0, F.coalesce("n", F.lit(0))).alias("record_count"),
            F.col("p_size").alias("size"),
            F.when(key % 11 != 0, key % 5).alias("anatomical_area_id"),
            "created_at",
            "updated_at",
        )
    )


def _dataset_modality(table: Tables) -> DataFrame:
    lines = table("lineitem")
    suppliers = table("supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("modality_id")
    )
    return lines.join(suppliers, "l_suppkey").select(
        F.col("l_partkey").alias("dataset_id"), "modality_id"
    ).distinct()


def _dataset_ml_task(table: Tables) -> DataFrame:
    lines = table("lineitem")
    tasks = table("orders").select(
        F.col("o_orderkey").alias("l_orderkey"), _priority_id().alias("ml_task_id")
    )
    return lines.join(tasks, "l_orderkey").select(
        F.col("l_partkey").alias("dataset_id"), "ml_task_id"
    ).distinct()


def _dataset_tag(table: Tables) -> DataFrame:
    lines = table("lineitem")
    return lines.select(
        F.col("l_partkey").alias("dataset_id"), F.col("l_suppkey").alias("tag_id")
    ).distinct()


def _users(table: Tables) -> DataFrame:
    joined = table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("date_joined")
    )
    return table("customer").join(joined, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.col("c_nationkey").cast("bigint").alias("role_id"),
        "date_joined",
    )


def _user_groups(table: Tables) -> DataFrame:
    second = F.element_at(F.array(*(F.lit(n) for n in _GROUP_IDS)), F.col("c_nationkey") % 5 + 1)
    both = F.array_distinct(F.array(_group_id(), second.cast("bigint")))
    return table("customer").select(F.col("c_custkey").alias("user_id"), F.explode(both).alias("group_id"))


def _user_permissions(table: Tables) -> DataFrame:
    return table("orders").select(
        F.col("o_custkey").alias("user_id"), _priority_id().alias("permission_id")
    ).distinct()


def _group_permissions(table: Tables) -> DataFrame:
    return table("customer").select(
        _group_id().alias("group_id"), F.col("c_nationkey").cast("bigint").alias("permission_id")
    ).distinct()


def _search_queries(table: Tables) -> DataFrame:
    texts = F.array(*(F.lit(text) for text in QUERY_TEXTS))
    turn = (F.col("event_id") % len(QUERY_TEXTS)).cast("int")
    return table("events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("user_id"),
        F.get(texts, turn).alias("query_text"),
        F.col("props").alias("filters"),
        F.col("ts").alias("performed_at"),
    )


def _collections(table: Tables) -> DataFrame:
    return table("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("/collections/"), F.col("o_orderkey").cast("string")).alias("storage_path_hdfs"),
        F.lit(None).cast("bigint").alias("archive_size_mb"),
        F.col("o_orderdate").alias("created_at"),
        expiry(F.col("o_orderdate")).alias("expires_at"),
    )


def _collection_datasets(table: Tables) -> DataFrame:
    n_queries = table("events").agg(F.count("*").alias("n")).scalar()
    return (
        table("lineitem")
        .groupBy(F.col("l_orderkey").alias("collection_id"), F.col("l_partkey").alias("dataset_id"))
        .agg(F.max("l_discount").cast("decimal(5,4)").alias("relevance_score"))
        .withColumn("query_id", F.col("collection_id") % n_queries)
    )


def fixture_catalog(spark: SparkSession, root: str) -> Catalog:
    """Every catalog table, derived from the test tables under ``root``."""
    table = Tables(spark, root)
    return Catalog(
        anatomical_area=lambda: _lookup(table("region"), "r_regionkey", "r_name"),
        modality=lambda: _lookup(table("nation"), "n_nationkey", "n_name"),
        ml_task=lambda: table("orders")
        .select(_priority_id().alias("id"), F.col("o_orderpriority").alias("name"))
        .distinct(),
        tag=lambda: _lookup(table("supplier"), "s_suppkey", "s_name"),
        dataset=lambda: _dataset(table),
        dataset_modality=lambda: _dataset_modality(table),
        dataset_ml_task=lambda: _dataset_ml_task(table),
        dataset_tag=lambda: _dataset_tag(table),
        roles=lambda: _lookup(table("nation"), "n_nationkey", "n_name"),
        users=lambda: _users(table),
        groups=lambda: table("customer")
        .select(_group_id().alias("id"), F.col("c_mktsegment").alias("name"))
        .distinct(),
        user_groups=lambda: _user_groups(table),
        user_permissions=lambda: _user_permissions(table),
        group_permissions=lambda: _group_permissions(table),
        user_search_queries=lambda: _search_queries(table),
        user_dataset_collections=lambda: _collections(table),
        collection_datasets=lambda: _collection_datasets(table),
    )


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Bulk text for relevance search."""
    return Tables(spark, root)("documents")


def logged_requests(catalog: Catalog) -> DataFrame:
    """The search log as batch requests: its text, and a record count from ``filters``."""
    least = F.get_json_object("filters", "$.k").cast("int") % 40
    return catalog.user_search_queries.select(
        F.col("id").alias("request_id"), F.col("query_text").alias("query"), least.alias("record_count_min")
    )
