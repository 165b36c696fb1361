"""Reading catalog tables: files with a declared schema, or a relational database."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.schemas import SCHEMAS


def read_files(spark: SparkSession, root: str, format: str = "parquet") -> Catalog:
    """The catalog stored as ``<root>/<table>``; schemas are declared, never inferred."""

    def load(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).format(format).load(f"{root}/{name}")

    return Catalog(**{name: partial(load, name) for name in SCHEMAS})


def read_tables(spark: SparkSession, database: str) -> Catalog:
    """The catalog stored as tables of ``database`` (see ``sinks.save_bucketed``)."""
    return Catalog(**{name: partial(spark.table, f"{database}.{name}") for name in SCHEMAS})


@dataclass(frozen=True)
class StoredTable:
    """Where a catalog table is kept in a database, and columns named differently there."""

    name: str
    renamed: Mapping[str, str] = field(default_factory=dict)
    range_column: str = "id"  # a number the stored table is read in ranges of
    absent: tuple[str, ...] = ()  # columns of the catalog this layout does not have


# The two database layouts. The first is the application's own,
# the second that of the script run when a database is created.
APPLICATION_LAYOUT = {
    "anatomical_area": StoredTable("datasets_anatomicalarea"),
    "modality": StoredTable("datasets_modality"),
    "ml_task": StoredTable("datasets_mltask"),
    "tag": StoredTable("datasets_tag"),
    "dataset": StoredTable("datasets_dataset"),
    "dataset_modality": StoredTable("datasets_datasetmodality"),
    "dataset_ml_task": StoredTable("datasets_datasetmltask"),
    "dataset_tag": StoredTable("datasets_datasettag"),
    "users": StoredTable("auth_user", absent=("role_id",)),
    "groups": StoredTable("auth_group"),
    "user_groups": StoredTable("auth_user_groups"),
    "user_permissions": StoredTable("auth_user_user_permissions"),
    "group_permissions": StoredTable("auth_group_permissions"),
}
SCRIPT_LAYOUT = {
    "anatomical_area": StoredTable("anatomical_areas"),
    "modality": StoredTable("modalities"),
    "ml_task": StoredTable("ml_tasks"),
    "tag": StoredTable("tags"),
    "dataset": StoredTable(
        "datasets",
        {
            "external_link": "external_path",
            "local_storage_path": "local_path",
            "dataset_size_mb": "size",
        },
    ),
    "dataset_modality": StoredTable("dataset_modalities", range_column="dataset_id"),
    "dataset_ml_task": StoredTable("dataset_ml_tasks", range_column="dataset_id"),
    "dataset_tag": StoredTable("dataset_tags", range_column="dataset_id"),
    "roles": StoredTable("roles"),
    "users": StoredTable("users", {"login": "username", "created_at": "date_joined"}),
    "user_search_queries": StoredTable("user_search_queries"),
    "user_dataset_collections": StoredTable("user_dataset_collections"),
    "collection_datasets": StoredTable("collection_datasets", range_column="collection_id"),
}


def read_layout(load: Callable[[str], DataFrame], layout: Mapping[str, StoredTable]) -> Catalog:
    """A catalog from ``load(<stored table>)``, with the catalog's names and types.

    Columns the catalog does not know, such as password hashes, are not read.
    Times with a zone become UTC wall-clock times. A column the layout should
    have and the stored table lacks is an error.
    """

    def build(name: str) -> DataFrame:
        stored = layout[name]
        df = load(stored.name).withColumnsRenamed(dict(stored.renamed))
        return df.select(
            *(
                F.col(column.name).cast(column.dataType).alias(column.name)
                for column in SCHEMAS[name]
                if column.name not in stored.absent
            )
        )

    return Catalog(**{name: partial(build, name) for name in layout})


def read_database(
    spark: SparkSession,
    source: "DatabaseSource",
    layout: Mapping[str, StoredTable] = APPLICATION_LAYOUT,
    *,
    partitions: int,
) -> Catalog:
    """The catalog kept in a relational database, each table read in ``partitions`` equal parts by its range column."""
    columns = {stored.name: stored.range_column for stored in layout.values()}
    return read_layout(lambda name: source.read(spark, name, partitions, columns[name]), layout)


# URL and driver class per database engine.
_ENGINES = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{name}", "org.postgresql.Driver"),
    "sqlite3": ("jdbc:sqlite:{name}", "org.sqlite.JDBC"),
}


@dataclass(frozen=True)
class DatabaseSource:
    """A relational database read over JDBC; the driver jar must be on the class path."""

    engine: str = "sqlite3"
    host: str = "127.0.0.1"
    port: int = 5432
    name: str | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)

    @classmethod
    def from_environment(cls, environ: Mapping[str, str] = os.environ) -> "DatabaseSource":
        """The database named by ``DB_ENGINE``, ``DB_HOST``, ``DB_PORT``, ``DB_NAME``, ..."""
        given = {
            part: environ[f"DB_{part.upper()}"]
            for part in ("engine", "host", "port", "name", "user", "password")
            if environ.get(f"DB_{part.upper()}")
        }
        if "port" in given:
            given["port"] = int(given["port"])
        return cls(**given)

    def options(self) -> dict[str, str]:
        if self.engine not in _ENGINES:
            raise ValueError(f"unknown database engine {self.engine!r}")
        url, driver = _ENGINES[self.engine]
        found = {
            "url": url.format(host=self.host, port=self.port, name=self.name),
            "driver": driver,
            "user": self.user,
            "password": self.password,
        }
        return {key: value for key, value in found.items() if value is not None}

    def read(
        self,
        spark: SparkSession,
        table: str,
        partitions: int,
        partition_column: str = "id",
        fetch_rows: int = 10_000,
    ) -> DataFrame:
        """A table, read in ``partitions`` parts of ``partition_column`` side by side.

        The database is asked first where its key is to be cut, so the parts have
        equally many rows however its values are spread; filters and columns
        are pushed down to it in either case.
        """
        options = self.options()
        base = spark.read.format("jdbc").options(**options).option("fetchsize", fetch_rows)
        if partitions < 2:
            return base.option("dbtable", table).load()
        cuts = base.option("query", cuts_query(table, partition_column, partitions)).load().orderBy("cut").collect()
        if not cuts:
            return base.option("dbtable", table).load()
        predicates = range_predicates(partition_column, [row["cut"] for row in cuts[:-1]])
        given = {key: value for key, value in options.items() if key != "url"} | {"fetchsize": str(fetch_rows)}
        return spark.read.jdbc(options["url"], table, predicates=predicates, properties=given)


def cuts_query(table: str, column: str, parts: int) -> str:
    """SQL for the largest value of ``column`` in each of ``parts`` equally large parts of the table, at most one row a part."""
    numbered = f"SELECT {column} AS v, ntile({parts}) OVER (ORDER BY {column}) AS part FROM {table} WHERE {column} IS NOT NULL"
    return f"SELECT DISTINCT max(v) AS cut FROM ({numbered}) t GROUP BY part"


def range_predicates(column: str, cuts: Sequence[object]) -> list[str]:
    """Conditions that share out all rows at ``cuts`` (in order, the last part open); nulls go to the first."""
    if not cuts:
        return [f"{column} IS NULL OR {column} IS NOT NULL"]
    inner = [f"{column} > {low} AND {column} <= {high}" for low, high in zip(cuts, cuts[1:])]
    return [f"{column} <= {cuts[0]} OR {column} IS NULL", *inner, f"{column} > {cuts[-1]}"]
