"""Tables kept in files by ranges of a key, in numbered versions.

A file is never changed once written. A version is a small table of the files
that belong to it, one row per file with the smallest and largest key and the
number of rows, and is put in place by one rename: whoever reads the version
before goes on seeing it whole, and a write that fails on the way leaves nothing
but files no version names.

Rows are deleted without rewriting their file: a bitmap per file says which of
its rows are gone, and is applied when the file is read. :meth:`Version.compacted`
writes such files anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.catalog import Catalog
from shelfmark.functions.bits import bit_words, is_set_in
from shelfmark.functions.sizing import is_small, sent_if_small, settled
from shelfmark.functions.tables import stacked
from shelfmark.sources.folders import kept, listed, put_in_place

ROWS_PER_FILE = 5_000_000
ROWS_PER_TASK = 1_000_000

ENTRIES = (
    "table string, file string, low string, high string, rows long, deletes string, deleted long, "
    "order_by string, schema string"
)
BITMAPS = "deletes string, file string, bucket long, bitmap binary"


@dataclass(frozen=True)
class Head:
    """A table's schema, and the columns its files are sorted by; the first is its key."""

    order: tuple[str, ...]
    schema: T.StructType

    @property
    def key(self) -> str:
        return self.order[0]

    @property
    def key_type(self) -> T.DataType:
        return self.schema[self.key].dataType


@dataclass(frozen=True)
class Store:
    """Versions of a set of tables below ``root``, a folder all executors share."""

    spark: SparkSession
    root: str

    def versions(self) -> list[int]:
        return [int(name) for name in listed(self.spark, f"{self.root}/versions")]

    def open(self, number: int | None = None) -> "Version":
        """A version, the latest by default; version 0 holds nothing."""
        if number is None:
            number = max(self.versions(), default=0)
        if number == 0:
            return Version(self, 0, {}, {})
        found = self.spark.read.schema(ENTRIES).parquet(self._path(number))
        heads = {
            row["table"]: Head(tuple(row["order_by"].split(",")), T._parse_datatype_json_string(row["schema"]))
            for row in found.where("file IS NULL").collect()  # one row per table
        }
        files = {name: found.where((F.col("table") == name) & F.col("file").isNotNull()).select(*_FILE) for name in heads}
        return Version(self, number, heads, files)

    def _path(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}"

    def write(self, table: str, df: DataFrame, head: Head, files: int | None = None, labels: str | None = None) -> DataFrame:
        """The entries of ``df`` written to new files.

        Rows are dealt by ranges of all order columns, so a hot key is cut into
        several files: ``files`` of them, and more where one would get over
        ``ROWS_PER_TASK`` rows, so that no task sorts more as a table grows. With
        ``labels``, the name of a column, each label has files of its own instead.
        """
        folder, names = f"{self.root}/data/{table}/{uuid.uuid4().hex}", head.schema.fieldNames()
        if labels:
            dealt = df.select(*names, labels).repartition(labels).sortWithinPartitions(labels, *head.order)
        else:
            # The ranges are found by a look at all rows, so they are computed once before.
            rows = kept(df.select(*names), table)
            least = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            parts = -(-rows.count() // ROWS_PER_TASK)
            number = [max(files or 0, parts)] if files or parts > least else []
            dealt = rows.repartitionByRange(*number, *head.order).sortWithinPartitions(*head.order)
        writer = dealt.write.option("maxRecordsPerFile", ROWS_PER_FILE)
        (writer.partitionBy(labels) if labels else writer).parquet(folder)
        back = self.spark.read.schema(head.schema).parquet(folder)
        return (
            back.groupBy(_file_name().alias("file"))
            .agg(
                F.min(head.key).cast("string").alias("low"),
                F.max(head.key).cast("string").alias("high"),
                F.count("*").alias("rows"),
            )
            .select(
                F.lit(table).alias("table"),
                "file",
                "low",
                "high",
                "rows",
                F.lit(None).cast("string").alias("deletes"),
                F.lit(0).cast("long").alias("deleted"),
            )
        )


_FILE = ("table", "file", "low", "high", "rows", "deletes", "deleted")


def _file_name() -> Column:
    """Files are named by their path below the folder of all data, so a store can be moved as a whole."""
    return F.substring_index("_metadata.file_path", "/data/", -1)


@dataclass(frozen=True)
class Version:
    """One state of all tables. Changes give a new state, seen by others once it is :meth:`put`."""

    store: Store
    number: int
    heads: Mapping[str, Head]
    entries: Mapping[str, DataFrame] = field(repr=False)

    def put(self) -> "Version":
        """Make this state the next version; an error if another one was put since it was opened."""
        spark, number = self.store.spark, self.number + 1
        heads = spark.createDataFrame(
            [(name, ",".join(head.order), head.schema.json()) for name, head in self.heads.items()],
            "table string, order_by string, schema string",
        )
        prepared = f"{self.store.root}/prepared/{uuid.uuid4().hex}"
        files = stacked(list(self.entries.values())) if self.entries else spark.createDataFrame([], ENTRIES)
        every = files.unionByName(heads, allowMissingColumns=True)
        every.coalesce(1).write.parquet(prepared)  # one row per file
        put_in_place(spark, prepared, self.store._path(number))
        return self.store.open(number)

    def files(self, table: str) -> DataFrame:
        return self.entries[table]

    def catalog(self) -> Catalog:
        return Catalog(**{name: partial(self.read, name) for name in self.heads})

    def with_files(self, table: str, files: DataFrame) -> "Version":
        """This state with ``files`` as all the files of ``table``."""
        return replace(self, entries={**self.entries, table: settled(files)})

    def with_table(self, table: str, df: DataFrame, order: Sequence[str], files: int | None = None) -> "Version":
        """This state with ``df`` as the whole of ``table``."""
        head = Head(tuple(order), df.schema)
        state = replace(self, heads={**self.heads, table: head})
        return state.with_files(table, self.store.write(table, df, head, files))

    def with_rows(self, table: str, df: DataFrame, files: int | None = None) -> "Version":
        """This state with the rows of ``df`` added to ``table`` in files of their own."""
        return self.with_files(table, self.files(table).unionByName(self.store.write(table, df, self.heads[table], files)))

    # Reading

    def touched(self, table: str, keys: DataFrame) -> DataFrame:
        """The files that may hold a row whose key is in ``keys`` (its one column); all of them for many keys."""
        kind, files = self.heads[table].key_type, self.files(table)
        keys = keys.select(F.col(keys.columns[0]).alias("_key")).where("_key IS NOT NULL").distinct()
        if not is_small(keys):
            return files
        inside = F.col("_key").between(F.col("low").cast(kind), F.col("high").cast(kind))
        return files.join(F.broadcast(keys), inside, "left_semi")

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """The rows of ``table``; with ``keys``, those of the files that may hold one of them."""
        return self.rows(table, self.files(table) if keys is None else self.touched(table, keys))

    def rows(self, table: str, files: DataFrame, marked: bool = False) -> DataFrame:
        """The rows of some of a table's files, without the deleted ones.

        With ``marked``, ``_file`` and ``_row`` say where each row lies. The
        names of the files pass through the driver, as for any read of files.
        """
        schema, spark = self.heads[table].schema, self.store.spark
        marks = [_file_name().alias("_file"), F.col("_metadata.row_index").alias("_row")]
        whole, holed = [], []
        for row in files.select("file", "deletes").collect():
            (whole if row["deletes"] is None else holed).append(f"{self.store.root}/data/{row['file']}")
        parts = []
        if whole:
            found = spark.read.schema(schema).parquet(*whole)
            parts.append(found.select("*", *marks) if marked else found)
        if holed:
            found = spark.read.schema(schema).parquet(*holed).select("*", *marks)
            bitmaps = self.bitmaps(files)
            words = bitmaps.select("file", "bucket", bit_words(F.col("bitmap")).alias("bitmap"))
            left = _without(found, F.broadcast(words) if is_small(bitmaps) else words)
            parts.append(left if marked else left.drop("_file", "_row"))
        if not parts:
            marks = [T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())] if marked else []
            parts.append(spark.createDataFrame([], T.StructType([*schema.fields, *marks])))
        return stacked(parts)

    def bitmaps(self, files: DataFrame) -> DataFrame:
        """``file``, ``bucket`` and ``bitmap`` of the deleted rows of ``files``."""
        folders = [row["deletes"] for row in files.where("deletes IS NOT NULL").select("deletes").distinct().collect()]
        if not folders:
            return self.store.spark.createDataFrame([], BITMAPS).drop("deletes")
        found = self.store.spark.read.schema(BITMAPS).parquet(*(f"{self.store.root}/deletes/{name}" for name in folders))
        # A folder may tell of files whose bitmap has been replaced since.
        return found.join(files.select("deletes", "file"), ["deletes", "file"], "left_semi").drop("deletes")

    # Changing

    def without(self, table: str, places: DataFrame) -> "Version":
        """This state without the rows at ``places`` (``_file`` and ``_row``); no data file is written."""
        if places.isEmpty():
            return self
        files, name = self.files(table), uuid.uuid4().hex
        folder = f"{self.store.root}/deletes/{name}"
        at = F.col("_row") + 1
        fresh = places.groupBy(F.col("_file").alias("file"), F.bitmap_bucket_number(at).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")
        )
        fresh = settled(fresh)
        hit = fresh.select("file").distinct()
        before = self.bitmaps(files.join(hit, "file", "left_semi"))
        (
            fresh.unionByName(before)
            .groupBy("file", "bucket")
            .agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            .select(F.lit(name).alias("deletes"), "file", "bucket", "bitmap")
            .write.parquet(folder)
        )
        gone = (
            self.store.spark.read.schema(BITMAPS)
            .parquet(folder)
            .groupBy("file")
            .agg(F.first("deletes").alias("_deletes"), F.sum(F.bitmap_count("bitmap")).alias("_deleted"))
        )
        marked = files.join(gone, "file", "left").select(
            *_FILE[:-2],
            F.coalesce("_deletes", "deletes").alias("deletes"),
            F.coalesce("_deleted", "deleted").alias("deleted"),
        )
        return self.with_files(table, marked)

    def compacted(self, table: str) -> "Version":
        """This state with the files of ``table`` that have deleted rows written anew."""
        files = self.files(table)
        holed = files.where("deleted > 0")
        if holed.isEmpty():
            return self
        rows = self.rows(table, holed, marked=True)
        fresh = self.store.write(table, rows.withColumn("_part", F.xxhash64("_file")), self.heads[table], labels="_part")
        return self.with_files(table, files.where("deleted = 0").unionByName(fresh))

    def ranges(self, table: str) -> DataFrame:
        """The files with ``_from`` and ``_to``: every key lies in one such range, of the last file that begins at or before it."""
        low = F.col("low").cast(self.heads[table].key_type)
        starts = self.files(table).where("low IS NOT NULL").groupBy(low.alias("_low")).agg(F.max("file").alias("file"))
        # One row per file.
        by = Window.orderBy("_low")
        return starts.select(
            "file",
            F.when(F.lag("_low").over(by).isNotNull(), F.col("_low")).alias("_from"),
            F.lead("_low").over(by).alias("_to"),
        )


def within(key: Column) -> Column:
    """Whether ``key`` lies in a range of :meth:`Version.ranges`."""
    after = F.col("_from").isNull() | (key >= F.col("_from"))
    return after & (F.col("_to").isNull() | (key < F.col("_to")))


def _without(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``rows`` (with marks) less those whose bit is set; bitmaps are given as words."""
    at = F.col("_row") + 1
    held = bitmaps.withColumnsRenamed({"file": "_file", "bucket": "_bucket", "bitmap": "_bitmap"})
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).join(held, ["_file", "_bucket"], "left")
    return joined.where(~is_set_in(F.col("_bitmap"), F.bitmap_bit_position(at))).select(*rows.columns)
