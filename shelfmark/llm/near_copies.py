"""One row of each group of near copies, by exact similarity of five-word shingles.

Two texts are near copies when their sets of shingles of five words have a
Jaccard similarity of 0.8 or more; groups are what such links connect. A text
of fewer words is one shingle.

Candidates come from MinHash: each set has 32 bands of 6 minima, and sets that
share a band belong to one cluster. At similarity 0.8 a pair shares no band with
probability (1 - 0.8 ** 6) ** 32 = 0.00006, and less above. Clusters only say
what is compared: every link is checked on the whole sets. Members near the
cluster's root are settled by that one check. Every other member is a home, and
is compared with all members of the cluster. A large cluster is cut into cells
of bounded rows and bytes, each with some homes and some members, so that no
task has more than its share of the pairs.

Equal sets count once, under a key of 64 bits, so rows take the result of
theirs. Memory of a task is bounded by a cell's homes and one batch.

Defined cases: null and blank texts are copies of each other; a null doc_id
takes part with its text but is never the smallest id and never dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.sizing import sent_if_small
from shelfmark.llm.common import LOWER_TABLE, blank_words, bounded_batches, ragged_ranges, texts, unused, written
from shelfmark.llm.components import linked_to

WORDS = 5
SEED = 42
BANDS = 32
MINIMA = 6
SLICE = 512
HOME_BYTES = 16 * 1024 * 1024
HOME_ROWS, REPLICA_ROWS = 1024, 2048

_random = np.random.default_rng(SEED)
MIX = _random.integers(0, 2**64, (BANDS * MINIMA, 1), dtype=np.uint64)
SPREAD = _random.integers(0, 2**64, (BANDS * MINIMA, 1), dtype=np.uint64) | np.uint64(1)
JOIN = _random.integers(0, 2**64, (BANDS, MINIMA), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """XXH64 of every distinct shingle of five words, in order."""
    words = blank_words(text.translate(LOWER_TABLE))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = list(accumulate((len(word) + 1 for word in words), initial=0))
    cut = [joined[a : b - 1] for a, b in zip(starts, starts[WORDS:], strict=False)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut)))


def bands(found: np.ndarray) -> np.ndarray:
    """The bands of a set; none of an empty one."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SLICE):
        mixed = (found[at : at + SLICE] ^ MIX) * SPREAD
        least = np.minimum(least, mixed.min(axis=1))
    return (least.reshape(BANDS, MINIMA) * JOIN).sum(axis=1, dtype=np.uint64).view(np.int64)


def is_near(common, one, other):
    """Whether sets of the sizes ``one`` and ``other`` have a similarity of 0.8 or more."""
    return 9 * common >= 4 * (one + other)


def sets(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, key, bands and the shingles (8 bytes each) of every row."""
    bounded_batches(documents.sparkSession)
    source = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = T.StructType(
        [
            *source.schema.fields[:2],
            T.StructField("key", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("shingles", T.BinaryType()),
        ]
    )

    def cut(batches):
        for batch in batches:
            found = [shingles(text) for text in texts(batch.column(2))]
            held = [one.astype("<u8").tobytes() for one in found]
            keys = np.array([xxhash.xxh64_intdigest(one, SEED) for one in held], np.uint64).view(np.int64)
            columns = [pa.array(keys), pa.array([bands(one) for one in found], pa.list_(pa.int64())), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=schema.names)

    return source.mapInArrow(cut, schema)


def clusters(found: DataFrame) -> DataFrame:
    """key and root of every set that shares a band with another, over any number of steps."""
    banded = found.select("key", F.explode("bands").alias("band"))
    shared = (
        banded.groupBy("band")
        .agg(F.min("key").alias("least"), F.max("key").alias("most"))
        .where("least <> most")
        .select("band", "least")
    )
    roots = written(linked_to(banded.join(shared, "band").select(F.col("key").alias("a"), F.col("least").alias("b"))), "clusters")
    return written(
        roots.select(F.col("node").alias("key"), "root").unionByName(roots.select(F.col("root").alias("key"), "root").distinct()),
        "members",
    )


def near_root(members: DataFrame) -> DataFrame:
    """key, root and near (to the root's set) of the members other than the root."""
    lead = members.where("key = root").select("root", F.col("shingles").alias("lead"))
    pairs = members.where("key <> root").join(sent_if_small(written(lead, "leads")), "root").select("key", "root", "shingles", "lead")

    def check(batches):
        for batch in batches:
            near = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                one, other = np.frombuffer(one.as_buffer(), "<u8"), np.frombuffer(other.as_buffer(), "<u8")
                common = len(np.intersect1d(one, other, assume_unique=True))
                near.append(is_near(common, len(one), len(other)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near, pa.bool_())], names=["key", "root", "near"])

    return pairs.mapInArrow(check, "key long, root long, near boolean")


class Homes:
    """Sets to compare others with, and what has been linked among them."""

    def __init__(self):
        self.keys: list[int] = []
        self.held: list[np.ndarray] = []
        self.index = None

    def add(self, key: int, found: np.ndarray) -> None:
        self.keys.append(key)
        self.held.append(found)

    def close(self) -> None:
        values = np.concatenate(self.held)
        owner = np.repeat(np.arange(len(self.keys)), [len(one) for one in self.held])
        order = np.argsort(values, kind="stable")
        self.index, self.owner = values[order], owner[order]
        self.sizes = np.array([len(one) for one in self.held])
        self.label = np.arange(len(self.keys))

    def links(self, key: int, found: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect the set with all homes near it, none twice."""
        first, last = np.searchsorted(self.index, found, "left"), np.searchsorted(self.index, found, "right")
        places = ragged_ranges(first, last - first)
        common = np.bincount(self.owner[places], minlength=len(self.keys))  # a set holds a shingle once
        near = np.flatnonzero(is_near(common, self.sizes, len(found)))
        labels = np.unique(self.label[near])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
        return [(key, self.keys[home]) for home in labels.tolist() if self.keys[home] != key]


def linked_homes(batches):
    """Links of (root, home block, replica block, replica, key, shingles), in order: homes lead each cell."""
    cell, homes = None, None
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        columns = [column.to_pylist() for column in batch.columns]
        for *at, replica, key, held in zip(*columns, strict=True):
            if at != cell:
                cell, homes = at, Homes()
            found = np.frombuffer(held, "<u8")
            if not replica:
                homes.add(key, found)
                continue
            if not homes.keys:  # no home's hash fell into this cell
                continue
            if homes.index is None:
                homes.close()
            for one, other in homes.links(key, found):
                a.append(one)
                b.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(found: DataFrame, home_bytes: int = HOME_BYTES) -> DataFrame:
    """Links (a, b) that connect keys as all pairs of a similarity of 0.8 or more would."""
    cluster = clusters(found)
    members = written(
        found.select("key", "shingles")
        .join(sent_if_small(cluster), "key")
        .groupBy("key", "root")
        .agg(F.first("shingles").alias("shingles")),
        "candidates",
    )
    checked = written(near_root(members), "checked")
    marked = members.join(checked.where("not near").select("key", F.lit(1).alias("home")), "key", "left")
    size, home = F.length("shingles"), F.coalesce("home", F.lit(0))

    def pieces(rows, content, limit):
        return F.greatest(F.ceil(rows / limit), F.ceil(content / home_bytes), F.lit(1)).cast("int")

    cut = (
        marked.groupBy("root")
        .agg(
            F.max(home).alias("homes"),
            pieces(F.sum(home), F.sum(home * size), HOME_ROWS).alias("home_blocks"),
            pieces(F.count("*"), F.sum(size), REPLICA_ROWS).alias("replica_blocks"),
        )
        .where("homes > 0")
    )
    placed = marked.join(sent_if_small(written(cut, "cells")), "root")
    own = F.pmod(F.xxhash64("key"), "home_blocks").cast("int")
    other = F.pmod(F.xxhash64("key", F.lit(SEED)), "replica_blocks").cast("int")

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    homes = placed.where("home = 1").select(
        "root", own.alias("home_block"), every("replica_blocks").alias("replica_block"), F.lit(False).alias("replica"), "key", "shingles"
    )
    # Homes are replicas too, so they meet each other, within a cell and across.
    replicas = placed.select(
        "root", every("home_blocks").alias("home_block"), other.alias("replica_block"), F.lit(True).alias("replica"), "key", "shingles"
    )
    cell = ["root", "home_block", "replica_block"]
    dealt = homes.unionByName(replicas).repartition(*cell).sortWithinPartitions(*cell, "replica", "key")
    among = dealt.mapInArrow(linked_homes, "a long, b long")
    return checked.where("near").select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(among)


def linked_keys(found: DataFrame, components: DataFrame) -> DataFrame:
    """Links (a, b) of keys from ``components`` (text_hash and component, the hash of one of its texts)."""
    keys = written(found.select("text_hash", "key").distinct(), "keys")
    apart = components.where("text_hash <> component").distinct()
    ends = apart.join(keys.withColumnRenamed("key", "a"), "text_hash").drop("text_hash")
    return ends.join(keys.select(F.col("text_hash").alias("component"), F.col("key").alias("b")), "component").select("a", "b")


def copies(documents: DataFrame, home_bytes: int = HOME_BYTES, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, text_hash, key and group (a key) of every row; near copies share the group.

    ``also`` adds links of another method: from rows with a doc_id and a text it
    gives the doc_id and the component_id (a doc_id) of each.
    """
    found = written(sets(documents), "shingles")
    pairs = links(found, home_bytes)
    if also is not None:
        # Texts are named by their hash here, as a doc_id may be null or have several texts.
        named = also(documents.select(F.xxhash64("text").alias("doc_id"), "text"))
        pairs = pairs.unionByName(linked_keys(found, named.select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("component"))))
    roots = written(linked_to(pairs), "roots").withColumnRenamed("node", "key")
    return written(
        found.select("doc_id", "text_hash", "key")
        .join(sent_if_small(roots), "key", "left")
        .select("doc_id", "text_hash", "key", F.coalesce("root", "key").alias("group")),
        "groups",
    )


def one_of_each(documents: DataFrame, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``documents`` with one row of each group of near copies: that of the smallest doc_id.

    Groups are what the links of :func:`copies` connect, those of ``also`` among them.

    Of a group's rows under that doc_id the first by hash of the text stays, once.
    Different texts under one doc_id are as different as under two. Rows without
    a doc_id stay, as no decision can name them.
    """
    lost, hashed, place = (unused(documents, name) for name in ("_lost", "_hashed", "_place"))
    named = copies(documents.select("doc_id", "text"), also=also).where("doc_id is not null")
    row = F.struct("doc_id", "text_hash")
    first = named.groupBy("group").agg(F.min(row).alias("first"))
    distinct = named.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    placed = written(distinct.join(first, "group").select("doc_id", "text_hash", "n", (row == F.col("first")).alias("stays")), "placed")

    def listed(which: str) -> DataFrame:
        return sent_if_small(placed.where(which).select(F.col("doc_id").alias(lost), F.col("text_hash").alias(hashed)))

    same = (documents["doc_id"] == F.col(lost)) & (F.xxhash64(documents["text"]) == F.col(hashed))
    kept = documents.join(listed("not stays"), same, "left_anti")
    if placed.where("stays and n > 1").isEmpty():
        return kept
    again = listed("stays and n > 1")
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")
    once = kept.join(again, same, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return kept.join(again, same, "left_anti").unionByName(once.select(*documents.columns))
