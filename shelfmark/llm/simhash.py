"""SimHash near-duplicates by covering a fingerprint's halves with anchor points.

Fingerprints of 64 bits link when at most 3 bits differ. Then one of the two
halves of 32 bits differs in at most one bit. The anchors of a half are the
words of the [31, 26] Hamming code with one free bit: every half lies within
radius 1 of exactly one anchor, its home. A half is replicated to every anchor
within radius plus threshold, 1 + 1, so any two halves that differ in one bit
meet at the home of either. Comparing homes with replicas per anchor therefore
finds every link.

Copies count once: distinct fingerprints are linked, and documents take the
result of theirs. An anchor that is home to many fingerprints is cut into
blocks of homes, each compared with all replicas in a task of its own; replicas
stream past the homes, so memory stays bounded. Each task reports its links as
stars, at most one link per fingerprint, never all pairs.

Defined cases: a null or blank text has fingerprint zero and links like any
other; repeated rows get equal results; a null doc_id takes part with its text
but is never the smallest id (a component of such rows alone has null).
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.sizing import sent_if_small, settled
from shelfmark.llm.common import (
    LOWER_TABLE,
    blank_words,
    bounded_batches,
    first_of_runs,
    ragged_ranges,
    smallest_reachable,
    texts,
    written,
)
from shelfmark.llm.components import linked_to
from shelfmark.llm.near_copies import one_of_each  # noqa: F401

WORDS = 3
SEED = 42
BITS = 3
HOMES = 2048
BUFFER_ROWS = 200_000
PAIRS = 2_000_000
SLICE = 65536

# Parity positions of every byte of a half: the syndrome of its bits 1 to 31.
SYNDROME = np.zeros((4, 256), np.uint8)
for _bit in range(31):
    _set = np.flatnonzero(np.arange(256) >> (_bit % 8) & 1)
    SYNDROME[_bit // 8, _set] ^= _bit + 1


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of three words, repeats included."""
    words = blank_words(text.translate(LOWER_TABLE))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = list(accumulate((len(word) + 1 for word in words), initial=0))
    shingles = [joined[a : b - 1] for a, b in zip(starts, starts[WORDS:], strict=False)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def fingerprint(text: bytes) -> int:
    """The bits set in over half the hashes; zero without a word."""
    hashes = shingle_hashes(text)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    bounded_batches(documents.sparkSession)
    source = documents.select("doc_id", "text")
    schema = T.StructType(
        [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("fp", T.LongType())]
    )

    def hashed(batches):
        for batch in batches:
            values = pa.array([fingerprint(text) for text in texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "fp"])

    return source.mapInArrow(hashed, schema)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints: the index and the anchor of every replica, homes first.

    An anchor is its half's number in bit 32 and the code word below it.
    """
    index, anchor = [], []
    for half in (0, 1):
        part = (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
        octets = part.astype("<u4").view(np.uint8).reshape(-1, 4)
        syndrome = np.bitwise_xor.reduce([SYNDROME[k][octets[:, k]] for k in range(4)]).astype(np.int64)
        flip = np.where(syndrome > 0, np.left_shift(1, np.maximum(syndrome, 1) - 1), 0)
        home = part.astype(np.int64) ^ flip
        every = np.arange(len(part))
        found = [(every, home), (every, home ^ (1 << 31))]
        for first in range(1, 32):
            second = first ^ syndrome
            some = np.flatnonzero((syndrome > 0) & (second > first))
            change = (1 << (first - 1)) ^ np.left_shift(1, second[some] - 1)
            found.append((some, part[some].astype(np.int64) ^ change))
        index += [i for i, _ in found]
        anchor += [a + (half << 32) for _, a in found]
    return np.concatenate(index), np.concatenate(anchor)


def homes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two homes of every fingerprint."""
    index, anchor = anchors(fps)
    own = is_home(fps[index], anchor)
    return index[own], anchor[own]


def is_home(fps: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    half = fps.view(np.uint64) >> ((anchor >> 32).astype(np.uint64) * np.uint64(32))
    apart = (half & np.uint64(0xFFFFFFFF)) ^ (anchor.view(np.uint64) & np.uint64(0xFFFFFFFF))
    return (np.bitwise_count(apart) <= 1) & (apart >> np.uint64(31) == 0)


def local_links(group: np.ndarray, fps: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what links within the groups; homes lead each group."""
    first = first_of_runs(group)
    sizes = np.diff(np.append(first, len(group)))
    n_homes = np.add.reduceat(home.astype(np.int64), first)
    row_first, row_homes = np.repeat(first, sizes), np.repeat(n_homes, sizes)
    rows = np.flatnonzero((row_homes > 0) & (np.repeat(sizes, sizes) > 1))
    left, right = [], []
    work = np.cumsum(row_homes[rows])
    cuts = np.searchsorted(work, np.arange(PAIRS, int(work[-1]) if len(work) else 0, PAIRS))
    for some in np.split(rows, cuts):
        count = row_homes[some]
        one, other = fps[np.repeat(some, count)], fps[ragged_ranges(row_first[some], count)]
        near = (np.bitwise_count((one ^ other).view(np.uint64)) <= bits) & (one != other)
        left.append(one[near])
        right.append(other[near])
    one, other = np.concatenate(left), np.concatenate(right)
    nodes, place = np.unique(np.concatenate((one, other)), return_inverse=True)
    label = smallest_reachable((place[: len(one)], place[len(one) :]), len(nodes))
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def links(distinct: DataFrame, bits: int = BITS, most_homes: int = HOMES) -> DataFrame:
    """Links (a, b) that connect the fingerprints ``distinct.fp`` as all pairs within ``bits`` would."""
    if not 0 <= bits <= 3:
        raise ValueError("two halves cover at most 3 differing bits")
    source = distinct.select("fp")

    def to_anchors(pick):
        def replicate(batches):
            for batch in batches:
                fps = batch.column(0).to_numpy()
                index, anchor = pick(fps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(fps[index]), pa.array(~is_home(fps[index], anchor))],
                    names=["anchor", "fp", "replica"],
                )

        return source.mapInArrow(replicate, "anchor long, fp long, replica boolean")

    crowded = settled(
        to_anchors(homes)
        .groupBy("anchor")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > most_homes)
        .select("anchor", F.ceil(F.col("n") / most_homes).cast("int").alias("blocks"))
    )
    dealt = (
        to_anchors(anchors)
        .join(sent_if_small(crowded), "anchor", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # A home belongs to one block; elsewhere it is a replica like others.
        .withColumn("replica", F.col("replica") | (F.pmod(F.xxhash64("fp"), "blocks") != F.col("block")))
        .select("anchor", "block", "replica", "fp")
        .repartition("anchor", "block")
        .sortWithinPartitions("anchor", "block", "replica", "fp")
    )

    def compare(batches):
        kept: list[np.ndarray] = []
        held = 0
        for batch in batches:
            kept.append(np.stack([column.to_numpy(zero_copy_only=False).astype(np.int64) for column in batch.columns]))
            held += batch.num_rows
            if held >= BUFFER_ROWS:
                rows = np.concatenate(kept, axis=1)
                yield star(rows)
                # The last group may go on: its homes wait for more replicas.
                open_ = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1]) & (rows[2] == 0)
                kept = [rows[:, open_]]
                held = kept[0].shape[1]
        if kept:
            yield star(np.concatenate(kept, axis=1))

    def star(rows):
        change = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)
        group = np.concatenate(([0], np.cumsum(change)))[: rows.shape[1]]
        a, b = local_links(group, np.ascontiguousarray(rows[3]), rows[2] == 0, bits) if len(group) else (rows[3], rows[3])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, bits: int = BITS, most_homes: int = HOMES) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row."""
    prints = written(fingerprints(documents), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = written(linked_to(links(distinct, bits, most_homes)), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    rooted = written(rooted, "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "smallest")
    labels = written(rooted.join(smallest, "root").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
