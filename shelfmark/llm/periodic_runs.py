"""Runs of repeated words: all maximal periodic stretches of every text.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), of at least 24 words and three periods, that no neighbouring
word extends. All periods up to a third of a text are tried. A run of period q
holds a grid point i of step ``max(24, 3q) - q`` together with i + q, so the
points of all grids, about n log n of n words, find every run: from a point the
stretch reaches as far as the words after i and i + q agree, and those before.

How far they agree is the longest common extension (LCE) of two suffixes. Only
suffixes at places of a difference cover modulo 31 are sorted, by names of their
first 31, 62, 124, ... words. Any two places reach such a pair of synchronised
samples within 30 words; these few words are compared, and the rest is the least
common prefix between the samples' ranks, read from a sparse table.

Grid points with fewer than 8 equal words on either side lie in no run, so texts
without any other point are never sorted. Texts of a batch are sorted together,
divided by words that occur nowhere else. Each row is read where it lies, whole;
nothing is shuffled. Memory follows a block of words, or the longest text.

Defined cases: a null or blank text has no words and no runs; repeated rows get
equal results; a null doc_id is kept; an empty table gives none; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import blank_words, bounded_batches, in_blocks, ragged_ranges, texts

# What counts as a run.
LEAST = 24
TIMES = 3

# Every difference modulo 31 occurs between two of these.
CYCLE = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
# Around a grid point of period q, a run agrees for a step of the grid, 16 words or more, so on one side for half of that.
HALF = 8
POINTS = 1 << 20
BLOCK_WORDS = 1 << 18
ROWS = 1 << 16

SPANS = "array<struct<start:long,length:long,period:long>>"
Edit = Callable[[object, list[bytes]], list[bytes]]


def _to_samples() -> np.ndarray:
    """For places i and j, by i % 31 and (j - i) % 31: after how many words both are samples."""
    sampled = np.isin(np.arange(CYCLE), COVER)
    place = np.arange(CYCLE)
    first, gap, ahead = place[:, None, None], place[None, :, None], place[None, None, :]
    both = sampled[(first + ahead) % CYCLE] & sampled[(first + gap + ahead) % CYCLE]
    return both.argmax(axis=2)


AHEAD = _to_samples()
SLOT = np.searchsorted(COVER, np.arange(CYCLE))


def agreeing(codes: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words from ``i`` and ``j`` on are equal, counted up to ``limit``."""
    found = limit.copy()
    live = np.flatnonzero(limit > 0)
    step = 0
    while len(live):
        differ = codes[i[live] + step] != codes[j[live] + step]
        found[live[differ]] = step
        step += 1
        live = live[~differ]
        live = live[limit[live] > step]
    return found


class Extensions:
    """Longest common extensions of suffixes of ``codes``, whose last word occurs once."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.codes = np.concatenate((codes, np.full(CYCLE, codes[-1], codes.dtype)))
        at = (np.arange(-(-n // CYCLE))[:, None] * CYCLE + COVER).ravel()
        at = at[at < n]
        heads = np.lib.stride_tricks.sliding_window_view(self.codes, CYCLE)[at]
        m = len(at)
        names = [self._named(heads.view(np.dtype((np.void, heads.itemsize * CYCLE))).ravel())]
        # The suffix one cycle on is the sample len(COVER) places on.
        shift = len(COVER)
        while names[-1].max(initial=0) + 1 < m:
            later = np.zeros(m, np.int64)
            later[: max(m - shift, 0)] = names[-1][shift:] + 1
            names.append(self._named(names[-1] * (m + 1) + later))
            shift *= 2
        self.rank = names.pop()
        self.table = self._least(self._common(heads, names))

    @staticmethod
    def _named(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1].astype(np.int64)

    def _common(self, heads: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sampled suffix and the next in order."""
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int32)
        # Equal names never hold the last word, so the samples after them exist.
        for level in range(len(names) - 1, -1, -1):
            same = np.flatnonzero(names[level][a] == names[level][b])
            a[same] += len(COVER) << level
            b[same] += len(COVER) << level
            common[same] += CYCLE << level
        for at in range(0, len(a), ROWS):
            part = slice(at, at + ROWS)
            common[part] += (heads[a[part]] != heads[b[part]]).argmax(axis=1).astype(np.int32)
        return common

    @staticmethod
    def _least(common: np.ndarray) -> np.ndarray:
        """Row k, column x: the least of 2 ** k values from x on."""
        rows = max(len(common).bit_length(), 1)
        table = np.zeros((rows, len(common)), np.int32)
        table[0] = common
        for k in range(1, rows):
            half = 1 << (k - 1)
            width = len(common) - 2 * half + 1
            table[k, :width] = np.minimum(table[k - 1, :width], table[k - 1, half : half + width])
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ahead = AHEAD[i % CYCLE, (j - i) % CYCLE]
        found = agreeing(self.codes, i, j, ahead)
        reached = np.flatnonzero(found == ahead)
        i, j = i[reached] + ahead[reached], j[reached] + ahead[reached]
        x, y = (self.rank[k // CYCLE * len(COVER) + SLOT[k % CYCLE]] for k in (i, j))
        low, high = np.minimum(x, y), np.maximum(x, y)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        found[reached] += np.minimum(self.table[k, low], self.table[k, high - (1 << k.astype(np.int64))])
        return found


def joined(texts_codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each between words of its own, and where each begins."""
    parts = []
    for number, codes in enumerate(texts_codes):
        parts += [np.array([-1 - number], np.int32), codes]
    parts.append(np.array([-1 - len(texts_codes)], np.int32))
    sizes = np.array([len(codes) + 1 for codes in texts_codes], np.int64)
    return np.concatenate(parts), np.cumsum(sizes) - sizes + 1


def grid(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, place and period of all grid points, in bounded pieces."""
    most = np.where(lengths >= LEAST, lengths // TIMES, 0)
    text = np.repeat(np.arange(len(lengths)), most)
    period = ragged_ranges(np.ones_like(most), most)
    step = np.maximum(LEAST, TIMES * period) - period
    count = -(-(lengths[text] - period) // step)
    ends = np.cumsum(count)
    first = 0
    while first < len(text):
        before = ends[first] - count[first]
        last = max(first + 1, int(np.searchsorted(ends, before + POINTS, "right")))
        part, n = slice(first, last), count[first:last]
        place = ragged_ranges(np.zeros_like(n), n) * np.repeat(step[part], n) + np.repeat(starts[text[part]], n)
        yield np.repeat(text[part], n), place, np.repeat(period[part], n)
        first = last


def repeating(codes: np.ndarray, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which grid points may lie in a run: those with ``HALF`` equal words after or before them."""
    near = np.flatnonzero(codes[place] == codes[place + period])
    i, j = place[near], place[near] + period[near]
    limit = np.full(len(near), HALF)
    after = agreeing(codes, i, j, limit) == HALF
    before = agreeing(codes[::-1], len(codes) - i, len(codes) - j, limit) == HALF
    return near[after | before]


def runs(texts_codes: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, start, length and period of its runs, one a row, by start and period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts_codes)
    codes, starts = joined(texts_codes)
    lengths = np.array([len(one) for one in texts_codes], np.int64)
    some = np.zeros(len(texts_codes), bool)
    for text, place, period in grid(lengths, starts):
        some[text[repeating(codes, place, period)]] = True
    chosen = np.flatnonzero(some)
    if not len(chosen):
        return out
    codes, starts = joined([texts_codes[k] for k in chosen])
    n = len(codes)
    after, before = Extensions(codes), Extensions(codes[::-1])
    found = []
    for text, place, period in grid(lengths[chosen], starts):
        near = repeating(codes, place, period)
        text, i, period = text[near], place[near], period[near]
        back = before(n - i, n - i - period)
        length = period + back + after(i, i + period)
        held = length >= np.maximum(LEAST, TIMES * period)
        rows = np.stack((text, i - back - starts[text], length, period), axis=1)[held]
        found.append(np.unique(rows, axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    # One stretch under several periods: all are multiples of the smallest, which comes first.
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :3] != every[:-1, :3]).any(axis=1)
    every = every[first]
    every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
    numbers = np.unique(every[:, 0])
    begin, end = (np.searchsorted(every[:, 0], numbers, side) for side in ("left", "right"))
    for number, a, b in zip(numbers, begin, end, strict=True):
        out[chosen[number]] = every[a:b, 1:]
    return out


def coded(words: list[bytes], numbers: defaultdict) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words joined by blanks, of each run only the first period."""
    if len(found):
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, found[:, 0] + found[:, 2], 1)
        np.add.at(drop, found[:, 0] + found[:, 1], -1)
        words = [word for word, hidden in zip(words, np.cumsum(drop).tolist(), strict=False) if not hidden]
    return b" ".join(words)


def periodic_runs(documents: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, ``runs`` (start, length, period; by start, then period) and ``text`` without the runs' repeats.

    ``edit``, if given, takes a doc_id and its words and returns the words to look at.
    """
    bounded_batches(documents.sparkSession)
    source = documents.select("doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("text", T.StringType()),
        ]
    )

    def find(batches):
        for batch in batches:
            ids = batch.column(0)
            rows = zip(ids.to_pylist(), map(blank_words, texts(batch.column(1))), strict=True)
            worded = ((doc_id, edit(doc_id, words) if edit else words) for doc_id, words in rows)
            for block in in_blocks(worded, lambda row: len(row[1]) + 1, BLOCK_WORDS):
                numbers: defaultdict = defaultdict()
                numbers.default_factory = numbers.__len__
                found = runs([coded(words, numbers) for _, words in block])
                kept = [collapsed(words, one) for (_, words), one in zip(block, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id for doc_id, _ in block], ids.type),
                        pa.array([one.tolist() for one in found], pa.list_(pa.list_(pa.int64()))),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=schema.names,
                )

    spans = F.transform("runs", lambda r: F.struct(*(r[k].alias(name) for k, name in enumerate(("start", "length", "period")))))
    return source.mapInArrow(find, schema).select("doc_id", spans.cast(SPANS).alias("runs"), "text")


def strongest(spans: Column) -> Column:
    """The run of the greatest exact length / period, the first of equal ones; null if there is none."""

    def better(best: Column, one: Column) -> Column:
        return F.when(one["length"] * best["period"] > best["length"] * one["period"], one).otherwise(best)

    return F.aggregate(spans, F.get(spans, 0), better)


def repeated_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The query's own words: of every tenth document, by a checksum of its id, the end becomes periodic."""
    if doc_id is None or not words:
        return words
    checksum = zlib.crc32(str(doc_id).encode())
    if checksum % 10:
        return words
    n, more = len(words), checksum // 10
    start = more % n
    period = 1 + (n - start) // (3 + more % 8)
    unit = words[start : start + period]
    return (words[:start] + unit * -(-(n - start) // period))[:n]


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeated_tail)
    best = strongest(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return (
        found.withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            "best.start",
            "best.length",
            "best.period",
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
