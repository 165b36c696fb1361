"""Benchmark decontamination with suffix arrays of the training text.

Every task builds suffix arrays over the words of its own documents, a shard at
a time, and binary-searches every suffix of every benchmark item in them. A
suffix of an item that is found with at least a window of words gives all places
of the window; equal windows are searched once. From each place, the longest
verbatim match is found in the same way among the items' own suffixes.

Sparse arrays: only positions from which a window of some item could start are
sorted, that is positions followed by enough words of the benchmark's
vocabulary. All other suffixes cannot match a window, so nothing is lost.

Documents never move. The benchmark is sent in blocks of bounded size, each
searched in every shard.

Defined cases: a null text has no words; an item without words has no window;
an item of fewer words than a window is one window; equal windows of several
items count for each item; repeated rows get equal results, each its own row;
an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import alnum_words, bounded_batches, in_blocks, ragged_ranges, texts

WINDOW = 10
BLOCK_BYTES = 8 * 1024 * 1024
SHARD_BYTES = 16 * 1024 * 1024
NEVER = np.iinfo(np.int32).max
WINDOW_LIMIT = 1 << 20
PLACES = 1 << 16
NAMES = 4096


class Block:
    """Some benchmark items, numbered by word, with the windows they begin."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.ids = ["null" if item is None else str(item) for item, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        coded = [
            [self.vocabulary.setdefault(word, len(self.vocabulary) + 1) for word in alnum_words(text)]
            for _, text in items
        ]
        lengths = np.array([len(words) for words in coded], np.int64)
        self.words = np.array([word for words in coded for word in words], np.int32)
        first = np.cumsum(lengths) - lengths
        self.item = np.repeat(np.arange(len(coded)), lengths)
        self.left = np.repeat(first + lengths, lengths) - np.arange(len(self.words))
        self.window = np.minimum(np.repeat(lengths, lengths), window)
        # Suffixes that are shorter than their item's window cannot begin one.
        begins = np.flatnonzero(self.left >= self.window)
        self.need = np.full(len(self.vocabulary) + 1, NEVER, np.int32)
        np.minimum.at(self.need, self.words[begins], self.window[begins].astype(np.int32))
        self.longest, self.full = int(lengths.max(initial=0)), window
        # Equal windows are searched once; ``items`` has the items of each.
        numbers: dict[bytes, int] = {}
        sizes = self.window[begins].tolist()
        which = [numbers.setdefault(self.words[a : a + n].tobytes(), len(numbers)) for a, n in zip(begins.tolist(), sizes, strict=True)]
        which = np.array(which, np.int64)
        self.begins = begins[np.unique(which, return_index=True)[1]]
        pairs = np.unique(which * max(len(coded), 1) + self.item[begins])
        window_of, item = np.divmod(pairs, max(len(coded), 1))
        self.items = np.split(item, np.searchsorted(window_of, np.arange(1, len(numbers))))
        # The items' own suffixes in order, each item ended by 0: the longest match of any text is read from here.
        ended = [word for words in coded for word in (*words, 0)]
        self.ended = np.array(ended, np.int32)
        self.order = suffix_array(self.ended, self.longest + 1) if ended else np.zeros(0, np.int64)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the words from there on, compared to ``depth`` words."""
    rank = words.astype(np.int64)
    reach = 1
    while True:
        behind = np.zeros_like(rank)
        behind[:-reach] = rank[reach:] if reach < len(rank) else 0
        key = rank * (int(rank.max(initial=0)) + 1) + behind
        order = np.argsort(key)
        ordered = key[order]
        steps = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty_like(rank)
        rank[order] = steps + 1
        reach *= 2
        if reach >= depth or steps[-1] == len(rank) - 1:
            return order


def narrowed(words, order, low, high, depth, wanted):
    """The part of each interval [low, high) whose word at ``depth`` is ``wanted``."""

    def bound(low, high, inclusive):
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            value = words[np.minimum(order[middle] + depth, len(words) - 1)]
            right = value <= wanted[open_] if inclusive else value < wanted[open_]
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]

    start = bound(low, high, False)
    return start, bound(start, high, True)


def found_in_shard(shard: list[bytes], block: Block) -> Iterator[tuple[np.ndarray, ...]]:
    """All places of all windows, in pieces of about ``PLACES`` places.

    Yields arrays (document, word position, window length, number of the window
    among the block's distinct ones) and where the places are in which words.
    """
    counts, coded = [], []
    for text in shard:
        words = alnum_words(text)
        counts.append(len(words))
        coded.append(np.fromiter(map(block.vocabulary.get, words, repeat(0)), np.int32, len(words)))
        coded.append(np.zeros(1, np.int32))
    if not coded:
        return
    every = np.concatenate(coded)
    first = np.cumsum(np.array(counts) + 1) - np.array(counts) - 1
    # Length of the run of benchmark words that begins at each position.
    outside = np.flatnonzero(every == 0)
    run = outside[np.searchsorted(outside, np.arange(len(every)))] - np.arange(len(every))
    starts = run >= block.need[every]
    # Keep the runs that hold a start, with the 0 that ends each.
    ends = outside[np.searchsorted(outside, np.flatnonzero(starts))]
    kept_ends, kept_first = np.unique(ends, return_index=True)
    if not len(kept_ends):
        return
    kept_starts = np.flatnonzero(starts)[kept_first]
    place = ragged_ranges(kept_starts, kept_ends - kept_starts + 1)
    words = every[place]
    order = suffix_array(words, block.longest + 1)
    order = order[starts[place[order]]]

    query = block.begins
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(order))
    active = np.arange(len(query))
    depth = 0
    while len(active):
        here = query[active]
        low[active], high[active] = narrowed(
            words, order, low[active], high[active], depth, block.words[here + depth]
        )
        depth += 1
        active = active[(low[active] < high[active]) & (block.window[here] > depth)]
    hits = np.flatnonzero(high > low)
    sizes = high[hits] - low[hits]
    ends = np.cumsum(sizes)
    done = 0
    while done < len(hits):
        before = ends[done] - sizes[done]
        until = max(done + 1, int(np.searchsorted(ends, before + PLACES, "right")))
        some, n = hits[done:until], sizes[done:until]
        at = order[ragged_ranges(low[some], n)]
        document = np.searchsorted(first, place[at], side="right") - 1
        yield document, place[at] - first[document], np.repeat(block.window[query[some]], n), np.repeat(some, n), words, at
        done = until


def longest_matches(words: np.ndarray, places: np.ndarray, length: np.ndarray, block: Block) -> np.ndarray:
    """How many words from each place on stand in some item one after another.

    Less than a whole window of an item is no match; ``length`` is that of a
    window found at the place, which may be a short item's.
    """
    at, back = np.unique(places, return_inverse=True)
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(block.order))
    match = np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    depth = 0
    while len(active):
        wanted = words[np.minimum(at[active] + depth, len(words) - 1)]
        low[active], high[active] = narrowed(block.ended, block.order, low[active], high[active], depth, wanted)
        active = active[(low[active] < high[active]) & (wanted > 0)]
        depth += 1
        match[active] = depth
    match = match[back]
    return np.where(match >= block.full, match, length)


def shard_hits(shard: list[bytes], blocks) -> tuple[list[int], list[int], list[list[str]], list[int]]:
    """Per document: words, words inside found windows, items in order, longest match."""
    counts = [len(alnum_words(text)) for text in shard]
    items: list[set[str]] = [set() for _ in shard]
    longest = np.zeros(len(shard), np.int64)
    offsets = np.cumsum([0] + [count + 1 for count in counts])
    cover = np.zeros(int(offsets[-1]) + 1, np.int32)
    for sent in blocks:
        block = sent.value
        found = [np.zeros(0, np.int64)]
        for document, position, length, window, words, at in found_in_shard(shard, block):
            np.maximum.at(longest, document, longest_matches(words, at, length, block))
            begin = np.unique((offsets[document] + position) * (WINDOW_LIMIT + 1) + length)
            begin, length = np.divmod(begin, WINDOW_LIMIT + 1)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + length, -1)
            found.append(np.unique(document * len(block.begins) + window))
        document, window = np.divmod(np.unique(np.concatenate(found)), max(len(block.begins), 1))
        names: dict[bytes, set[str]] = {}
        numbers = np.unique(document)
        begin, end = (np.searchsorted(document, numbers, side) for side in ("left", "right"))
        for number, a, b in zip(numbers.tolist(), begin, end, strict=True):
            # Documents with the same windows have the same items.
            key = window[a:b].tobytes()
            if key not in names:
                if len(names) > NAMES:
                    names.clear()
                held = np.unique(np.concatenate([block.items[w] for w in window[a:b].tolist()]))
                names[key] = {block.ids[k] for k in held.tolist()}
            # Most documents have items of one block, and so share the set itself.
            items[number] = items[number] | names[key] if items[number] else names[key]
    inside = np.concatenate(([0], np.cumsum(np.cumsum(cover) > 0)))
    hit = [int(inside[offsets[k] + counts[k]] - inside[offsets[k]]) for k in range(len(shard))]
    ordered = {id(one): sorted(one) for one in items}
    return counts, hit, [ordered[id(one)] for one in items], longest.tolist()


def _shards(batches: Iterator[pa.RecordBatch], text: int):
    """Batches gathered until their texts reach the size of a shard."""
    return in_blocks(
        ((batch, texts(batch.column(text))) for batch in batches),
        lambda pair: sum(map(len, pair[1])),
        SHARD_BYTES,
    )


def _blocks(benchmark: DataFrame, window: int) -> list:
    """The benchmark as broadcast blocks of about ``BLOCK_BYTES`` each."""
    if window > WINDOW_LIMIT:
        raise ValueError(f"window must be at most {WINDOW_LIMIT}")
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).orderBy("item_id", "text")
    stream = ((row["item_id"], bytes(row["text"] or b"")) for row in rows.toLocalIterator())
    return [
        context.broadcast(Block(block, window))
        for block in in_blocks(stream, lambda row: len(row[1]) + 16, BLOCK_BYTES)
    ]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, items (sorted ids), longest match, contaminated.

    ``documents`` needs doc_id and text, ``benchmark`` item_id and text; other
    columns are left aside, whatever their names.
    """
    bounded_batches(documents.sparkSession)
    blocks = _blocks(benchmark, window)
    source = documents.select("doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("longest", T.LongType()),
        ]
    )

    def search(batches):
        for pairs in _shards(batches, 1):
            counts, hit, items, longest = shard_hits([x for _, t in pairs for x in t], blocks)
            ids = pa.concat_arrays([batch.column(0) for batch, _ in pairs])
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(counts, pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(longest, pa.int64()),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "longest"],
            )

    found = source.mapInArrow(search, schema)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` without those that hold a window of ``benchmark``; all columns kept."""
    bounded_batches(documents.sparkSession)
    blocks = _blocks(benchmark, window)
    text = documents.columns.index("text")

    def keep(batches):
        for pairs in _shards(batches, text):
            _, hit, _, _ = shard_hits([x for _, t in pairs for x in t], blocks)
            at = 0
            for batch, own in pairs:
                yield batch.filter(pa.array([n == 0 for n in hit[at : at + len(own)]], pa.bool_()))
                at += len(own)

    return documents.mapInArrow(keep, documents.schema)


def places(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every place of every window: doc_id, item_id, first word, words, longest match from there on."""
    bounded_batches(documents.sparkSession)
    blocks = _blocks(benchmark, window)
    source = documents.select("doc_id", "text")
    names = ["doc_id", "item_id", "first_word", "n_words", "longest"]
    schema = T.StructType(
        [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("item_id", T.StringType())]
        + [T.StructField(name, T.LongType()) for name in names[2:]]
    )

    def search(batches):
        for pairs in _shards(batches, 1):
            ids = pa.concat_arrays([batch.column(0) for batch, _ in pairs])
            shard = [x for _, t in pairs for x in t]
            for sent in blocks:
                block = sent.value
                for document, position, length, window, words, at in found_in_shard(shard, block):
                    match = longest_matches(words, at, length, block)
                    held = np.array([len(block.items[w]) for w in window.tolist()], np.int64)
                    ends = np.cumsum(held)
                    # A place has a row per item, so places of many items leave in pieces too.
                    cuts = np.unique(np.searchsorted(ends, np.arange(PLACES, int(ends[-1]), PLACES)) + 1).tolist()
                    for a, b in zip([0, *cuts], [*cuts, len(held)], strict=True):
                        item = np.concatenate([block.items[w] for w in window[a:b].tolist()] or [held[:0]])
                        columns = [np.repeat(x[a:b].astype(np.int64), held[a:b]) for x in (position, length, match)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(np.repeat(document[a:b], held[a:b]))),
                                pa.array([block.ids[k] for k in item.tolist()], pa.string()),
                                *map(pa.array, columns),
                            ],
                            names=names,
                        )

    return source.mapInArrow(search, schema)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
