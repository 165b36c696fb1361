"""Token counts by rank-synchronous merging of ragged arrays.

A batch's pre-tokens that were not met before are laid out as one ragged array
of symbols. Each round finds, in every sequence at once, the pair of the lowest
rank (the leftmost of equal ones) and merges it; sequences without a pair left
are counted. Counts of pre-tokens are kept for the rest of the task, in a table
of bounded size.

Texts are cut where a blank follows another character: no piece of the model
holds a blank after another character (checked when the model is read), so no
merge can cross such a place. A pre-token too long for rounds is merged with a
heap, to the same result.

Nothing is shuffled: each row is counted where it is read.

Defined cases: a null text is empty, with no bytes and no tokens; repeated rows
get equal counts; a null doc_id is kept.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfmark.llm.common import bounded_batches, first_of_runs

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BLANK = "▁"
LONG = 256
KEPT = 1 << 19
NEVER = np.iinfo(np.int64).max
PRE_TOKEN = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Merges:
    """The model's pieces as numbers, with rank and result of every pair that merges."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {
            model.id_to_piece(k): model.get_score(k)
            for k in range(model.get_piece_size())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
        }
        if any(re.search(f"[^{BLANK}]{BLANK}", piece) for piece in scores):
            raise ValueError("a piece of this model crosses a blank")
        if model.normalize("Å AﬁÅ\t\n") != f"{BLANK}Å{BLANK}AﬁÅ\t\n":
            raise ValueError("this model changes characters before it splits them")
        letters = {letter for piece in scores for letter in piece}
        self.number = {text: k for k, text in enumerate(dict.fromkeys([*scores, *sorted(letters)]), 5)}
        # Numbers 1 to 4 stand for characters in no piece, by their bytes.
        self.weight = np.array([0, 1, 2, 3, 4, *(1 if t in scores else len(t.encode()) for t in self.number)])
        order = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for piece, score in scores.items():
            for cut in range(1, len(piece)):
                left, right = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if left and right:
                    pairs[left * len(self.weight) + right] = (order[score], self.number[piece])
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [NEVER], np.int64)
        self.result = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.pairs = pairs

    def symbols(self, text: str) -> list[int]:
        return [self.number.get(letter) or len(letter.encode()) for letter in text]

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in ``rank`` and ``result``; the last place for none."""
        key = left * len(self.weight) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at, len(self.keys))


def merged_counts(sequences: list[list[int]], merges: Merges) -> np.ndarray:
    """Tokens left of every sequence when no pair merges any more."""
    counts = np.zeros(len(sequences), np.int64)
    sizes = np.array([len(s) for s in sequences], np.int64)
    symbol = np.array([x for s in sequences for x in s], np.int64)
    owner = np.repeat(np.arange(len(sequences)), sizes)
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    pair = np.full(len(symbol), len(merges.keys))
    inner = np.flatnonzero(~last)
    pair[inner] = merges.found(symbol[inner], symbol[inner + 1])
    while len(symbol):
        first = first_of_runs(owner)
        # The lowest rank of each sequence, leftmost among equals.
        rank = merges.rank[pair]
        lowest = np.minimum.reduceat(rank, first)
        lengths = np.diff(np.append(first, len(owner)))
        hit = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank < NEVER))
        hit = hit[first_of_runs(owner[hit])]
        done = np.repeat(lowest == NEVER, lengths)
        np.add.at(counts, owner[done], merges.weight[symbol[done]])
        symbol[hit] = merges.result[pair[hit]]
        last[hit] = last[hit + 1]
        keep = ~done
        keep[hit + 1] = False
        moved = np.cumsum(keep) - 1
        hit = moved[hit]
        symbol, owner, last, pair = symbol[keep], owner[keep], last[keep], pair[keep]
        # Only pairs beside a merge are new.
        changed = np.concatenate((hit, hit[(hit > 0)] - 1))
        changed = changed[owner[changed] == owner[np.minimum(changed + 1, len(owner) - 1)]] if len(owner) else changed
        inner = changed[~last[changed]]
        pair[hit] = len(merges.keys)
        pair[inner] = merges.found(symbol[inner], symbol[inner + 1])
    return counts


def long_count(symbols: list[int], merges: Merges) -> int:
    """The same count for one long sequence, with a heap of pairs."""
    after = [*range(1, len(symbols)), -1]
    before = [*range(-1, len(symbols) - 1)]
    width, heap = len(merges.weight), []

    def offer(left: int) -> None:
        right = after[left]
        if left >= 0 and right >= 0 and (found := merges.pairs.get(symbols[left] * width + symbols[right])):
            heapq.heappush(heap, (found[0], left, symbols[left], symbols[right], found[1]))

    for left in range(len(symbols) - 1):
        offer(left)
    while heap:
        _, left, one, other, result = heapq.heappop(heap)
        right = after[left]
        if symbols[left] != one or right < 0 or symbols[right] != other:
            continue
        symbols[left], symbols[right] = result, 0
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return int(merges.weight[symbols].sum())


def pre_tokens(text: str) -> list[str]:
    """Cuts before every run of blanks; the text begins with one blank of its own."""
    return PRE_TOKEN.findall(BLANK + text.replace(" ", BLANK)) if text else []


class Counter:
    """Token counts of pre-tokens, each merged once while it is kept."""

    def __init__(self, path: str, kept: int = KEPT):
        self.merges, self.kept, self.known = Merges(path), kept, {}

    def counts(self, texts: list[str]) -> list[int]:
        cut = [pre_tokens(text) for text in texts]
        if len(self.known) > self.kept:
            self.known = {}
        new = list({token for tokens in cut for token in tokens} - self.known.keys())
        short = [token for token in new if len(token) <= LONG]
        counted = merged_counts([self.merges.symbols(token) for token in short], self.merges)
        self.known.update(zip(short, counted.tolist(), strict=True))
        for token in new:
            if len(token) > LONG:
                self.known[token] = long_count(self.merges.symbols(token), self.merges)
        return [sum(map(self.known.__getitem__, tokens)) for tokens in cut]


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    bounded_batches(documents.sparkSession)
    source = documents.select("doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(batches):
        counter = Counter(path)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            n_tokens = pa.array(counter.counts(texts), pa.int64())
            n_bytes = pa.array([len(text.encode()) for text in texts], pa.int64())
            over = pa.array([n > limit for n in n_tokens.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens, over], names=schema.names)

    return source.mapInArrow(count, schema)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
