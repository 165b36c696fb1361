"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark tasks and each distinct word is encoded
once; a text's ids are those of its words, joined back by position. Decoding
joins ids with the tokenizer's id-to-piece table.

The most frequent words (at most ``HEAD_WORDS``, chosen from counts over all
texts) are encoded first and their table, of bounded size, is sent to all tasks.
All other words are dealt out by word: each is encoded once where it arrives,
and its ids go back to the positions it came from. What moves of a text is one
to three bytes a word, its places in the table, never the text.

The word rules are those of the tokenizer file: characters up to U+036F (and
common punctuation) are split here, any other text by the library's own
normalizer and splitter, so both give the library's words. No word crosses a
blank, so a task splits each distinct string between blanks once while it is
kept, in a table of bounded size.

Defined cases: a null text is empty and has no ids; special tokens inside a text
are encoded as such; repeated rows each get the result; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shelfmark.llm.common import bounded_batches, written

MODEL = "word_bpe_49k.json"
HEAD_WORDS = 1 << 18
HEAD_LENGTH = 64
TASK_WORDS = 1 << 16
HELD_WORDS = 1 << 19
HELD_STRINGS = 1 << 18

# The tokenizer file's word pattern, and blanks as it knows them.
BLANKS = r"\t-\r \x85\xa0"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANKS}\p{{L}}\p{{N}}]+")
# Blanks to Python but not to the tokenizer.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
MARKS = frozenset(".,;:!?")
UNUSUAL = re.compile("[^\x00-\x1b\x20-ͯ‐-‧‰-⁞€]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: chr(byte) for byte in printable} | {byte: chr(256 + k) for k, byte in enumerate(others)}


class Words:
    """The tokenizer's splitter and word encoder; loaded once in each task that needs it."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.special = {token.content: number for number, token in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()

    def strings(self, text: str) -> list[str]:
        """A text as strings that are split by themselves: :meth:`words` of each, in order, are its words."""
        if self.marks and self.marks.search(text):
            return [
                string
                for part in self.marks.split(text)
                for string in ([part] if part in self.special else self._plain(part))
            ]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() and not any(mark in text for mark in SEPARATORS):
            return text.lower().split()
        if UNUSUAL.search(text):
            normal = self.library.normalizer.normalize_str(text)
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return unicodedata.normalize("NFC", text).lower().split()

    def words(self, string: str) -> list[str]:
        # Most strings are letters alone, or with one mark behind them.
        if string.isalpha():
            return [string]
        if string[-1] in MARKS and string[:-1].isalpha():
            return [string[:-1], string[-1]]
        if string in self.special or UNUSUAL.search(string):
            # Other unusual strings come from the library's splitter.
            return [string]
        return WORD.findall(string)

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them, in order."""
        return [word for string in self.strings(text) for word in self.words(string)]

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        # ASCII letters stand for themselves.
        plain = word.isascii() and word.isalpha()
        letters = word if plain else word.encode().decode("latin-1").translate(self.alphabet)
        return [token.id for token in self.library.model.tokenize(letters)]

    def packed(self, word: str) -> bytes:
        return struct.pack(f"<{len(ids := self.ids(word))}I", *ids)


def packed_places(places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers below 2^21 in one to three bytes each, and how many bytes each took."""
    sizes = (1 + (places >= 1 << 7) + (places >= 1 << 14)).astype(np.int64)
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(3):
        some = np.flatnonzero(sizes > k)
        out[at[some] + k] = (places[some] >> (7 * k) & 127) | ((sizes[some] > k + 1) << 7)
    return out.tobytes(), sizes


def unpacked_places(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and for each the place of its last byte."""
    octets = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(octets < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = (octets[starts] & 127).astype(np.int32)
    for k in (1, 2):
        some = np.flatnonzero(starts + k <= ends)
        out[some] |= (octets[starts[some] + k] & 127).astype(np.int32) << (7 * k)
    return out, ends


def word_counts(documents: DataFrame, path: str) -> DataFrame:
    """word and n: the most frequent words of every task, added up."""

    def top(seen: Counter) -> pa.RecordBatch:
        most = seen.most_common(TASK_WORDS)
        words = [(word, n) for word, n in most if n > 1 and len(word) <= HEAD_LENGTH]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())],
            names=["word", "n"],
        )

    def count(batches):
        splitter, seen = Words(path), Counter()

        def counted() -> Counter:
            found = Counter()
            for string, n in seen.items():
                for word in splitter.words(string):
                    found[word] += n
            return found

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(splitter.strings(text))
            if len(seen) > HELD_WORDS:
                yield top(counted())
                seen = Counter()
        yield top(counted())

    return documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_table(documents: DataFrame, path: str, most: int) -> list[tuple[str, bytes]]:
    """The most frequent words, at most ``most``, with their ids; the first is the most frequent.

    Counts decide only what travels; every word has the same ids either way.
    """
    counted = written(word_counts(documents, path), "words")
    level = F.floor(F.log2("n")).cast("int")
    sizes = {row["level"]: row["count"] for row in counted.groupBy(level.alias("level")).count().collect()}
    least, held = 64, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k

    def encode(batches):
        splitter = Words(path)
        for batch in batches:
            ids = [splitter.packed(word) for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    chosen = counted.where(level >= least).mapInArrow(encode, "word string, n long, ids binary")
    rows = [(row["n"], row["word"], bytes(row["ids"])) for row in chosen.collect()]
    return [(word, ids) for _, word, ids in sorted(rows, key=lambda row: (-row[0], row[1]))]


def encoded(documents: DataFrame, path: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, ids (unsigned 32-bit, little-endian) and n_tokens of every row."""
    return _assembled(documents, path, head_words, False)


def round_trip(documents: DataFrame, path: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, ids, n_tokens, and decoded: the pieces of the ids."""
    return _assembled(documents, path, head_words, True)


def digests(documents: DataFrame, path: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    return _assembled(documents, path, head_words, True, True)


def _assembled(documents: DataFrame, path: str, head_words: int, decode: bool, digest: bool = False) -> DataFrame:
    if head_words >= 1 << 21:
        raise ValueError("the table of frequent words is limited to 2^21 - 1")
    spark = documents.sparkSession
    bounded_batches(spark)
    head = spark.sparkContext.broadcast(head_table(documents, path, head_words))
    source = documents.select("doc_id", "text", F.xxhash64("text").alias("version"))
    id_field = T.StructField("doc_id", source.schema["doc_id"].dataType)
    long, binary = T.LongType(), T.BinaryType()
    key = [id_field, T.StructField("version", long)]

    def placed(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str]]]:
        """Each batch with the place of every word (0: not among the frequent), words per row, and the rare words."""
        splitter = Words(path)
        place = {word: k for k, (word, _) in enumerate(head.value, 1)}.get
        known: dict[str, list[int]] = {}
        for batch in batches:
            places, sizes, rare_words = [], [], []
            for text in batch.column(1).to_pylist():
                strings = splitter.strings(text or "")
                numbers: list[int] = []
                # A string that is a frequent word is that word alone.
                for string, number in zip(strings, map(place, strings), strict=True):
                    if number:
                        numbers.append(number)
                        continue
                    if string.isalpha():
                        numbers.append(0)
                        rare_words.append(string)
                        continue
                    found = known.get(string)
                    if found is None:
                        words = splitter.words(string)
                        found = [place(word, 0) for word in words]
                        if all(found):
                            if len(known) > HELD_STRINGS:
                                known.clear()
                            known[string] = found
                        else:
                            rare_words.extend([w for w, k in zip(words, found, strict=True) if not k])
                    numbers.extend(found)
                places.append(np.array(numbers, np.int32))
                sizes.append(len(numbers))
            yield batch, np.concatenate([np.zeros(0, np.int32), *places]), np.array(sizes, np.int64), rare_words

    def rare(batches):
        for batch, places, sizes, words in placed(batches):
            at = np.flatnonzero(places == 0)
            row = np.repeat(np.arange(len(sizes)), sizes)[at]
            position = at - (np.cumsum(sizes) - sizes)[row]
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(position, pa.int64()), pa.array(words, pa.string())],
                names=["doc_id", "version", "position", "word"],
            )

    def rare_ids(batches):
        splitter, last = Words(path), (None, b"")
        for batch in batches:
            column = batch.column(3).dictionary_encode()
            known = [last[1] if word == last[0] else splitter.packed(word) for word in column.dictionary.to_pylist()]
            ids = pa.array(known, pa.binary()).take(column.indices)
            if batch.num_rows:
                last = (batch.column(3)[-1].as_py(), ids[-1].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], names=["doc_id", "version", "position", "packed"])

    def places(batches):
        for batch, numbers, sizes, _ in placed(batches):
            packed, n_bytes = packed_places(numbers)
            cuts = np.concatenate(([0], np.cumsum(n_bytes)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
            rows = [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.nulls(batch.num_rows, pa.int64()), pa.array(rows, pa.binary())],
                names=["doc_id", "version", "position", "packed"],
            )

    moved = T.StructType([*key, T.StructField("position", long), T.StructField("packed", binary)])
    words = T.StructType([*key, T.StructField("position", long), T.StructField("word", T.StringType())])
    of_rare = (
        source.mapInArrow(rare, words).repartition("word").sortWithinPartitions("word").mapInArrow(rare_ids, moved)
    )
    together = (
        of_rare.unionByName(source.mapInArrow(places, moved))
        .repartition("doc_id", "version")
        .sortWithinPartitions("doc_id", "version", F.col("position").asc_nulls_last())
    )

    def assemble(batches):
        library = Tokenizer.from_file(path)
        size = library.get_vocab_size(with_added_tokens=True)
        pieces = [(library.id_to_token(k) or "").encode() for k in range(size)]

        def text_of(ids: bytes) -> bytes:
            return b" ".join([pieces[k] for k in struct.unpack(f"<{len(ids) // 4}I", ids)])

        ids_of = [b"", *(ids for _, ids in head.value)]
        piece_of = [text_of(ids) for ids in ids_of] if decode else []
        now, found = None, {}
        for batch in batches:
            out: list[tuple] = []
            rows = list(zip(*(column.to_pylist() for column in batch.columns), strict=True))
            coded = [row[3] for row in rows if row[2] is None]
            every, ends = unpacked_places(b"".join(coded))
            cuts = np.searchsorted(ends, np.cumsum([len(x) for x in coded])).tolist()
            every, begin, texts = every.tolist(), 0, iter(cuts)
            for doc_id, version, position, packed in rows:
                if (doc_id, version) != now:
                    now, found = (doc_id, version), {}
                if position is not None:
                    found[position] = packed
                    continue
                end = next(texts)
                numbers = every[begin:end]
                begin = end
                parts = list(map(ids_of.__getitem__, numbers))
                for at, ids in found.items():
                    parts[at] = ids
                ids = b"".join(parts)
                row = [doc_id, hashlib.sha256(ids).hexdigest() if digest else ids, len(ids) // 4]
                if decode:
                    shown = list(map(piece_of.__getitem__, numbers))
                    for at, own in found.items():
                        shown[at] = text_of(own)
                    decoded = b" ".join(filter(None, shown))
                    row.append(hashlib.sha256(decoded).hexdigest() if digest else decoded.decode())
                out.append(tuple(row))
            columns = list(zip(*out, strict=True)) or [[] for _ in result.names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, kinds(batch), strict=True)], names=result.names
            )

    def kinds(batch):
        text = [pa.string()]
        return [batch.schema.field(0).type, pa.string() if digest else pa.binary(), pa.int64(), *(text if decode else [])]

    ids_field = T.StructField("ids_sha256", T.StringType()) if digest else T.StructField("ids", binary)
    fields = [id_field, ids_field, T.StructField("n_tokens", long)]
    if decode:
        fields.append(T.StructField("decoded_sha256" if digest else "decoded", T.StringType()))
    result = T.StructType(fields)
    return together.mapInArrow(assemble, result)


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids, by joining each id with its piece.

    For ids from anywhere; ids without a piece are left out, as the library does.
    """
    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    source = encodings.select("doc_id", "ids")
    schema = T.StructType([source.schema["doc_id"], T.StructField("text", T.StringType())])

    def decode(batches):
        library = Tokenizer.from_file(path)
        pieces = [library.id_to_token(k) for k in range(size)]
        for batch in batches:
            texts = [
                " ".join(pieces[k] for k in np.frombuffer(ids or b"", "<u4").tolist() if k < size and pieces[k] is not None)
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(decode, schema)


def op6_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(documents, public_tokenizers.path(MODEL)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
