"""A stored index for relevance search, and searches that read little of it.

The index is a table of posting lists: for a word and a block of documents, the
documents of the block that hold the word, how often, and their lengths. Blocks
hold documents of about one length, so that the highest score a block can give
follows closely from its highest count and its smallest length. Lists are kept
in files by word (see :mod:`shelfmark.sources.store`).

New documents are added as a further segment with blocks of its own. Scores
depend on all segments: numbers and lengths of documents are kept per segment
and added up when a search is made, as are the numbers of documents with a word.

A search reads the lists' heads in the files of its own words only. The blocks
that promise most are scored first; the k-th best score found there is a bound
below which no block needs to be read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.sizing import is_small, sent_if_small, settled
from shelfmark.functions.skew import SLOTS, spread_join
from shelfmark.functions.text import words
from shelfmark.operators.relevance import K1, B, TOP, best_documents, ranked, summed
from shelfmark.sources.folders import kept
from shelfmark.sources.store import Version

BLOCK_DOCS = 32
# Lengths of one block differ by less than a ninth: 8 steps per doubling.
LENGTH_STEPS = 8
PUSHED_WORDS = 200
TASK_WORDS = 4_000_000
# Scores are rounded to six digits, and two of them compared.
MARGIN = 2e-6

POSTINGS, SEGMENTS = "postings", "segments"


def add_documents(
    version: Version,
    docs: DataFrame,
    text_columns: Sequence[str] = ("title", "description"),
    id_column: str = "id",
    block_docs: int = BLOCK_DOCS,
    files: int | None = None,
) -> Version:
    """The index with ``docs``, whose ids are new to it, as a further segment."""
    found = docs.select(F.col(id_column).alias("_doc"), words(F.concat_ws(" ", *text_columns)).alias("_words"))
    tokens = kept(found.select("_doc", "_words", F.size("_words").alias("_length")), "tokens")
    step = F.floor(F.log2(F.greatest("_length", F.lit(1))) * LENGTH_STEPS)
    # At most 8 rows per doubling of the length.
    parts = settled(
        tokens.groupBy(step.alias("_step")).agg(F.ceil(F.count("*") / block_docs).alias("_parts"), F.sum("_length").alias("_total"))
    )
    number = 0
    if SEGMENTS in version.heads:
        number = version.read(SEGMENTS).agg(F.max("segment") + 1).scalar()
    place = F.col("_step") * F.lit(1 << 40) + F.pmod(F.xxhash64("_doc"), "_parts")
    total = parts.agg(F.coalesce(F.sum("_total"), F.lit(0)).alias("n")).first()["n"]
    least = int(version.store.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = tokens.withColumn("_step", step).join(F.broadcast(parts), "_step").select("_doc", "_length", "_words", place.alias("block"))
    postings = listed_words(placed, max(least, -(-total // TASK_WORDS)), number)
    totals = tokens.agg(
        F.lit(number).alias("segment"),
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("_length"), F.lit(0)).alias("total_length"),
    )
    if SEGMENTS in version.heads:
        return version.with_rows(POSTINGS, postings, files).with_rows(SEGMENTS, totals)
    return version.with_table(POSTINGS, postings, ["word", "segment", "block"], files).with_table(SEGMENTS, totals, ["segment"])


def listed_words(placed: DataFrame, tasks: int, segment: int) -> DataFrame:
    """The posting lists of documents (``_doc``, ``_length``, ``_words``) placed in blocks.

    Documents move once, by block; their words are counted and listed where they
    then are, by as many tasks as bound the words of each.
    """
    entry = F.struct(F.col("_doc").alias("doc"), F.col("_length").alias("length"), "tf")
    return (
        placed.repartition(tasks, "block")
        .select("block", "_doc", "_length", F.explode("_words").alias("word"))
        .groupBy("block", "_doc", "_length", "word")
        .agg(F.count("*").alias("tf"))
        .groupBy("block", "word")
        .agg(
            F.count("*").alias("n"),
            F.max("tf").alias("most"),
            F.min("_length").alias("shortest"),
            F.sort_array(F.collect_list(entry)).alias("docs"),  # of one block
        )
        .select("word", F.lit(segment).alias("segment"), "block", "n", "most", "shortest", "docs")
    )


@dataclass(frozen=True)
class Search:
    """What is known of a search before any list is read.

    ``lists``: a row per query, word and block, with the word's weight and the
    most it can add there; ``blocks``: a row per query and block with the
    highest score it can give and how many documents it has at least.
    """

    version: Version
    vocabulary: DataFrame
    lists: DataFrame
    blocks: DataFrame
    mean_length: float

    @classmethod
    def of(cls, version: Version, queries: DataFrame) -> "Search":
        asked = settled(queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("word")))
        vocabulary = settled(asked.select("word").distinct())
        totals = version.read(SEGMENTS).agg(F.sum("n_docs").cast("double").alias("n"), F.sum("total_length").cast("double").alias("l")).first()
        n_docs, mean = totals["n"] or 0.0, (totals["l"] or 0.0) / (totals["n"] or 1.0)
        heads = kept(_lists(version, vocabulary).drop("docs"), "heads")
        frequency = heads.groupBy("word").agg(F.sum("n").alias("df"), F.count("*").alias("lists"))
        weight = F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = settled(asked.join(frequency.select("word", weight.alias("weight")), "word"))
        most = _part(F.col("most"), F.col("shortest"), mean)
        if is_small(weighted):
            joined = heads.join(F.broadcast(weighted), "word")
        else:
            counts = frequency.select("word", F.col("lists").alias("n"))
            joined = spread_join(heads, weighted, "word", spread=["segment", "block"], counts=counts)
        lists = kept(joined.select("query_id", "word", "weight", "segment", "block", "n", most.alias("most")), "lists")
        by_block = lists.groupBy("query_id", "segment", "block")
        blocks = kept(by_block.agg(F.sum("most").alias("bound"), F.max("n").alias("n")), "blocks")
        return cls(version, vocabulary, lists, blocks, mean)

    def promising(self, k: int, slots: int = SLOTS) -> DataFrame:
        """``query_id``, ``segment`` and ``block``: for each query the blocks of highest bound that hold ``k`` documents."""
        order = [F.desc("bound"), F.asc("segment"), F.asc("block")]
        piece = F.pmod(F.xxhash64("segment", "block"), F.lit(slots))
        # A block has a document at least, so k blocks of any piece are enough.
        first = self.blocks.withColumn("_piece", piece)
        first = first.withColumn("_rank", F.row_number().over(W.partitionBy("query_id", "_piece").orderBy(*order)))
        earlier = W.partitionBy("query_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
        few = first.where(F.col("_rank") <= k).withColumn("_before", before)
        return few.where(F.col("_before") < k).select("query_id", "segment", "block")

    def parts(self, chosen: DataFrame) -> DataFrame:
        """``query_id``, ``_doc`` and what each word adds, in the chosen blocks."""
        on = ["word", "segment", "block"]
        asked = self.lists.join(sent_if_small(chosen), ["query_id", "segment", "block"], "left_semi")
        needed = kept(asked.select("query_id", "weight", *on), "needed")
        held = _lists(self.version, self.vocabulary).select(*on, "docs")
        if is_small(needed):
            found = held.join(F.broadcast(needed), on)
        else:
            counts = needed.groupBy(*on).agg(F.count("*").alias("n"))
            found = spread_join(needed, held, on, spread="query_id", counts=counts)
        entries = found.select("query_id", "weight", F.inline("docs"))
        return entries.select("query_id", F.col("doc").alias("_doc"), _part(F.col("tf"), F.col("length"), self.mean_length).alias("part"))

    def chosen(self, k: int, slots: int = SLOTS) -> DataFrame:
        """The blocks that may hold one of the best ``k`` documents of a query."""
        first = settled(self.promising(k, slots))
        scores = ranked(summed(self.parts(first)), k, slots)
        least = sent_if_small(settled(scores.where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))))
        reached = F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - MARGIN)
        return self.blocks.join(least, "query_id", "left").where(reached).select("query_id", "segment", "block")


def _part(tf: Column, length: Column, mean_length: float) -> Column:
    """What a word adds to the score; more for a higher count, less for a greater length."""
    saturation = tf + K1 * (1 - B + B * length / F.lit(mean_length))
    return F.col("weight") * tf * (K1 + 1) / saturation


def _lists(version: Version, vocabulary: DataFrame) -> DataFrame:
    """The posting lists of some words, from the files that may hold them."""
    held = version.read(POSTINGS, vocabulary)
    few = [row["word"] for row in vocabulary.limit(PUSHED_WORDS + 1).collect()]
    if len(few) <= PUSHED_WORDS:
        return held.where(F.col("word").isin(few))  # reaches the files' own statistics
    return held.join(sent_if_small(vocabulary), "word", "left_semi")


def indexed_topk(version: Version, queries: DataFrame, k: int = TOP, id_column: str = "id", slots: int = SLOTS) -> DataFrame:
    """:func:`~shelfmark.operators.relevance.relevance_topk` over the documents of an index."""
    search = Search.of(version, queries)
    return best_documents(search.parts(settled(search.chosen(k, slots))), k, id_column, slots)
