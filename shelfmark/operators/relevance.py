"""Top-k relevance search: BM25 over words, as DataFrame steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.catalog import Catalog
from shelfmark.functions.sizing import is_small, settled
from shelfmark.functions.skew import SLOTS, spread_join
from shelfmark.functions.text import words

K1, B = 1.5, 0.75
SCORE_DIGITS = 6
TOP = 5


def relevance_topk(
    docs: DataFrame,
    queries: DataFrame,
    k: int = TOP,
    text_columns: Sequence[str] = ("title", "description"),
    id_column: str = "id",
    slots: int = SLOTS,
) -> DataFrame:
    """``(query_id, <id>, score, relevance_score, rank)``: the best ``k`` per query.

    ``queries`` has ``query_id`` and ``query``. The score is BM25 summed over
    the query's distinct words, rounded to six digits so that equal documents
    tie and the id decides. ``relevance_score`` is the score relative to the
    query's best, at most 1, as DECIMAL(5,4).

    The whole text of every document is read once: what is kept of it is its
    length and how often it holds each word some query asks for, and totals,
    frequencies and scores all come from that. The list of asked words goes to
    every task if it is counted small; otherwise words are joined by shuffle.
    Queries are sent to every task if they are few, and otherwise joined with
    the words many documents hold cut into pieces. Ranking is done in ``slots`` pieces per
    query first, so a query many documents answer is ranked by many tasks,
    whatever ``k`` is; the pieces' best rows are ranked once more.
    """
    asked = settled(
        queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("word"))
    )
    vocabulary = asked.select("word").distinct()
    small, few_words = is_small(asked), is_small(vocabulary)

    occurrences = word_rows(docs, text_columns, id_column)
    if few_words:
        known = F.broadcast(vocabulary.withColumn("_asked", F.lit(True)))
    else:
        known = vocabulary.withColumn("_asked", F.lit(True))
    kept = occurrences.join(known, "word", "left").where(F.col("word").isNull() | F.col("_asked"))
    counted = settled(kept.groupBy("_doc", "_length", "word").agg(F.count("*").alias("tf")))

    totals = counted.where("word IS NULL").agg(
        F.sum("tf").cast("double").alias("n_docs"),
        (F.sum(F.col("_length") * F.col("tf")).cast("double") / F.sum("tf")).alias("mean_length"),
    )
    counted = counted.where("word IS NOT NULL")
    weight = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    frequency = counted.groupBy("word").agg(F.count("*").alias("df"))
    weighted = (
        asked.join(frequency, "word")
        .join(F.broadcast(totals))  # a single row
        .select("query_id", "word", weight.alias("weight"), "mean_length")
    )
    if small:
        scored = counted.join(F.broadcast(weighted), "word")
    else:
        hot = frequency.withColumnRenamed("df", "n")
        scored = spread_join(counted, weighted, "word", spread="_doc", counts=hot)
    saturation = F.col("tf") + K1 * (1 - B + B * F.col("_length") / F.col("mean_length"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / saturation
    return best_documents(scored.select("query_id", "_doc", part.alias("part")), k, id_column, slots)


def word_rows(docs: DataFrame, text_columns: Sequence[str], id_column: str) -> DataFrame:
    """``_doc``, ``_length`` and ``word`` of every word of every document.

    The null word stands for the document itself, so that its length counts
    whether or not it holds an asked word.
    """
    text = F.concat_ws(" ", *text_columns)
    tokens = docs.select(F.col(id_column).alias("_doc"), words(text).alias("_words"))
    return tokens.select(
        "_doc", F.size("_words").alias("_length"), F.explode(F.array_append("_words", F.lit(None))).alias("word")
    )


def summed(parts: DataFrame) -> DataFrame:
    """``query_id``, ``_doc`` and ``score`` from the parts each word adds."""
    return parts.groupBy("query_id", "_doc").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))


def ranked(scores: DataFrame, k: int, slots: int) -> DataFrame:
    """The best ``k`` of each query with their ``rank``, ranked in ``slots`` pieces first."""
    totalled = scores.withColumn("_slot", F.pmod(F.xxhash64("_doc"), F.lit(slots)))

    def first(rows: DataFrame, *group: str) -> DataFrame:
        best_first = W.partitionBy(*group).orderBy(F.desc("score"), F.asc("_doc"))
        return rows.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)

    return first(first(totalled, "query_id", "_slot").drop("rank"), "query_id")


def best_documents(parts: DataFrame, k: int, id_column: str, slots: int) -> DataFrame:
    """The result of a relevance search from the parts each word adds to a document's score."""
    best = F.max("score").over(W.partitionBy("query_id"))
    relative = F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0))
    return ranked(summed(parts), k, slots).select(
        "query_id",
        F.col("_doc").alias(id_column),
        "score",
        relative.cast("decimal(5,4)").alias("relevance_score"),
        "rank",
    )


def relevant_datasets(catalog: Catalog, query: str, k: int = TOP) -> DataFrame:
    """The ``k`` datasets most relevant to one query."""
    spark = catalog.dataset.sparkSession
    queries = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))
    return relevance_topk(catalog.dataset, queries, k).drop("query_id")
