"""A stored gram index for batches of searches, kept up to date by additions.

The index lists, for every run of two to four characters of the upper-cased
titles and descriptions, the datasets that hold it, in blocks of bounded size
and in files by gram (see :mod:`shelfmark.sources.store`). A batch of searches
reads the files of its own grams only; texts are read for candidates alone.

Changed and new datasets are added to what is there. Lists may then name
datasets that lost a gram, or are gone: every candidate is verified against the
text of today, so such entries cost a look and change no result. A gram is never
missing, as each text was added when it came to be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.sizing import is_small, sent_if_small, settled
from shelfmark.functions.skew import SLOTS, spread_join
from shelfmark.operators.batch import GRAM_LENGTHS, filed_by_rarest, holds, pattern_grams, text_grams, upper_texts
from shelfmark.sources.folders import kept
from shelfmark.sources.store import Version

BLOCK_IDS = 4096
MOST_TASKS = 10_000  # that deal with one block or several
GRAMS = "grams"


def add_datasets(version: Version, datasets: DataFrame, files: int | None = None, block_ids: int = BLOCK_IDS) -> Version:
    """The index with the grams of ``datasets``: all of them at first, new and changed ones later."""
    lists = listed_grams(datasets, block_ids)
    if GRAMS in version.heads:
        return version.with_rows(GRAMS, lists, files)
    return version.with_table(GRAMS, lists, ["gram", "block"], files)


def listed_grams(datasets: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``gram`` and ``block`` with the ``ids`` of the block that hold the gram, and their number."""
    texts = kept(datasets.select("id", "title", "description"), "texts")
    # A gram can be in every text; its list is as many blocks as bound the ids of each.
    number = -(-max(texts.count(), 1) // block_ids)
    block = F.pmod(F.xxhash64("id"), F.lit(number)).alias("block")
    # Texts are dealt by block before their grams are taken, so that the grams, some
    # hundred per text, are grouped where they come to be, by as many tasks as there are blocks.
    dealt = upper_texts(texts.select(block, "*")).repartition(min(number, MOST_TASKS), "block")
    held = dealt.select("block", "id", F.explode_outer(text_grams(GRAM_LENGTHS)).alias("gram")).where("gram IS NOT NULL")
    lists = held.groupBy("block", "gram").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    return lists.select("gram", "block", "n", "ids")


def candidates(version: Version, patterns: DataFrame) -> DataFrame:
    """``pattern`` and ``id`` of every dataset that held the rarest gram of a pattern."""
    choices = settled(pattern_grams(patterns))
    wanted = settled(choices.select("gram").distinct())
    heads = version.read(GRAMS, wanted).select("gram", "n").join(sent_if_small(wanted), "gram", "left_semi")
    # Datasets added again count again, which only sways the choice of a gram.
    counts = settled(heads.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("lists")))
    filed = settled(filed_by_rarest(choices, counts.select("gram", "n")))
    chosen = settled(filed.select("gram").distinct())
    lists = version.read(GRAMS, chosen).select("gram", "block", "ids").join(sent_if_small(chosen), "gram", "left_semi")
    if is_small(filed):
        found = lists.join(F.broadcast(filed), "gram")
    else:
        found = spread_join(lists, filed, "gram", spread="block", counts=counts.select("gram", F.col("lists").alias("n")))
    return found.select("pattern", F.explode("ids").alias("id")).distinct()


def matcher(version: Version, datasets: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """What :func:`~shelfmark.operators.batch.batch_search` takes as ``matches``.

    ``datasets`` gives the rows of today for some ids (a DataFrame with ``id``),
    and may give more, such as the files that hold them.
    """

    def matches(patterns: DataFrame) -> DataFrame:
        found = kept(candidates(version, patterns), "candidates")
        by_id = settled(found.groupBy("id").agg(F.count("*").alias("n")))
        texts = upper_texts(datasets(by_id.select("id")))
        return holds(spread_join(found, texts, "id", spread="pattern", counts=by_id, slots=SLOTS))

    return matches


def stored_datasets(version: Version, table: str = "dataset") -> Callable[[DataFrame], DataFrame]:
    """The rows of a stored table, from the files that may hold the asked ids."""
    return lambda ids: version.read(table, ids)
