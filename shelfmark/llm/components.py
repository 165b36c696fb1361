"""Connected components of a table of links, by alternating stars.

Every round links each node to the smallest node it sees, first for the larger
neighbours of a node and then for the smaller ones; links of a component of any
shape turn into a star in few rounds. Each round's links are written to the
shared folder, so nothing is recomputed and no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import written


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m, the smallest v of u.

    The smallest ones are counted map-side and dealt anew before the join, so
    that both of its sides are plain shuffles, which adaptive execution can
    split where one node has many links.
    """
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.join(smallest.repartition(parts), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return (
        _with_smallest(both)
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    starred = _with_smallest(down)
    return (
        starred.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def linked_to(links: DataFrame) -> DataFrame:
    """For links (a, b) between comparable nodes: node, root (the smallest reachable).

    Only nodes that have a link to another node appear, and never the root
    itself. Links to itself, repeated and reversed links change nothing.
    """
    now = written(links.where("a <> b").select("a", "b").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
        if state == seen or not state["n"]:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        seen = state
        now = written(_small_star(_large_star(now)), "links")
