"""Connected components of a table of links, all in DataFrames.

Large-star and small-star steps alternate until nothing changes: every node
links its larger neighbours to the least it knows of, then its smaller ones. The
links never grow in number, and end as a star from each component's least node.
Few links are read by few tasks, and each round's shuffle files go before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, release

#: Links that a task reads at least, if there are so many.
LINKS = 1 << 18


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` have a < b; b's smaller neighbours are linked to the least of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    joined = links.join(least, "b")
    return joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that a link names; a link is a row (a, b) of bigints, component the least node.

    Links from a node to itself and repeated ones may occur; rows with a null are no links.
    """
    now = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = _state(now)
    while True:
        release(links.sparkSession)
        now = cut(_small_star(_large_star(_gathered(now, state[0]))))
        if (after := _state(now)) == state:
            break
        state = after
    now = _gathered(now, state[0])
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _gathered(links: DataFrame, count: int) -> DataFrame:
    """``links`` in one partition for each ``LINKS`` of them, if they have more."""
    return links.coalesce(-(-count // LINKS) or 1)


def _state(links: DataFrame) -> tuple:
    """Of a set of links: their number, and a sum of hashes that does not depend on their order."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
