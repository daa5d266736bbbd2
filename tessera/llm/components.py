"""Connected components of a link table, without a vertex table and without collecting links.

Rounds of the large-star and small-star operations (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
each is an aggregate with partial sums and a join, so a vertex with many links is met by partial minima and by the splitting
of skewed joins. Every round is checkpointed to the folder that all executors share. Ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import can_checkpoint


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b, after one operation."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, root long) for every vertex of a link that joins two different vertices; root is the smallest of its
    component. Links may repeat, point either way or join a vertex to itself; links with a null end are none. An empty
    table gives an empty result."""
    can_checkpoint(links.sparkSession)
    pairs = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    now = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().checkpoint()
    mark = _mark(now)
    while mark[0]:
        now = _star(_star(now, True), False).checkpoint()
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
