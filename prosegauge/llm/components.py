"""Connected components of a link table by alternating large-star and small-star steps, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, stored


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node (the larger end) and its smaller neighbours link to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def components(edges: DataFrame, source: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of each node with a link. edges: a, b of one ordered type, in any direction;
    source: the table that they come from, whose size tells how many files to write.

    Each round is written to shared storage. The number of rounds grows with the logarithm of the size; there is no cap that
    would leave a component unfinished: after the given rounds an error is raised.
    """
    now = stored(gathered(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), source), label)
    state = None
    for _ in range(rounds):
        now = stored(gathered(_small(_large(now)), now), label)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = tuple(mark)
    raise RuntimeError("components did not converge")
