"""Connected components of an undirected graph held as a table of edges, by alternating stars.

A large star hangs every greater neighbour of a node on the least node that it sees; a small star hangs a node and its
lesser neighbours on the least of them. In turn they make each component a star around its least node, in rounds by the
logarithm of its size, in chains of any order too. Every shuffle is a join on a node or a minimum with map-side combine; no
neighbourhood is gathered, and the sides of a join are plain tables, so adaptive execution can split a hub. The driver sees
one row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import written


def _mark(edges: DataFrame) -> tuple:
    """Count and sums of hashes of a set of edges: equal for equal sets."""
    a, b = (F.xxhash64("hi", "lo", F.lit(i)).cast("decimal(38,0)") for i in (1, 2))
    return tuple(edges.agg(F.count("*"), F.sum(a), F.sum(b)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("hi").agg(F.min("lo").alias("m")))
    hung = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return hung.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", *, max_rounds: int = 60) -> DataFrame:
    """node, root: for each node of an edge the least node of its component.

    Null ends and self-loops make no link; repeated edges count once.
    """
    a, b = F.col(left), F.col(right)
    made = written(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = _mark(made)
    for _ in range(max_rounds):
        made = written(_small_star(written(_large_star(made))))
        now = _mark(made)
        if now == seen:
            return made.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(made.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
