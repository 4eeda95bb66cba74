"""Connected components of a graph given as pairs, in rounds of joins.

Large-star and small-star rounds (each node's larger, then smaller neighbours move to its smallest) until nothing moves.
Each round is an aggregate with map-side combine and a join that Spark can split where a node has very many
neighbours; every round is written to the shared folder, which cuts the lineage and outlives lost executors. Only
the number of changed pairs reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.sources.store import materialise


def _star(pairs: DataFrame) -> DataFrame:
    """Move every pair ``(a, b)`` with ``a > b`` one star step on; the smallest end of each tree becomes its centre."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    large = large.where("a > b").distinct()
    centre = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(centre, "a").select(
        F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
    )
    return moved.where("a > b").distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id``, ``component_id`` (smallest id that can be reached) for every id in ``a``, ``b`` of the pairs.

    Ids without a pair are not listed. Pairs may repeat, come in any order, or join an id to itself.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = materialise(pairs.select(hi.alias("a"), lo.alias("b")).where("a > b").distinct(), "pairs")
    for _ in range(most_rounds):
        after = materialise(_star(now), "pairs")
        same = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() == same:
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return leaves.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


class Forest:
    """Union-find over places of one block; tells which pairs join two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
