"""Order-dependent steps that do not put a whole key into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _add(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null; keeps the columns of ``df`` and the new ones of ``other``."""
    renamed = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = reduce(Column.__and__, [df[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)])
    return df.join(renamed, same).drop(*[f"_k{i}" for i in range(len(keys))])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key. Null keys are one key.

    An aggregate rather than a window: each task keeps one row per key before
    anything is shuffled, so a frequent key costs no more than a rare one.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, "first.*").select(*df.columns)


def number_within(df: DataFrame, keys: list[str], order: list[str], block: Column, out: str = "n") -> DataFrame:
    """Number the rows of each key from 1 in the given total order.

    ``block`` must not decrease along the order. Rows are numbered inside
    (key, block), and the sizes of the blocks before are added, so a key
    is shared by as many tasks as it has blocks. Null keys are one key.

    Key and block are one value, a struct, in which null equals null: the window and the join deal rows out alike, so they move once.
    """
    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], block.alias("block"))
    blocked = df.withColumn("_place", place)
    before = Window.partitionBy(*[f"_place.k{i}" for i in range(len(keys))]).orderBy("_place.block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy("_place").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_place", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_place").orderBy(*order))
    numbered = blocked.withColumn("_local", local).join(offsets, "_place")
    return numbered.withColumn(out, F.col("_before") + F.col("_local")).select(*df.columns, out)


def count_before(df: DataFrame, keys: list[str], order: list[str], block: Column, flag: Column, out: str) -> DataFrame:
    """Add how many earlier rows of a key have the flag, in the given total order.

    ``block`` must not decrease along the order. Rows are counted inside (key, block), and the counts of the blocks before are
    added, so a key is shared by as many tasks as it has blocks. Null keys are one key.
    """
    blocked = df.withColumn("_block", block).withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*keys, "_block").agg(F.sum("_flag").alias("_sum"))
    offsets = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = _add(blocked.withColumn("_local", F.coalesce(F.sum("_flag").over(inside), F.lit(0))), offsets, [*keys, "_block"])
    return counted.withColumn(out, F.col("_before") + F.col("_local")).select(*df.columns, out)


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """At most ``n`` rows per key; each task cuts to ``n`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def next_within(df: DataFrame, keys: list[str], value: str, block_size: int, out: str) -> DataFrame:
    """Add the next larger ``value`` of the same key, or null for the last one.

    Rows look inside their own (key, block); the last one of a block takes the
    smallest value of the next block that has any.
    """
    blocked = df.withColumn("_block", F.floor(F.col(value) / block_size))
    firsts = blocked.groupBy(*keys, "_block").agg(F.min(value).alias("_first"))
    after = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block"))
    nexts = firsts.select(*keys, "_block", after.alias("_after"))
    own = F.lead(value).over(Window.partitionBy(*keys, "_block").orderBy(value))
    joined = _add(blocked.withColumn("_own", own), nexts, [*keys, "_block"])
    return joined.withColumn(out, F.coalesce("_own", "_after")).select(*df.columns, out)
