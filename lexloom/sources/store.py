"""Stored tables: filtered reads, source precedence, unit-wise writes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import shared_dir


def deal_out(df: DataFrame) -> DataFrame:
    """A table kept in fewer files than there are cores, spread over all of them.

    Text work is bound by the processor, and a file of one row group is read by one task. Tables of
    many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: Spark's own setting: the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind: the written table stands in their place."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table that several parts of a job read, and read it back.

    The written table cuts the lineage and outlives lost executors.
    """
    path = shared_dir(df.sparkSession, purpose)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strength_of(strength: DataFrame, users: DataFrame) -> DataFrame:
    """Strength rows of the given users."""
    return strength.join(users.select("user_id").distinct(), "user_id", "left_semi")


def select_units(df: DataFrame, units: list[int] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Only the listed units and sources; None means all. Prunes partitions."""
    if units is not None:
        df = df.where(F.col("unit").isin(units))
    if sources is not None:
        df = df.where(F.col("source").isin(sources))
    return df


def first_available(candidates: list[DataFrame], key: str = "unit") -> DataFrame:
    """Per key, all rows of the first source that has the key."""
    ranked = [df.withColumn("src_rank", F.lit(i)) for i, df in enumerate(candidates)]
    rows = reduce(DataFrame.unionByName, ranked)
    best = rows.groupBy(key).agg(F.min("src_rank").alias("src_rank"))
    return rows.join(best, [key, "src_rank"], "left_semi")


def upsert_units(base: DataFrame, fresh: DataFrame, key: str = "unit") -> DataFrame:
    """Replace the units present in ``fresh``, keep the others."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def block_of(order: Column, block_size: int) -> Column:
    return F.floor(order / block_size)


def unit_documents(rows: DataFrame, order: str, record: Column, block_size: int = 10_000, block: str | None = None) -> DataFrame:
    """Nested documents ``unit -> ordered records``.

    A unit larger than ``block_size`` order values is continued in further
    numbered blocks, so no document grows with the data. ``block`` names a column that has the numbers already; rows that were
    dealt out by unit and block stay where they are.
    """
    block = block_of(F.col(order), block_size) if block is None else F.col(block)
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("r"))))
    docs = rows.groupBy("unit", block.alias("block")).agg(items.alias("items"))
    return docs.select("unit", "block", F.transform("items", lambda i: i["r"]).alias("records"))


def write_units(rows: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite", dealt: bool = False, **options: str) -> None:
    """Write one folder per unit; only the units present are replaced.

    Units are rebalanced at run time by their size, so a large unit is written by many tasks and
    small ones share a task. Rows that are ``dealt`` come in ranges of units already.
    """
    placed = rows if dealt else rows.hint("rebalance", "unit")
    with shuffles_freed(rows.sparkSession):
        (
            placed.write.mode(mode)
            .options(**options)
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", 5_000_000)
            .partitionBy("unit")
            .format(fmt)
            .save(path)
        )
