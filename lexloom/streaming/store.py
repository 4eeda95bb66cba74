"""A table that a stream writes batch by batch and folds together from time to time.

Below its root a table has ``tail/batch_id=n``, one folder for every micro-batch, and ``base/upto=n``, everything up to a batch in
one. A repeated batch overwrites its own folder. Folding writes a new base, and only when it is whole deletes what it holds, so
a reader finds at most ``every`` tails and one base, and a crash in between costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fold = Callable[[DataFrame], DataFrame]


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole folders ``name=number`` below a path."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.split("=")[1]) for n in names if fs.exists(_path(spark, f"{path}/{n}/_SUCCESS")[1]))


def write_tail(rows: DataFrame, root: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/tail/batch_id={batch_id}")


def read(spark: SparkSession, root: str, schema: str, upto: int | None = None) -> DataFrame:
    """All rows with their ``batch_id`` (that of the first batch for folded rows), up to a batch if one is given."""
    base = [b for b in _folders(spark, f"{root}/base") if upto is None or b <= upto][-1:]
    tails = [b for b in _folders(spark, f"{root}/tail") if b > max(base, default=-1) and (upto is None or b <= upto)]
    parts = [spark.read.schema(f"{schema}, batch_id long").parquet(f"{root}/base/upto={b}") for b in base]
    for b in tails:
        parts.append(spark.read.schema(schema).parquet(f"{root}/tail/batch_id={b}").withColumn("batch_id", F.lit(b).cast("long")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, batch_id long")


def fold(spark: SparkSession, root: str, schema: str, batch_id: int, together: Fold) -> None:
    """Put everything up to a batch into one base, and delete what the base before it had replaced."""
    before = max((b for b in _folders(spark, f"{root}/base") if b < batch_id), default=-1)
    together(read(spark, root, schema, batch_id)).write.mode("overwrite").parquet(f"{root}/base/upto={batch_id}")
    old = [f"{root}/tail/batch_id={b}" for b in _folders(spark, f"{root}/tail") if b <= before]
    old += [f"{root}/base/upto={b}" for b in _folders(spark, f"{root}/base") if b < before]
    for path in old:
        fs, at = _path(spark, path)
        fs.delete(at, True)


def n_folders(spark: SparkSession, root: str) -> int:
    return len(_folders(spark, f"{root}/tail")) + len(_folders(spark, f"{root}/base"))
