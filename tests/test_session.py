"""Shared folders and the package in the workers."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from lexloom.session import clear_shared, shared_dir
from lexloom.sources import store

ROOT = Path(__file__).resolve().parent.parent


def test_written_tables_are_deleted_on_request(spark):
    path = shared_dir(spark, "x")
    spark.range(3).write.parquet(path)
    assert Path(path).exists()
    assert clear_shared(spark) > 0
    assert not Path(path).exists() and clear_shared(spark) == 0


def test_large_units_are_written_whole(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 3 * 2).cast("int").alias("unit"), F.col("id").alias("seq"))
    store.write_units(rows, str(tmp_path / "a"))
    back = spark.read.schema("seq long, unit int").json(str(tmp_path / "a"))
    assert {r.unit: r["count"] for r in back.groupBy("unit").count().collect()} == {0: 1667, 2: 1667, 4: 1666}


def test_workers_find_the_package(tmp_path):
    """A driver that has the repository on its own path only, started elsewhere."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
rows = e.queries()["apply_answers"](spark, "/root/testdata/sf0.001").collect()
print("rows", len(rows))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 150" in out.stdout, out.stderr[-2000:]
