"""From raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all that the stage before kept. All but the last return the columns of ``documents``:

1. ``quality_rules`` drops documents whose votes make them unlikely to be good.
2. ``ngram_join`` keeps one document (the smallest id) of each group of near copies.
3. ``substring_dedup`` cuts passages that occur elsewhere out of the texts; a text may end up empty.
4. ``mixing`` takes from each source what its target asks for. A document taken twice comes twice; of one that is cut
   by the border of a block, the taken words remain.
5. ``packing`` returns the pieces of the documents in their sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.mixing import mixed_texts
from lexloom.llm.ngram_join import keep_first
from lexloom.llm.packing import pack
from lexloom.llm.quality import keep_good
from lexloom.llm.substring import cut_repeats
from lexloom.session import shared_dir

#: Rows that go to a Python worker at once. Documents are long; the usual 10,000 would be tens of megabytes on both sides.
BATCH_ROWS = "2000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession) -> None:
    spark.conf.set(_BATCH, BATCH_ROWS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return keep_good(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return cut_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has no form for the estimate, the joins on similarity and the packing; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    before = spark.conf.get(_BATCH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES:
            path = shared_dir(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return docs
