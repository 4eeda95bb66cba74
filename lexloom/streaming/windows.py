"""Practice activity over time windows. Works on streams and on stored logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.streaming import store

ACTIVITY_SCHEMA = "user_id long, start timestamp, end timestamp, answers long, correct long"


def _measures() -> list:
    return [F.count("*").alias("answers"), F.count_if("is_correct").alias("correct")]


def per_interval(answers: DataFrame, every: str, late: str = "1 hour") -> DataFrame:
    """Answers and right answers per user and fixed interval; later rows than ``late`` are dropped by a stream."""
    rows = answers.withWatermark("ts", late) if answers.isStreaming else answers
    out = rows.groupBy("user_id", F.window("ts", every).alias("w")).agg(*_measures())
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "answers", "correct")


def per_sitting(answers: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """The same per sitting: a run of answers with no pause as long as ``gap``."""
    rows = answers.withWatermark("ts", late) if answers.isStreaming else answers
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(*_measures())
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "answers", "correct")


def _latest(rows: DataFrame) -> DataFrame:
    key = ["user_id", "start", "end"]
    last = F.max_by(F.struct("answers", "correct"), "batch_id").alias("v")
    return rows.groupBy(*key).agg(last, F.max("batch_id").alias("batch_id")).select(*key, "v.*", "batch_id")


def append_intervals(
    answers: DataFrame, every: str, log: str, checkpoint: str, late: str = "1 hour", fold_every: int = 8, **trigger
) -> StreamingQuery:
    """Start writing what each micro-batch of a stream changes in the counts per interval.

    The counts of open intervals are Spark's keyed state; an interval is closed, and answers to it are dropped, when the
    newest answer is ``late`` past its end.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store.write_tail(batch, log, batch_id)
        if (batch_id + 1) % fold_every == 0:
            store.fold(batch.sparkSession, log, ACTIVITY_SCHEMA, batch_id, _latest)

    counts = per_interval(answers, every, late)
    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_intervals(spark: SparkSession, log: str) -> DataFrame:
    """The counts after all batches."""
    return _latest(store.read(spark, log, ACTIVITY_SCHEMA)).drop("batch_id")


def append_sittings(
    answers: DataFrame, gap: str, log: str, checkpoint: str, late: str = "1 hour", fold_every: int = 8, **trigger
) -> StreamingQuery:
    """Start writing the sittings of a stream, each once it is closed.

    Open sittings are Spark's keyed state: an answer between two of them makes them one. A sitting is closed, and leaves the state,
    when the newest answer is ``late`` past its end; answers that come later than that are dropped.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store.write_tail(batch, log, batch_id)
        if (batch_id + 1) % fold_every == 0:
            store.fold(batch.sparkSession, log, ACTIVITY_SCHEMA, batch_id, lambda rows: rows)

    writer = per_sitting(answers, gap, late).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def closed_sittings(spark: SparkSession, log: str) -> DataFrame:
    """All sittings that are closed after all batches."""
    return store.read(spark, log, ACTIVITY_SCHEMA).drop("batch_id")
