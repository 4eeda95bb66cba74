"""The learner model over a stream of answers, for logs in which single keys are very hot (see ``keyed`` for the usual way).

Each micro-batch is reduced to steps (see ``operators.strength``), and every few batches the steps of a key become one, so
the store holds about one row for each key that was answered, however long the stream runs. Batch and stream share the
maths. Answers count in the order in which their batches arrive; how many came later than allowed is counted per
batch, and none is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom import config as C
from lexloom.operators.strength import STEP_ORDER, STEP_SCHEMA, answer_steps, apply_steps, compose
from lexloom.streaming import store

SEEN_SCHEMA = "last_ts timestamp, answers long, late long"


def append_steps(
    answers: DataFrame, log: str, checkpoint: str, rules: C.Rules = C.RULES, fold_every: int = 8, late: str = "1 hour", **trigger
) -> StreamingQuery:
    """Start writing the steps of every micro-batch below ``log``.

    An answer is late if it is older than the newest one of the batches before by more than ``late``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        store.write_tail(answer_steps(batch, rules), f"{log}/steps", batch_id)
        newest = read_seen(spark, log, batch_id - 1).agg(F.max("last_ts")).first()[0]
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
        seen = batch.agg(F.max("ts").alias("last_ts"), F.count("*").alias("answers"), F.count_if(F.col("ts") < limit).alias("late"))
        store.write_tail(seen, f"{log}/seen", batch_id)
        if (batch_id + 1) % fold_every == 0:
            store.fold(spark, f"{log}/steps", STEP_SCHEMA, batch_id, lambda steps: compact(steps, rules))
            store.fold(spark, f"{log}/seen", SEEN_SCHEMA, batch_id, lambda rows: rows.coalesce(1))
        batch.unpersist()

    writer = answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_steps(spark: SparkSession, log: str) -> DataFrame:
    return store.read(spark, f"{log}/steps", STEP_SCHEMA)


def read_seen(spark: SparkSession, log: str, upto: int | None = None) -> DataFrame:
    """A row for each micro-batch: its newest answer, how many it had, and how many of them came late."""
    return store.read(spark, f"{log}/seen", SEEN_SCHEMA, upto)


def current_strength(spark: SparkSession, log: str, seeds: DataFrame) -> DataFrame:
    """Strength after all batches; answers count in the order their batches arrived."""
    return apply_steps(read_steps(spark, log), seeds, order=("batch_id", *STEP_ORDER))


def compact(steps: DataFrame, rules: C.Rules = C.RULES) -> DataFrame:
    """All steps of a key as one, to replace old batches of the log."""
    chain = F.array_sort(F.collect_list(F.struct("batch_id", "first_ts", "first_seq", "first_ok", "expo", "lo", "hi")))
    merged = steps.groupBy("user_id", "tag").agg(
        chain.alias("chain"),
        F.min("batch_id").alias("batch_id"),
        F.min_by("first_ts", F.struct("batch_id", "first_ts", "first_seq", "first_ok")).alias("first_ts"),
        F.min_by("first_seq", F.struct("batch_id", "first_ts", "first_seq", "first_ok")).alias("first_seq"),
        F.min_by("first_ok", F.struct("batch_id", "first_ts", "first_seq", "first_ok")).alias("first_ok"),
        F.max("last_ts").alias("last_ts"),
        F.sum("n").alias("n"),
        F.sum("n_correct").alias("n_correct"),
    )
    return merged.withColumn("s", compose(F.col("chain"), rules)).select(
        "user_id", "tag", "first_ts", "first_seq", "first_ok", "last_ts", "n", "n_correct", "s.expo", "s.lo", "s.hi", "batch_id"
    )
