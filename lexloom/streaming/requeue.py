"""Questions that come back within a session, from a stream of answers.

A question answered wrongly is asked again later in its session. Every answer is joined to the earlier answers to its question in
its session, by a join of the stream with itself: equal user, session and question, and no more than ``within`` apart, with watermarks
on both sides. So an answer stays in the state for ``within`` and the delay only, and one that nothing came before is
told when that time is over. A session is short, so an answer has few earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.streaming import store

PAIR_SCHEMA = "user_id long, session long, question_id long, ts timestamp, seq long, is_correct boolean, again boolean, after_wrong boolean"
_KEY = ["user_id", "session", "question_id"]


def earlier_answers(answers: DataFrame, within: str, late: str) -> DataFrame:
    """Each answer once for every earlier one to its question in its session, or once with ``again`` false if there is none.

    ``answers`` has user_id, session, question_id, ts, seq (which tells answers of one time apart) and is_correct. Works on stored
    logs, too.
    """
    known = answers.where("user_id IS NOT NULL AND session IS NOT NULL AND question_id IS NOT NULL AND ts IS NOT NULL")
    rows = known.select(*_KEY, "ts", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("is_correct", F.lit(False)).alias("is_correct"))
    mine = rows.withWatermark("ts", late)
    other = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns]).withWatermark("_ts", late)
    same = [F.col(c) == F.col(f"_{c}") for c in _KEY]
    before = (F.col("_ts") < F.col("ts")) | (F.col("_ts") == F.col("ts")) & (F.col("_seq") < F.col("seq"))
    near = (F.col("_ts") <= F.col("ts")) & (F.col("ts") <= F.col("_ts") + F.expr(f"INTERVAL {within}"))
    joined = mine.join(other, [*same, near, before], "left")
    return joined.select(
        *_KEY, "ts", "seq", "is_correct", F.col("_ts").isNotNull().alias("again"),
        F.coalesce(~F.col("_is_correct"), F.lit(False)).alias("after_wrong"),
    )


def append_pairs(answers: DataFrame, log: str, checkpoint: str, within: str, late: str = "1 hour", fold_every: int = 8, **trigger) -> StreamingQuery:
    """Start writing the pairs below ``log``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store.write_tail(batch, log, batch_id)
        if (batch_id + 1) % fold_every == 0:
            store.fold(batch.sparkSession, log, PAIR_SCHEMA, batch_id, lambda rows: rows)

    writer = earlier_answers(answers, within, late).writeStream.outputMode("append").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_pairs(spark: SparkSession, log: str) -> DataFrame:
    return store.read(spark, log, PAIR_SCHEMA).drop("batch_id")


def requeue_counts(pairs: DataFrame) -> DataFrame:
    """Per question: sessions that asked it, how often, how often again, wrong answers, and answers after a wrong one.

    Answers that agree in user, session, question, time and ``seq`` are one.
    """
    each = pairs.groupBy(*_KEY, "ts", "seq").agg(
        F.bool_and("is_correct").alias("is_correct"), F.bool_or("again").alias("again"), F.bool_or("after_wrong").alias("after_wrong")
    )
    return each.groupBy("question_id").agg(
        F.count_if(~F.col("again")).alias("sessions"), F.count("*").alias("attempts"), F.count_if("again").alias("retries"),
        F.count_if(~F.col("is_correct")).alias("wrong"), F.count_if("after_wrong").alias("requeued"),
    )
