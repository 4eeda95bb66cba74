"""The learner model as Spark's keyed state: groups of (user, tag) keys, a row of state and a timer for each group.

Answers need not come in order. Those that are newer than the watermark wait in the state, sorted, and once the watermark has
passed them they are folded into one clamped step (``operators.strength``). What a key says after each micro-batch is its step and
the waiting answers, so the model is always up to date; and as long as no answer is older than the watermark allows, it is the
model of the log in order. Answers that come later than that count all the same, at the end of what is folded, and are
counted as late; none is dropped.

A key that was not answered for ``idle`` leaves the state by its group's timer: its step stands in the log already. Steps compose, so
when the key comes back it begins a new run, and readers put its runs one after the other.

A call of the processor costs far more than a key's work in it, so keys are dealt over ``groups`` by hash, and a micro-batch makes at
most that many calls. A group that was answered is written whole: its keys are all keys over ``groups``.

State is kept in RocksDB, so it is bounded by disk and not by memory; a restart goes on from the checkpoint. A key's answers of one
micro-batch are one task's. Where one key has a great part of all answers, ``streaming.strength`` spreads it over many tasks.
"""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lexloom import config as C
from lexloom.operators.strength import apply_steps, compose, most_expo
from lexloom.streaming import store

#: Set for the session before a stream with keyed state starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN_SCHEMA = "user_id long, tag string, run long, last_ts timestamp, n long, n_correct long, late long, expo int, lo double, hi double"
# A group's keys are one JSON text, [[user_id, tag, run, seen, us, n, n_correct, late, expo, lo, hi, [[us, seq, ok], ..]], ..]: Spark takes
# nested values of a state apart in Python, which took most of the time. Its numbers come back as they were.
_STATE = "timer long, keys string"
GROUPS = 1 << 14
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _learner(idle_ms: int, floor: float, cap: float) -> StatefulProcessor:
    """The processor. Its class is made here so that it is sent to workers whole, the driver's own included."""
    most = most_expo(floor, cap)

    class LearnerState(StatefulProcessor):
        """One group: of each key the settled step and the answers that wait for the watermark, and when keys are let go."""

        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("learner", _STATE)

        def _then(self, step: tuple, right: bool) -> tuple:
            """The step and one answer more: ``(n, n_correct, expo, lo, hi)``."""
            n, n_correct, expo, lo, hi = step
            turn = 1 if right else -1
            move = lambda x: min(2 * x, cap) if right else max(x / 2, floor)
            return n + 1, n_correct + right, max(-most, min(most, expo + turn)), move(lo), move(hi)

        def _answered(self, name: tuple, held: list | None, answers: list[tuple], now: int) -> tuple[tuple, Row]:
            """The key's state after its answers of a micro-batch, and what it says."""
            if held is None:
                run, seen, us, late, waiting = now, now, None, 0, []
                step = (0, 0, 0, floor, cap)
            else:
                run, seen, us, late = held[2], held[3], held[4], held[7]
                step, waiting = (held[5], held[6], *held[8:11]), [tuple(x) for x in held[11]]
            for answer in answers:
                seen = max(seen, now, answer[0] // 1000)
                if answer[0] // 1000 < now:
                    late += 1
                if us is not None and answer[0] < us:  # what comes after it is folded already
                    step = self._then(step, answer[2])
                else:
                    insort(waiting, answer)
            settled = 0
            while settled < len(waiting) and waiting[settled][0] // 1000 < now:
                us, _, right = waiting[settled]
                step, settled = self._then(step, right), settled + 1
            waiting = waiting[settled:]
            kept = (*name, run, seen, us, step[0], step[1], late, *step[2:], waiting)
            last = waiting[-1][0] if waiting else us
            for _, _, right in waiting:
                step = self._then(step, right)
            return kept, Row(
                user_id=name[0], tag=name[1], run=run, last_ts=_EPOCH + timedelta(microseconds=last), n=step[0], n_correct=step[1],
                late=late, expo=step[2], lo=float(step[3]), hi=float(step[4]),
            )

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            now = timerValues.getCurrentWatermarkInMs()
            held = self.state.get()
            timer, keys = (None, {}) if held is None else (held[0], {(k[0], k[1]): k for k in json.loads(held[1])})
            given: dict[tuple, list[tuple]] = {}
            for row in rows:
                user_id, tag, us, seq, ok = tuple(row)[-5:]
                given.setdefault((user_id, tag), []).append((int(us), int(seq), bool(ok)))
            said = []
            for name, answers in given.items():
                keys[name], row = self._answered((int(name[0]), name[1]), keys.get(name), answers, now)
                said.append(row)
            if timer is None:
                timer = min(k[3] for k in keys.values()) + idle_ms
                self.handle.registerTimer(timer)
            self.state.update((timer, json.dumps(list(keys.values()))))
            return iter(said)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            held = self.state.get()
            if held is not None:
                keys = [k for k in json.loads(held[1]) if k[3] + idle_ms > timerValues.getCurrentWatermarkInMs()]
                if keys:
                    timer = min(k[3] for k in keys) + idle_ms
                    self.handle.registerTimer(timer)
                    self.state.update((timer, json.dumps(keys)))
                else:
                    self.state.clear()
            return iter(())

        def close(self) -> None:
            pass

    return LearnerState()


def _millis(spark: SparkSession, interval: str) -> int:
    span = F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))
    return spark.range(1).select(span).first()[0]


def _latest(rows: DataFrame) -> DataFrame:
    """The last word on every run of a key."""
    run = ["user_id", "tag", "run"]
    rest = ["last_ts", "n", "n_correct", "late", "expo", "lo", "hi"]
    return rows.groupBy(*run).agg(F.max_by(F.struct(*rest), "batch_id").alias("v"), F.max("batch_id").alias("batch_id")).select(
        *run, "v.*", "batch_id"
    )


def _folded(rows: DataFrame, rules: C.Rules) -> DataFrame:
    """The last word on every run, with all runs of a key but its last as one: only the last may still change."""
    latest = _latest(rows)
    newest = latest.groupBy("user_id", "tag").agg(F.max("run").alias("_newest"))
    marked = latest.join(newest, ["user_id", "tag"]).withColumn("_open", F.col("run") == F.col("_newest"))
    chain = F.array_sort(F.collect_list(F.struct("run", "expo", "lo", "hi")))
    merged = marked.groupBy("user_id", "tag", "_open").agg(
        chain.alias("chain"), F.max("run").alias("run"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"),
        F.sum("n_correct").alias("n_correct"), F.sum("late").alias("late"), F.max("batch_id").alias("batch_id"),
    )
    return merged.withColumn("s", compose(F.col("chain"), rules)).select(
        "user_id", "tag", "run", "last_ts", "n", "n_correct", "late", "s.expo", "s.lo", "s.hi", "batch_id"
    )


def keep_strength(
    answers: DataFrame, log: str, checkpoint: str, rules: C.Rules = C.RULES, late: str = "1 hour", idle: str = "30 days",
    fold_every: int = 8, groups: int = GROUPS, **trigger,
) -> StreamingQuery:
    """Start keeping the model of a stream of answers (user_id, tag, ts, seq, is_correct) below ``log``.

    Answers without user, tag or time are ignored, those without a result count as wrong. ``groups`` stays what it was when the
    checkpoint was begun.
    """
    spark = answers.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    known = answers.where("user_id IS NOT NULL AND tag IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    # The time goes on as a number: on a column with a watermark Spark would drop late rows.
    rows = known.select(
        F.pmod(F.xxhash64("user_id", "tag"), F.lit(groups)).alias("group"), "user_id", "tag", F.unix_micros("ts").alias("us"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"),
        F.coalesce("is_correct", F.lit(False)).alias("ok"),
    )
    learner = _learner(_millis(spark, idle), rules.stability_floor, rules.stability_cap)
    runs = rows.groupBy("group").transformWithState(learner, RUN_SCHEMA, "update", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        store.write_tail(batch, log, batch_id)
        if (batch_id + 1) % fold_every == 0:
            store.fold(batch.sparkSession, log, RUN_SCHEMA, batch_id, lambda rows: _folded(rows, rules))

    writer = runs.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_runs(spark: SparkSession, log: str) -> DataFrame:
    """The runs of every key: its step, and how many of its answers came late."""
    return _latest(store.read(spark, log, RUN_SCHEMA)).drop("batch_id")


def kept_strength(spark: SparkSession, log: str, seeds: DataFrame) -> DataFrame:
    """Strength after all batches."""
    return apply_steps(read_runs(spark, log), seeds, order=("run",))
