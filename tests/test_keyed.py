"""The keyed stream against the batch model: order, restarts, late answers, idle keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_strength import SCHEMA, START, as_dict, brute, log, plain, seeds_for

from lexloom.operators import strength as S
from lexloom.streaming import keyed


class Feed:
    """A folder of files that a stream reads one after the other."""

    def __init__(self, spark, tmp_path):
        self.spark, self.home = spark, tmp_path
        self.progress = []
        (tmp_path / "in").mkdir()

    def put(self, *parts):
        for part in parts:
            self.spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.home / "in"))
        return self

    def run(self, **how):
        answers = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.home / "in"))
        q = keyed.keep_strength(answers, str(self.home / "log"), str(self.home / "cp"), **how)
        q.awaitTermination()
        self.progress += q.recentProgress
        return self

    def strength(self, rows):
        return as_dict(keyed.kept_strength(self.spark, str(self.home / "log"), seeds_for(self.spark, rows)))

    def late(self):
        return keyed.read_runs(self.spark, str(self.home / "log")).agg(F.sum("late")).first()[0]

    def in_state(self):
        return self.progress[-1].stateOperators[0].numRowsTotal


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_stream_equals_batch_over_a_restart(feed):
    rows = sorted(log(400, seed=21), key=lambda r: (r[2], r[3]))
    feed.put(rows[:150], rows[150:200]).run(fold_every=2)
    feed.put(rows[200:320]).run(fold_every=2)
    feed.put(rows[320:]).run(fold_every=2)
    assert feed.strength(rows) == plain(brute(rows))
    assert feed.late() == 0
    batch = as_dict(S.apply_answers(feed.spark.createDataFrame(rows, SCHEMA), seeds_for(feed.spark, rows)))
    assert feed.strength(rows) == batch


def test_answers_within_the_delay_come_in_any_order(feed):
    rows = log(300, seed=22)
    random.Random(1).shuffle(rows)
    feed.put(rows[:100], rows[100:200], rows[200:]).run(late="3650 days")
    assert feed.strength(rows) == plain(brute(rows))
    assert feed.late() == 0


def test_late_answers_count_at_the_end_and_are_told(feed):
    at = lambda minutes, seq, ok: (1, "a", START + dt.timedelta(minutes=minutes), seq, ok)
    first, second = [at(0, 1, True), at(300, 2, True)], [at(400, 3, True)]
    late = [at(5, 4, False)]  # behind the watermark by now, and behind what is folded
    feed.put(first, second, late).run(late="1 hour")
    assert feed.late() == 1
    # the order in which they count: 0, 300, 400 minutes, and the late one before the one that still waits
    assert feed.strength(first) == plain(brute([at(0, 1, True), at(5, 2, False), at(300, 3, True), at(400, 4, True)])) | {
        (1, "a"): feed.strength(first)[1, "a"]
    }
    assert feed.strength(first)[1, "a"][0] == 3


def test_idle_keys_leave_the_state_and_come_back(feed):
    at = lambda user, hours, seq, ok: (user, "a", START + dt.timedelta(hours=hours), seq, ok)
    parts = [
        [at(1, 0, 1, True), at(2, 0, 2, True), at(2, 1, 3, True), at(3, 1, 4, False)],
        [at(1, 100, 5, True)],
        [at(1, 101, 6, True)],
        [at(2, 200, 7, False), at(2, 201, 8, True)],
        [at(9, 400, 9, True)],
    ]
    rows = [r for p in parts for r in p]
    feed.put(*parts[:3]).run(idle="10 hours", fold_every=2)
    assert feed.in_state() == 1 or feed.in_state() == 2  # a timer may still be open
    feed.put(*parts[3:]).run(idle="10 hours", fold_every=2)
    assert feed.in_state() <= 2
    assert feed.strength(rows) == plain(brute(rows))
    assert keyed.read_runs(feed.spark, str(feed.home / "log")).where("user_id = 2").count() == 2


def test_unusable_answers_and_missing_results(feed):
    rows = [(1, "a", START, 1, True), (1, None, START, 2, True), (None, "a", START, 3, True), (1, "a", None, 4, True), (1, "a", START, None, None)]
    feed.put(rows).run()
    assert feed.strength([(1, "a")]) == {(1, "a"): (1, 2.0, START.replace(tzinfo=None))}


def test_no_answers(feed):
    feed.put([]).run()
    assert feed.strength([(1, "a")])[1, "a"][0] == 0


def test_keys_share_rows_of_state(feed):
    """A micro-batch makes a call for each group and not for each key; keys that it leaves alone stay in their group."""
    rows = sorted(log(400, seed=23), key=lambda r: (r[2], r[3]))
    assert len({r[:2] for r in rows}) > 6
    feed.put(rows[:250]).run(groups=3)
    feed.put(rows[250:251], rows[251:]).run(groups=3)
    assert feed.in_state() <= 2 * 3  # a row and a timer for each
    assert feed.strength(rows) == plain(brute(rows))
    assert feed.late() == 0
