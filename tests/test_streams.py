"""Sittings and requeued questions of a stream against the stored log."""

import datetime as dt

import pytest

from lexloom.streaming import requeue, windows

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ANSWERS = "user_id long, ts timestamp, is_correct boolean"
ASKED = "user_id long, session long, question_id long, ts timestamp, seq long, is_correct boolean"


@pytest.fixture
def feed(spark, tmp_path):
    """Runs a stream over parts, a few at a time, and gives the folder of its log."""
    def run(schema, start, *runs):
        (tmp_path / "in").mkdir()
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        for parts in runs:
            for part in parts:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            start(source, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
        return str(tmp_path / "log")

    return run


def hour(h):
    return START + dt.timedelta(hours=h)


def sittings(df):
    return sorted((r.user_id, (r.start.replace(tzinfo=dt.timezone.utc) - START).total_seconds() / 3600, r.answers, r.correct) for r in df.collect())


def test_a_late_answer_joins_two_open_sittings(spark, feed):
    at = lambda user, h, ok=True: (user, hour(h), ok)
    log = feed(
        ANSWERS, lambda rows, log, cp: windows.append_sittings(rows, "1 hour", log, cp, late="3 hours", fold_every=2),
        ([at(1, 0), at(1, 1.5), at(2, 0)], [at(2, 3, False)]),
        ([at(1, 0.75, False)],),  # between the two, which are open
        ([at(9, 100)],),  # closes all
        ([at(1, 0.5)],),  # comes after that and is dropped
    )
    got = sittings(windows.closed_sittings(spark, log))
    assert got == [(1, 0, 3, 2), (2, 0, 1, 1), (2, 3, 1, 0)]
    stored = [at(1, 0), at(1, 1.5), at(2, 0), at(2, 3, False), at(1, 0.75, False)]
    assert got == sittings(windows.per_sitting(spark.createDataFrame(stored, ANSWERS), "1 hour"))


def counts(df):
    return sorted(tuple(r) for r in df.collect())


def test_requeued_questions_equal_the_stored_log(spark, feed):
    asked = lambda user, session, q, h, ok: (user, session, q, hour(h), int(100 * h), ok)
    parts = [
        [asked(1, 1, 7, 0, False), asked(1, 1, 8, 0.1, True), asked(2, 1, 7, 0.1, True)],
        [asked(1, 1, 7, 0.5, False), asked(2, 1, 7, 0.3, True)],
        [asked(1, 1, 7, 0.9, True), asked(1, 2, 7, 1.2, True), (None, 1, 7, hour(1), 1, True)],
        [asked(1, 1, 8, 0.2, None)],  # out of order, within the delay
    ]
    rows = [r for p in parts for r in p]
    end = [asked(-1, -1, -1, 50, True)]
    log = feed(
        ASKED, lambda rows, log, cp: requeue.append_pairs(rows, log, cp, "2 hours", late="3 hours", fold_every=3), parts[:2], parts[2:], [end]
    )
    got = counts(requeue.requeue_counts(requeue.read_pairs(spark, log).where("user_id > 0")))
    assert got == [(7, 3, 6, 3, 2, 2), (8, 1, 2, 1, 1, 0)]
    stored = requeue.earlier_answers(spark.createDataFrame(rows, ASKED), "2 hours", "3 hours")
    assert got == counts(requeue.requeue_counts(stored))
