"""The answer fold: brute force, hot keys, streams."""

import dataclasses
import datetime as dt
import random

from pyspark.sql import functions as F

from lexloom.operators import strength as S
from lexloom.streaming import store, windows
from lexloom.streaming import strength as stream

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "user_id long, tag string, ts timestamp, seq long, is_correct boolean"


def log(n, hot=0.34, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user, tag = (1, "hot") if rng.random() < hot else (rng.randrange(5), f"t{rng.randrange(4)}")
        rows.append((user, tag, START + dt.timedelta(minutes=rng.randrange(n)), i, rng.random() < 0.55))
    return rows


def brute(rows):
    state = {}
    for user, tag, ts, _, ok in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        count, stability, _ = state.get((user, tag), (0, 1.0, None))
        state[user, tag] = (count + ok, min(stability * 2, 365) if ok else max(stability * 0.5, 1), ts)
    return state


def seeds_for(spark, rows):
    keys = sorted({(r[0], r[1]) for r in rows})
    return spark.createDataFrame(
        [(u, t, 0, 1.0, START) for u, t in keys], "user_id long, tag string, correct_count int, stability double, last_practice timestamp"
    )


def as_dict(df):
    return {(r.user_id, r.tag): (r.correct_count, r.stability, r.last_practice.replace(tzinfo=None)) for r in df.collect()}


def plain(state):
    return {k: (c, s, t.replace(tzinfo=None)) for k, (c, s, t) in state.items()}


def test_fold_equals_brute_force_with_a_hot_key(spark):
    rows = log(6000)
    answers = spark.createDataFrame(rows, SCHEMA).repartition(7)
    steps = S.answer_steps(answers)
    assert as_dict(S.apply_steps(steps, seeds_for(spark, rows))) == plain(brute(rows))
    hot = steps.where("tag = 'hot'").agg(F.count("*"), F.sum("n")).first()
    assert 1 <= hot[0] <= 5 and hot[1] == sum(r[1] == "hot" for r in rows)


def test_small_arrow_batches_and_many_partitions(spark):
    rows = log(2000, seed=3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = as_dict(S.apply_answers(spark.createDataFrame(rows, SCHEMA), seeds_for(spark, rows)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == plain(brute(rows))


def test_unseeded_tags_are_ignored_and_others_kept(spark):
    rows = [(1, "a", START, 1, True), (1, "b", START, 2, True)]
    seeds = spark.createDataFrame(
        [(1, "a", 4, 300.0, START), (2, "a", 1, 2.0, START)], "user_id long, tag string, correct_count int, stability double, last_practice timestamp"
    )
    got = as_dict(S.apply_answers(spark.createDataFrame(rows, SCHEMA), seeds))
    assert {k: v[:2] for k, v in got.items()} == {(1, "a"): (5, 365.0), (2, "a"): (1, 2.0)}


def test_batches_are_unpacked(spark):
    schema = "user_id long, ts timestamp, list_of_question_data array<struct<id:string,tags:array<string>>>, is_correct array<boolean>"
    rows = [(1, START, [("q1", ["你", "unit_3", "listening_vocab"]), ("q2", ["好", "你"])], [True, False])]
    got = S.batch_answers(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [(r.tag, r.is_correct) for r in got] == [("你", True), ("好", False), ("你", False)]


def test_stream_equals_batch_and_its_store_stays_small(spark, tmp_path):
    rows = sorted(log(900, seed=11), key=lambda r: (r[2], r[3]))
    source, home = tmp_path / "in", tmp_path / "log"
    source.mkdir()
    answers = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    for i in range(9):
        part = spark.createDataFrame(rows[i * 100:(i + 1) * 100], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(source))
        if i % 4 == 3 or i == 8:
            stream.append_steps(answers, str(home), str(tmp_path / "cp"), fold_every=3).awaitTermination()
            assert store.n_folders(spark, f"{home}/steps") <= 8
    seeds = seeds_for(spark, rows)
    assert as_dict(stream.current_strength(spark, str(home), seeds)) == plain(brute(rows))
    small = stream.compact(stream.read_steps(spark, str(home)))
    assert small.count() == seeds.count()
    assert as_dict(S.apply_steps(small, seeds)) == plain(brute(rows))
    seen = stream.read_seen(spark, str(home)).collect()
    assert sum(r.answers for r in seen) == 900 and len(seen) == 9


def test_a_repeated_batch_and_a_broken_fold_are_harmless(spark, tmp_path):
    rows = sorted(log(300, seed=12), key=lambda r: (r[2], r[3]))
    root = str(tmp_path / "steps")
    for batch_id in (0, 1, 1, 2):
        part = spark.createDataFrame(rows[batch_id * 100:(batch_id + 1) * 100], SCHEMA)
        store.write_tail(S.answer_steps(part), root, batch_id)
    (tmp_path / "steps/base/upto=1").mkdir(parents=True)  # a base that was never finished
    steps = store.read(spark, root, S.STEP_SCHEMA)
    assert as_dict(S.apply_steps(steps, seeds_for(spark, rows), ("batch_id", *S.STEP_ORDER))) == plain(brute(rows))


def test_late_answers_are_counted_and_kept(spark, tmp_path):
    old = (1, "a", START - dt.timedelta(days=9), 9, False)
    rows = [[(1, "a", START, 1, True)], [(1, "a", START + dt.timedelta(minutes=5), 2, True), old]]
    (tmp_path / "in").mkdir()
    answers = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in rows:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.append_steps(answers, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.answers, r.late) for r in stream.read_seen(spark, str(tmp_path / "log")).collect()) == [(1, 0), (2, 1)]
    got = stream.current_strength(spark, str(tmp_path / "log"), seeds_for(spark, rows[0]))
    assert [r.correct_count for r in got.collect()] == [2]


def test_intervals_of_a_stream_drop_late_answers(spark, tmp_path):
    at = lambda *hours: [(1, "a", START + dt.timedelta(hours=h), i, True) for i, h in enumerate(hours)]
    (tmp_path / "in").mkdir()
    answers = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in (at(1, 2, 30), at(31, 3), at(40)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        windows.append_intervals(answers, "6 hours", str(tmp_path / "log"), str(tmp_path / "cp"), "2 hours", 2).awaitTermination()
    got = {r.start.replace(tzinfo=None): r.answers for r in windows.current_intervals(spark, str(tmp_path / "log")).collect()}
    start = START.replace(tzinfo=None)
    assert got == {start: 2, start + dt.timedelta(hours=30): 2, start + dt.timedelta(hours=36): 1}


def test_answers_without_a_key_or_time_are_ignored(spark):
    rows = [(1, "a", START, 1, True), (1, None, START, 2, True), (None, "a", START, 3, True), (1, "a", None, 4, True), (1, "a", START, None, None)]
    got = as_dict(S.apply_steps(S.answer_steps(spark.createDataFrame(rows, SCHEMA)), seeds_for(spark, [(1, "a")])))
    assert got == {(1, "a"): (1, 2.0, START.replace(tzinfo=None))}


def test_other_caps_than_the_usual(spark):
    rules = dataclasses.replace(S.C.RULES, stability_cap=2.0**60)
    rows = [(1, "a", START + dt.timedelta(minutes=i), i, i < 50 or i >= 70) for i in range(90)]
    steps = S.answer_steps(spark.createDataFrame(rows, SCHEMA).repartition(5), rules)
    assert as_dict(S.apply_steps(steps, seeds_for(spark, rows)))[1, "a"][1] == 2.0**50


def test_more_tags_than_a_block_in_a_question(spark):
    tags = [f"t{i}" for i in range(5000)]
    schema = "user_id long, ts timestamp, list_of_question_data array<struct<tags:array<string>>>, is_correct array<boolean>"
    batches = spark.createDataFrame([(1, START, [(tags,), (["x"],)], [True, False])], schema)
    got = S.batch_answers(batches).select("seq").distinct().count()
    assert got == 5001


def test_answered_strength_holds_answered_tags_only(spark):
    rows = log(500, seed=5)
    users = spark.createDataFrame([(u, 3, []) for u in range(4)], "user_id long, current_unit int, graduated_units array<int>")
    tag_units = spark.createDataFrame([("hot", 3), ("t1", 4), ("never", 5)], "tag string, unit int")
    now = F.lit(START).cast("timestamp")
    got = as_dict(S.answered_strength(spark.createDataFrame(rows, SCHEMA), users, tag_units, now))
    assert got == {k: v for k, v in plain(brute(rows)).items() if k[0] < 4 and k[1] in ("hot", "t1")}
