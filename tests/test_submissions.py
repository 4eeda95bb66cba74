"""Replay of sessions against a loop over them."""

import datetime as dt
import random

from lexloom.operators import submissions as R

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "user_id long, ts timestamp, seq long, list_of_question_data array<struct<tags:array<string>>>, is_correct array<boolean>, is_unit_test boolean"
SEED = "user_id long, tag string, correct_count int, stability double, last_practice timestamp"


def sessions(seed=6, n=160):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        asked = draw.choice([0, 5, 16, 20, 25])
        tags = [[f"t{draw.randrange(4)}", "unit_3", "listening_vocab", *(["t0"] if draw.random() < 0.2 else [])] for _ in range(asked)]
        right = [draw.random() < draw.choice([0.6, 0.97]) for _ in range(asked)]
        rows.append((draw.choice([1, 1, 1, 2, 3, 99]), START + dt.timedelta(hours=draw.randrange(90)), i, [(t,) for t in tags], right, draw.choice([True, False, None])))
    return rows


def loop(rows, users, strength):
    """The server's loop, one submission after the other."""
    users = {u: [unit, set(done)] for u, (unit, done) in users.items()}
    strength, out = dict(strength), {}
    for user, ts, seq, questions, right, test in sorted(rows, key=lambda r: (r[1], r[2])):
        for (tags,), ok in zip(questions, right):
            for tag in tags:
                if (user, tag) in strength:
                    count, stability = strength[user, tag]
                    strength[user, tag] = (count + ok, min(stability * 2, 365) if ok else max(stability / 2, 1))
        if user not in users:
            continue
        before, result = users[user][0], "unit test not taken"
        if test:
            result = "unit test failed"
            if sum(right) >= 16:
                result = "unit test passed"
                users[user][1].add(before)
                users[user][0] = before + 1
        out[seq] = (sum(right), result, before, users[user][0])
    return out, {u: (unit, ",".join(map(str, sorted(done)))) for u, (unit, done) in users.items()}, strength


def test_replay(spark):
    rows = sessions()
    users = {1: (3, []), 2: (5, [3, 4]), 3: (4, [3]), 4: (3, [])}
    seeds = {(u, f"t{k}"): (0, 1.0) for u in users for k in range(3)}
    want = loop(rows, users, seeds)
    handed = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n string").repartition(5)
    learners = spark.createDataFrame([(u, *x) for u, x in users.items()], "user_id long, current_unit int, graduated_units array<int>")
    judged = R.judged(handed, learners)
    assert {r.seq: (r.n_correct, r.unit_test_result, r.unit_before, r.unit_after) for r in judged.collect()} == want[0]
    assert {r.user_id: (r.current_unit, r.graduated_units) for r in R.users_after(judged, learners).collect()} == want[1]
    assert any(unit > users[u][0] + 1 for u, (unit, _) in want[1].items())
    stored = spark.createDataFrame([(u, t, c, s, START) for (u, t), (c, s) in seeds.items()], SEED)
    got = {(r.user_id, r.tag): (r.correct_count, r.stability) for r in R.strength_after(handed, stored).collect()}
    assert got == want[2]


def test_nothing_handed_in(spark):
    none = spark.createDataFrame([], SCHEMA)
    learners = spark.createDataFrame([(1, 3, [])], "user_id long, current_unit int, graduated_units array<int>")
    judged = R.judged(none, learners)
    assert judged.count() == 0
    assert [tuple(r) for r in R.users_after(judged, learners).collect()] == [(1, 3, "")]
