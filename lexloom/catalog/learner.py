"""Learner model: strength, progress, readiness, results, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.catalog import bindings as B
from lexloom.catalog.bindings import LEARNER, sql
from lexloom.catalog.registry import ORACLE, query
from lexloom.functions import scalars
from lexloom.operators import progress as P
from lexloom.operators import strength as S
from lexloom.operators import submissions
from lexloom.operators.ordering import number_within
from lexloom.operators.sessions import route
from lexloom.session import shared_dir
from lexloom.sources import store
from lexloom.streaming import keyed, requeue, windows


def _flat(strength):
    return strength.select(
        "user_id", "tag", "correct_count", "stability", F.unix_micros("last_practice").alias("last_us")
    )


_FLAT = "SELECT user_id, tag, correct_count, stability, epoch_us(last_practice) AS last_us FROM strength"


@query("apply_answers", sql(LEARNER, _FLAT))
def apply_answers(spark, sf):
    return _flat(B.strength(spark, sf))


def _purchases(spark, sf):
    """Answers on parts as a second, larger log: times repeat within a user and tag."""
    t = {n: B.table(spark, sf, n) for n in ("lineitem", "orders", "part")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        (F.col("o_custkey") % 200).alias("user_id"),
        F.col("p_brand").alias("tag"),
        F.col("o_orderdate").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_returnflag") != "R").alias("is_correct"),
    )


_PURCHASES = """purchases AS (
    SELECT o_custkey % 200 AS user_id, p_brand AS tag, o_orderdate AS ts, l_orderkey * 8 + l_linenumber AS seq,
           CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


@query(
    "apply_answers_large",
    sql(
        [],
        """SELECT user_id, tag, CAST(count(*) FILTER (ok = 1) AS INTEGER) AS correct_count,
             list_reduce(list(ok ORDER BY ts, seq, ok),
               lambda s, x: CASE WHEN x = 1 THEN least(s * 2, 365) ELSE greatest(s * 0.5, 1) END, 1.0::DOUBLE) AS stability,
             epoch_us(max(ts)) AS last_us
           FROM purchases GROUP BY user_id, tag""",
        _PURCHASES,
    ),
)
def apply_answers_large(spark, sf):
    answers = _purchases(spark, sf)
    seeds = answers.select("user_id", "tag").distinct().select(
        "user_id", "tag", F.lit(0).alias("correct_count"), F.lit(1.0).alias("stability"), F.lit(None).cast("timestamp").alias("last_practice")
    )
    return _flat(S.apply_answers(answers, seeds))


@query("scan_strength", sql(LEARNER, _FLAT + " WHERE user_id IN (SELECT user_id FROM users WHERE current_unit = 3)"))
def scan_strength(spark, sf):
    return _flat(store.strength_of(B.strength(spark, sf), B.users(spark, sf).where("current_unit = 3")))


_RETENTION = "round(pow(0.5, (epoch_us(now) - epoch_us(last_practice)) / 86400000000.0 / stability), 6)"


@query("retention_strength", sql(LEARNER, f"SELECT user_id, tag, {_RETENTION} AS strength FROM strength, clock"))
def retention_strength(spark, sf):
    value = scalars.retention(B.now(spark, sf), F.col("last_practice"), F.col("stability"))
    return B.strength(spark, sf).select("user_id", "tag", F.round(value, 6).alias("strength"))


@query(
    "seed_missing",
    sql(
        LEARNER,
        """SELECT user_id, tag, 0 AS correct_count, 1.0::DOUBLE AS stability,
                  epoch_us((SELECT now FROM clock) - INTERVAL 365 DAY) AS last_us
           FROM (SELECT user_id, tag FROM users CROSS JOIN tag_units EXCEPT SELECT user_id, tag FROM right_ones)""",
        "right_ones AS (SELECT DISTINCT user_id, tag FROM answers WHERE is_correct)",
    ),
)
def seed_missing(spark, sf):
    existing = B.answers(spark, sf).where("is_correct").select("user_id", "tag").distinct()
    rows = S.seed_missing(existing, B.users(spark, sf), B.tag_units(spark, sf), B.now(spark, sf))
    return _flat(rows)


_SCORES = f"""SELECT s.user_id, s.tag, t.unit, s.stability, {_RETENTION} AS strength
    FROM strength s JOIN tag_units t USING (tag) JOIN users u USING (user_id), clock
    WHERE t.unit BETWEEN 3 AND {{high}} AND list_contains(u.graduated_units, t.unit)"""


def _score_rows(scored):
    return scored.select("user_id", "tag", "unit", "stability", F.round("strength", 6).alias("strength"))


@query("strength_join_unit", sql(LEARNER, _SCORES.format(high="99")))
def strength_join_unit(spark, sf):
    rows = S.scores(B.strength(spark, sf), B.users(spark, sf), B.tag_units(spark, sf), B.now(spark, sf), F.lit(3), F.lit(99))
    return _score_rows(rows)


@query("weak_tags", sql(LEARNER, f"SELECT * FROM ({_SCORES.format(high='u.current_unit - 1')}) WHERE strength < 0.70"))
def weak_tags(spark, sf):
    strength, users, tag_units = B.stored_answered(spark, sf), B.users(spark, sf), B.tag_units(spark, sf)
    known = S.weak_tags(strength, users, tag_units, B.now(spark, sf))
    never = S.default_scores(strength, users, tag_units, F.col("current_unit") - 1)
    return _score_rows(known.unionByName(never))


_PROGRESS = """progress AS (
    SELECT u.user_id, t.unit, t.total_tags, CAST(coalesce(g, 0) AS INTEGER) AS graduated_tags,
           CAST(round_even(CAST(coalesce(g, 0) AS DOUBLE) / total_tags * 100, 0) AS INTEGER) AS progress_pct,
           CAST(format('{:.1f}', CAST(coalesce(total, 0) AS DOUBLE) / total_tags) AS DOUBLE) AS avg_correct_count,
           list_contains(graduated_units, t.unit) AS is_graduated, t.unit = current_unit AS is_current
    FROM users u CROSS JOIN (SELECT unit, CAST(count(*) AS INTEGER) AS total_tags FROM unit_tags GROUP BY unit) t
    LEFT JOIN (SELECT user_id, unit, count(*) FILTER (correct_count >= 3) AS g, sum(correct_count) AS total
               FROM strength JOIN unit_tags USING (tag) GROUP BY user_id, unit) s
      ON s.user_id = u.user_id AND s.unit = t.unit)"""


def _progress(spark, sf):
    return P.unit_progress(B.users(spark, sf), B.unit_tags(spark, sf), B.answered(spark, sf))


@query("unit_progress", sql(LEARNER, "SELECT * FROM progress", _PROGRESS))
def unit_progress(spark, sf):
    return _progress(spark, sf)


@query(
    "unit_status",
    sql(
        LEARNER,
        """SELECT user_id, unit, progress_pct, CASE WHEN is_current THEN 'current' WHEN is_graduated THEN 'graduated'
           ELSE 'locked' END AS status FROM progress""",
        _PROGRESS,
    ),
)
def unit_status(spark, sf):
    return P.unit_status(_progress(spark, sf))


_WORDS = """words AS (SELECT u.user_id, u.current_unit AS unit, t.tag, coalesce(s.correct_count, 0) AS correct_count
    FROM users u JOIN unit_tags t ON t.unit = u.current_unit
    LEFT JOIN strength s ON s.user_id = u.user_id AND s.tag = t.tag)"""


@query("unit_words", sql(LEARNER, "SELECT * FROM words", _WORDS))
def unit_words(spark, sf):
    return P.unit_words(B.users(spark, sf), B.unit_tags(spark, sf), B.answered(spark, sf))


_READY = """ready AS (SELECT u.user_id, u.current_unit, coalesce(w.n, 0) AS unit_tags, coalesce(w.r, true) AS ready
    FROM users u LEFT JOIN (SELECT user_id, count(*) AS n, bool_and(correct_count >= 3) AS r FROM words GROUP BY user_id) w
      ON w.user_id = u.user_id)"""


@query("unit_ready", sql(LEARNER, "SELECT * FROM ready", _WORDS, _READY))
def unit_ready(spark, sf):
    return P.unit_ready(B.users(spark, sf), B.unit_tags(spark, sf), B.answered(spark, sf))


# A user's answers come in batches of 20; every other one is a unit test.
_BATCHES = """batches AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS batch FROM events),
  batch_answers AS (SELECT user_id, batch, value >= 9 AS is_correct, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS question_id,
    batch % 2 = 0 AS is_unit_test FROM batches)"""
_RESULT = """results AS (SELECT user_id, batch, count(*) AS asked, count(*) FILTER (is_correct) AS correct,
    CASE WHEN count(*) FILTER (is_correct) >= 16 THEN 'unit test passed' ELSE 'unit test failed' END AS unit_test_result
    FROM batch_answers WHERE is_unit_test GROUP BY user_id, batch)"""


#: No batch of 20 answers takes longer.
_SESSION = "60 days"


def _batch_log(spark, sf):
    e = B.table(spark, sf, "events")
    numbered = number_within(e, ["user_id"], ["ts", "event_id"], F.unix_date(F.to_date("ts")))
    return numbered.select(
        "user_id", F.floor((F.col("n") - 1) / 20).alias("session"), (F.col("value") >= 9).alias("is_correct"),
        F.get_json_object("props", "$.k").cast("int").alias("question_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
    )


def _batches(spark, sf):
    rows = _batch_log(spark, sf)
    return rows.select("user_id", F.col("session").alias("batch"), "is_correct", "question_id", (F.col("session") % 2 == 0).alias("is_unit_test"))


def _results(spark, sf):
    return P.test_result(_batches(spark, sf).where("is_unit_test").drop("is_unit_test"), ["user_id", "batch"])


@query("test_result", sql([], "SELECT * FROM results", _BATCHES, _RESULT))
def test_result(spark, sf):
    return _results(spark, sf)


@query(
    "graduate",
    sql(
        ["answers", "users"],
        """SELECT u.user_id, CASE WHEN p.user_id IS NULL THEN current_unit ELSE current_unit + 1 END AS current_unit,
             array_to_string(list_sort(CASE WHEN p.user_id IS NULL THEN graduated_units
               ELSE list_append(graduated_units, current_unit) END), ',') AS graduated_units
           FROM users u LEFT JOIN (SELECT DISTINCT user_id FROM results WHERE unit_test_result = 'unit test passed') p ON p.user_id = u.user_id""",
        _BATCHES, _RESULT,
    ),
)
def graduate(spark, sf):
    return P.graduate(B.users(spark, sf), _results(spark, sf).where("unit_test_result = 'unit test passed'"))


# The same batches as sessions that learners hand in, with all their answers and the tags of their questions.
_SUBMITTED = """submitted AS (SELECT user_id, batch, max(ts) AS ts, count(*) FILTER (is_correct) AS n_correct, batch % 2 = 0 AS is_unit_test
    FROM (SELECT *, value >= 9 AS is_correct FROM batches) GROUP BY user_id, batch),
  judged AS (SELECT *, CASE WHEN NOT is_unit_test THEN 'unit test not taken' WHEN n_correct >= 16 THEN 'unit test passed' ELSE 'unit test failed' END AS result FROM submitted),
  counted AS (SELECT j.*, u.current_unit, u.graduated_units,
      coalesce(count(*) FILTER (result = 'unit test passed') OVER (PARTITION BY user_id ORDER BY ts, batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM judged j JOIN users u USING (user_id))"""


def _submissions(spark, sf):
    k = F.col("question_id")
    unit = F.concat(F.lit("unit_"), (3 + (k % 10) % 5).cast("string"))
    question = F.struct(F.array(F.concat(F.lit("tag_"), k % 10), F.lit("listening_vocab"), unit).alias("tags"))
    rows = _batch_log(spark, sf).select("user_id", "session", F.struct("ts", "seq", question.alias("q"), F.col("is_correct").alias("ok")).alias("a"))
    handed = rows.groupBy("user_id", "session").agg(F.array_sort(F.collect_list("a")).alias("a"))
    return handed.select(
        "user_id", F.array_max(F.transform("a", lambda x: x["ts"])).alias("ts"), F.col("session").alias("seq"),
        F.transform("a", lambda x: x["q"]).alias("list_of_question_data"), F.transform("a", lambda x: x["ok"]).alias("is_correct"),
        (F.col("session") % 2 == 0).alias("is_unit_test"),
    )


@query(
    "replay_submissions",
    sql(
        ["users"],
        """SELECT user_id, batch, CAST(n_correct AS INTEGER) AS n_correct, result AS unit_test_result, CAST(current_unit + before AS INTEGER) AS unit_before,
             CAST(current_unit + before + CASE WHEN result = 'unit test passed' THEN 1 ELSE 0 END AS INTEGER) AS unit_after FROM counted""",
        _BATCHES, _SUBMITTED,
    ),
)
def replay_submissions(spark, sf):
    rows = submissions.judged(_submissions(spark, sf), B.users(spark, sf))
    return rows.select("user_id", F.col("seq").alias("batch"), "n_correct", "unit_test_result", "unit_before", "unit_after")


@query(
    "replay_users",
    sql(
        ["users"],
        """SELECT user_id, CAST(any_value(current_unit) + count(*) FILTER (result = 'unit test passed') AS INTEGER) AS current_unit,
             array_to_string(list_sort(list_concat(any_value(graduated_units),
               range(any_value(current_unit), any_value(current_unit) + count(*) FILTER (result = 'unit test passed')))), ',') AS graduated_units
           FROM counted GROUP BY user_id""",
        _BATCHES, _SUBMITTED,
    ),
)
def replay_users(spark, sf):
    users = B.users(spark, sf)
    return submissions.users_after(submissions.judged(_submissions(spark, sf), users), users)


@query(
    "replay_strength",
    sql(
        LEARNER,
        """SELECT user_id, tag, CAST(count(*) FILTER (ok) AS INTEGER) AS correct_count,
             list_reduce(list(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, seq),
               lambda s, x: CASE WHEN x = 1 THEN least(s * 2, 365) ELSE greatest(s * 0.5, 1) END, 1.0::DOUBLE) AS stability
           FROM (SELECT a.*, e.value >= 9 AS ok FROM answers a JOIN events e ON e.event_id = a.seq) WHERE tag IN (SELECT tag FROM tag_units)
           GROUP BY user_id, tag""",
    ),
)
def replay_strength(spark, sf):
    found = submissions.answered_after(_submissions(spark, sf), B.users(spark, sf), B.tag_units(spark, sf), B.now(spark, sf))
    return found.select("user_id", "tag", "correct_count", "stability")


@query(
    "session_score",
    sql([], "SELECT user_id, batch, count(*) FILTER (is_correct) AS score, count(*) AS asked FROM batch_answers GROUP BY ALL", _BATCHES),
)
def session_score(spark, sf):
    return P.session_score(_batches(spark, sf), ["user_id", "batch"])


@query(
    "requeue_rate",
    sql(
        [],
        """SELECT question_id, count(*) AS sessions, CAST(sum(t) AS BIGINT) AS attempts, CAST(sum(t - 1) AS BIGINT) AS retries,
                  CAST(sum(w) AS BIGINT) AS wrong
           FROM (SELECT user_id, batch, question_id, count(*) AS t, count(*) FILTER (NOT is_correct) AS w
                 FROM batch_answers GROUP BY ALL) GROUP BY question_id""",
        _BATCHES,
    ),
)
def requeue_rate(spark, sf):
    return P.requeue_rate(_batches(spark, sf), ["user_id", "batch"])


_WEAK = f"""weak AS (SELECT user_id, count(*) AS n_weak FROM ({_SCORES.format(high='u.current_unit - 1')})
    WHERE strength < 0.70 GROUP BY user_id)"""


@query(
    "route_session",
    sql(
        LEARNER,
        """SELECT u.user_id, u.current_unit, coalesce(n_weak, 0) AS n_weak, ready,
             CASE WHEN len(graduated_units) > 0 AND coalesce(n_weak, 0) > 0 THEN 'review'
                  WHEN ready THEN 'unit_test' ELSE 'learning' END AS route
           FROM users u LEFT JOIN weak w ON w.user_id = u.user_id JOIN ready r ON r.user_id = u.user_id""",
        _WORDS, _READY, _WEAK,
    ),
)
def route_session(spark, sf):
    return route(B.users(spark, sf), B.unit_tags(spark, sf), B.stored_answered(spark, sf), B.tag_units(spark, sf), B.now(spark, sf))


@query("csv_set", sql([], """SELECT c_custkey, array_to_string(list_transform(s, lambda x: CAST(x AS VARCHAR)), ',') AS units, CAST(len(s) AS INTEGER) AS n
    FROM (SELECT c_custkey, list_sort(list_distinct([c_nationkey, c_nationkey % 7, 3])) AS s FROM customer)"""))
def csv_set(spark, sf):
    csv = F.concat_ws(",", "c_nationkey", F.lit(""), F.col("c_nationkey") % 7, F.lit("3"))
    units = scalars.csv_to_units(csv)
    return B.table(spark, sf, "customer").select(
        "c_custkey", scalars.units_to_csv(units).alias("units"), F.size(units).alias("n")
    )


# ------------------------------------------------------------ streams
N_SLICES = 6


def _as_stream(spark, rows, end=None):
    """Rows with ``ts`` as a stream in slices of time, and the delay within which a slice's files come in any order.

    With ``end``, a row of no one (its numbers are -1) comes last, so much later that all windows close.
    """
    days = rows.agg(F.min(F.unix_date(F.to_date("ts"))).alias("a"), F.max(F.unix_date(F.to_date("ts"))).alias("b")).first()
    step = (days["b"] - days["a"]) // N_SLICES + 1
    # One pass over the log, in order of time; a slice is written by as many tasks as it needs.
    staged, folder = shared_dir(spark, "slices"), shared_dir(spark, "events")
    sliced = rows.withColumn("slice", F.floor((F.unix_date(F.to_date("ts")) - days["a"]) / step).cast("int"))
    sliced.repartitionByRange("slice", "ts").write.partitionBy("slice").parquet(staged)
    written = spark.read.schema(sliced.schema).parquet(staged)
    for i in range(N_SLICES):
        written.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(folder)
    if end:
        after = rows.agg((F.max("ts") + F.expr(f"INTERVAL {end}") + F.expr(f"INTERVAL {2 * step + 2} DAYS")).alias("ts"))
        after.select(*[F.col(c) if c == "ts" else F.lit(-1 if t in ("int", "bigint") else None).cast(t).alias(c) for c, t in rows.dtypes]).write.mode("append").parquet(folder)
    # A larger log has more files in a slice; the micro-batches stay as many.
    each = max(4, -(-len(spark.read.schema(rows.schema).parquet(folder).inputFiles()) // N_SLICES))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(folder), f"{step + 1} days"


def _event_stream(spark, sf, end=None):
    return _as_stream(spark, B.answers(spark, sf).drop("unit", "question_id", "day"), end)


@query("stream_strength", sql(LEARNER, _FLAT))
def stream_strength(spark, sf):
    home = shared_dir(spark, "strength")
    answers, late = _event_stream(spark, sf)
    keyed.keep_strength(answers, f"{home}/log", f"{home}/progress", late=late, fold_every=4).awaitTermination()
    return _flat(keyed.kept_strength(spark, f"{home}/log", B.seeds(spark, sf)))


def _window_rows(rows):
    return rows.select(
        "user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "answers", "correct"
    )


@query(
    "practice_windows",
    sql(
        LEARNER,
        """SELECT user_id, epoch_us(w) AS start_us, epoch_us(w + INTERVAL 6 HOUR) AS end_us, count(*) AS answers,
                  count(*) FILTER (is_correct) AS correct
           FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM answers) GROUP BY user_id, w""",
    ),
)
def practice_windows(spark, sf):
    return _window_rows(windows.per_interval(B.answers(spark, sf), "6 hours"))


@query("stream_windows", ORACLE["practice_windows"])
def stream_windows(spark, sf):
    home = shared_dir(spark, "windows")
    answers, late = _event_stream(spark, sf)
    windows.append_intervals(answers, "6 hours", f"{home}/log", f"{home}/progress", late, fold_every=4).awaitTermination()
    return _window_rows(windows.current_intervals(spark, f"{home}/log"))


@query(
    "practice_sittings",
    sql(
        LEARNER,
        """SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS end_us, count(*) AS answers,
                  count(*) FILTER (is_correct) AS correct
           FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, seq) AS sitting
                 FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) + INTERVAL 12 HOUR
                              THEN 0 ELSE 1 END AS fresh FROM answers))
           GROUP BY user_id, sitting""",
    ),
)
def practice_sittings(spark, sf):
    return _window_rows(windows.per_sitting(B.answers(spark, sf), "12 hours"))


@query("stream_sittings", ORACLE["practice_sittings"])
def stream_sittings(spark, sf):
    home = shared_dir(spark, "sittings")
    answers, late = _event_stream(spark, sf, end="12 hours")
    windows.append_sittings(answers, "12 hours", f"{home}/log", f"{home}/progress", late, fold_every=4).awaitTermination()
    return _window_rows(windows.closed_sittings(spark, f"{home}/log").where("user_id >= 0"))


@query(
    "stream_requeue",
    sql(
        [],
        """SELECT question_id, count(DISTINCT (user_id, batch)) AS sessions, count(*) AS attempts,
                  count(*) - count(DISTINCT (user_id, batch)) AS retries, count(*) FILTER (NOT is_correct) AS wrong,
                  count(*) FILTER (after_wrong) AS requeued
           FROM (SELECT *, bool_or(NOT is_correct) OVER (PARTITION BY user_id, batch, question_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_wrong
                 FROM (SELECT *, value >= 9 AS is_correct, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS question_id FROM batches))
           GROUP BY question_id""",
        _BATCHES,
    ),
)
def stream_requeue(spark, sf):
    home = shared_dir(spark, "requeue")
    answers, late = _as_stream(spark, _batch_log(spark, sf), end=_SESSION)
    requeue.append_pairs(answers, f"{home}/log", f"{home}/progress", _SESSION, late, fold_every=4).awaitTermination()
    return requeue.requeue_counts(requeue.read_pairs(spark, f"{home}/log").where("user_id >= 0")).withColumn("question_id", F.col("question_id").cast("int"))
