"""Practice sessions: candidates, sampling, review, learning, and the full build."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.catalog import bindings as B
from lexloom.catalog.bindings import LEARNER, sql
from lexloom.catalog.learner import _READY, _WEAK, _WORDS
from lexloom.catalog.registry import query
from lexloom.operators import progress as P
from lexloom.operators import sessions as S
from lexloom.operators.ordering import top_per_key
from lexloom.sources.store import materialise

SEED = "s1"
_CANDIDATES = """candidates AS (SELECT u.user_id, u.current_unit AS unit, x.tag, s.correct_count, t.question_type, t.priority,
      CASE WHEN t.tier = 1 AND s.correct_count >= 2 THEN greatest(s.correct_count, 10) ELSE s.correct_count END AS effective_count
    FROM users u JOIN unit_tags x ON x.unit = u.current_unit JOIN strength s ON s.user_id = u.user_id AND s.tag = x.tag
    JOIN types t ON t.unlock <= s.correct_count)"""
# Every question of a tag, type and unit in an order by hash; a draw names a place among all that may be asked.
_POOL = f"""pool AS (SELECT tag, question_type, unit, id, md5('{SEED}:' || id) AS o FROM tagged)"""


def _drawn(name: str, asked: str) -> str:
    """The questions that may be asked (user_id, tag, question_type, unit, id, o), from a place by hash on and around."""
    return f"""{name} AS (SELECT *, (place - CAST('0x' || substr(md5('{SEED}:' || user_id || ':' || tag || ':' || question_type), 1, 8) AS BIGINT) % n_all + n_all) % n_all AS i
      FROM (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY user_id, tag, question_type) AS n_all
            FROM ({asked}) WINDOW w AS (PARTITION BY user_id, tag, question_type ORDER BY unit, o, id)))"""


def _walked(name: str, drawn: str, order: str, per_tag: int) -> str:
    """The candidates of each user in order; each takes its first question that is still free."""
    listed = f"""{name}_list AS (SELECT user_id, tag, question_type, {order} AS o, list({{'id': id, 'unit': unit}} ORDER BY i) AS ids FROM {drawn} GROUP BY ALL)"""
    item = "{'tag': tag, 'qt': question_type, 'ids': ids, 'picked': []::STRUCT(tag VARCHAR, qt VARCHAR, unit INTEGER, id VARCHAR)[]}"
    free = "list_filter(c.ids, lambda q: NOT list_contains(list_transform(a.picked, lambda p: p.id), q.id))"
    walk = f"""lambda a, c: CASE WHEN len(a.picked) < 10 AND len(list_filter(a.picked, lambda p: p.tag = c.tag)) < {per_tag} AND len({free}) > 0
        THEN {{'tag': '', 'qt': '', 'ids': a.ids, 'picked': list_append(a.picked, {{'tag': c.tag, 'qt': c.qt, 'unit': ({free})[1].unit, 'id': ({free})[1].id}})}} ELSE a END"""
    return f"""{listed},
  {name} AS (SELECT user_id, p.qt AS question_type, p.id AS id, p.unit AS unit, p.tag AS tag FROM (
    SELECT user_id, unnest(list_reduce(list_prepend({{'tag': '', 'qt': '', 'ids': []::STRUCT(id VARCHAR, unit INTEGER)[], 'picked': []::STRUCT(tag VARCHAR, qt VARCHAR, unit INTEGER, id VARCHAR)[]}}, l), {walk}).picked) AS p
    FROM (SELECT user_id, list({item} ORDER BY o) AS l FROM {name}_list GROUP BY user_id)))"""


_LEARNING = _drawn("learning_drawn", "SELECT c.user_id, c.effective_count, c.priority, p.* FROM candidates c JOIN pool p USING (tag, question_type, unit)") + ",\n  " + _walked(
    "learning", "learning_drawn", "(effective_count, -priority, tag)", 2
)
_REVIEW = (
    """graduated AS (SELECT s.user_id, s.tag, u.graduated_units, pow(0.5, (epoch_us(now) - epoch_us(last_practice)) / 86400000000.0 / stability) AS strength
    FROM strength s JOIN tag_units t USING (tag) JOIN users u USING (user_id), clock WHERE t.unit BETWEEN 3 AND 99 AND list_contains(u.graduated_units, t.unit)),
  """
    + _drawn("review_drawn", "SELECT g.user_id, g.strength, t.priority, p.* FROM graduated g JOIN pool p ON p.tag = g.tag AND list_contains(g.graduated_units, p.unit) JOIN types t ON t.question_type = p.question_type")
    + ",\n  "
    + _walked("review", "review_drawn", "(strength, tag, -priority)", 1)
)
# A test of its own for each user and unit: places drawn by hash, then those not drawn.
_TESTS = f"""test_pool AS (SELECT unit, id, question_type, row_number() OVER (PARTITION BY unit ORDER BY md5('{SEED}:' || id), id) - 1 AS place FROM bank),
  test_sizes AS (SELECT unit, count(*) AS n FROM bank GROUP BY unit),
  tries AS (SELECT user_id, unit, i, CASE WHEN i < 80 THEN CAST('0x' || substr(md5('{SEED}:' || user_id || ':' || unit || ':' || i), 1, 8) AS BIGINT) % n ELSE i - 80 END AS place
    FROM (SELECT user_id, current_unit AS unit, n, unnest(range(80 + CASE WHEN n < 80 THEN n ELSE 0 END)) AS i FROM users JOIN test_sizes ON unit = current_unit)),
  tests AS (SELECT user_id, unit, CAST(row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS INTEGER) AS pos, question_type, id
    FROM (SELECT user_id, unit, place, min(i) AS i FROM tries GROUP BY ALL) JOIN test_pool USING (unit, place) QUALIFY pos < 20)"""


def _shuffled(rows: str, kind: str) -> str:
    return f"""SELECT user_id, '{kind}' AS session_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY md5('{SEED}:' || user_id || ':' || id)) - 1 AS INTEGER) AS pos, question_type, id, {{more}} FROM {rows}"""


def _learner(spark, sf, stored=False):
    strength = B.stored_answered(spark, sf) if stored else B.answered(spark, sf)
    return B.users(spark, sf), B.unit_tags(spark, sf), strength


def _pool(spark, sf):
    return materialise(S.question_pool(B.tagged_bank(spark, sf), SEED), "pool")


@query(
    "sort_multi",
    sql([*LEARNER, "types"], "SELECT user_id, tag, question_type, effective_count, CAST(row_number() OVER (PARTITION BY user_id ORDER BY effective_count, priority DESC, tag) AS INTEGER) AS place FROM candidates", _CANDIDATES),
)
def sort_multi(spark, sf):
    from pyspark.sql import Window

    # A user's candidates are the tags of one unit by ten types, so the window is small.
    order = Window.partitionBy("user_id").orderBy("effective_count", F.desc("priority"), "tag")
    ranked = S.learning_candidates(*_learner(spark, sf)).withColumn("place", F.row_number().over(order))
    return ranked.select("user_id", "tag", "question_type", "effective_count", "place")


@query("sample_unit_test", sql(["users", "bank"], "SELECT * FROM tests", _TESTS))
def sample_unit_test(spark, sf):
    takers = B.users(spark, sf).select("user_id", F.col("current_unit").alias("unit"))
    return S.unit_tests(takers, S.unit_pool(B.bank(spark, sf), SEED), SEED)


@query("pick_one", sql(["bank", "tagged"], f"SELECT tag, question_type, arg_min(id, md5('{SEED}:' || id) || id) AS id FROM tagged GROUP BY ALL"))
def pick_one(spark, sf):
    return S.pick_one(B.tagged_bank(spark, sf), SEED)


@query(
    "cap_per_group",
    sql([*LEARNER, "types"], """SELECT user_id, tag, question_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY effective_count, priority DESC, tag) AS r2 FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id, tag ORDER BY effective_count, priority DESC) AS r1 FROM candidates) WHERE r1 <= 2) WHERE r2 <= 10""", _CANDIDATES),
)
def cap_per_group(spark, sf):
    rows = S.learning_candidates(*_learner(spark, sf))
    two = top_per_key(rows, ["user_id", "tag"], ["effective_count", F.desc("priority")], 2)
    return top_per_key(two, ["user_id"], ["effective_count", F.desc("priority"), "tag"], 10).select("user_id", "tag", "question_type")


@query("learning_session", sql([*LEARNER, "types"], _shuffled("learning", "practice_session").format(more="tag, unit"), _CANDIDATES, _POOL, _LEARNING))
def learning_session(spark, sf):
    return S.learning_session(*_learner(spark, sf), _pool(spark, sf), SEED)


@query("srs_review", sql([*LEARNER, "types"], _shuffled("review", "practice_session").format(more="tag, unit"), _POOL, _REVIEW))
def srs_review(spark, sf):
    users, _, strength = _learner(spark, sf, stored=True)
    return S.review_session(strength, users, B.tag_units(spark, sf), _pool(spark, sf), S.question_types(spark), B.now(spark, sf), SEED)


_ROUTES = """routes AS (SELECT u.user_id, u.current_unit, CASE WHEN len(graduated_units) > 0 AND coalesce(n_weak, 0) > 0 THEN 'review' WHEN ready THEN 'unit_test' ELSE 'learning' END AS route
    FROM users u LEFT JOIN weak w ON w.user_id = u.user_id JOIN ready r ON r.user_id = u.user_id)"""
_ALL = (
    _shuffled("review JOIN routes USING (user_id) WHERE route = 'review'", "practice_session").replace(", {more}", "")
    + " UNION ALL "
    + _shuffled("learning JOIN routes USING (user_id) WHERE route = 'learning'", "practice_session").replace(", {more}", "")
    + """ UNION ALL SELECT user_id, 'unit_test', pos, question_type, id FROM tests JOIN routes USING (user_id) WHERE route = 'unit_test'"""
)


@query("shuffle", sql([*LEARNER, "types"], _ALL, _CANDIDATES, _POOL, _LEARNING, _REVIEW, _TESTS, _WORDS, _READY, _WEAK, _ROUTES))
def shuffle(spark, sf):
    users, unit_tags, strength = _learner(spark, sf, stored=True)
    return S.build_sessions(
        users, B.tagged_bank(spark, sf), unit_tags, strength, B.tag_units(spark, sf), S.question_types(spark), B.now(spark, sf), SEED
    )


@query(
    "session_debug",
    sql(
        [*LEARNER, "types"],
        """SELECT r.user_id, r.current_unit, array_to_string(u.graduated_units, ',') AS graduated_units, r.unit_tags, r.ready, coalesce(l.n, 0) AS questions_found,
             coalesce(l.types, '') AS sample_types, coalesce(c.counts, '') AS sample_correct_counts
           FROM ready r JOIN users u USING (user_id)
           LEFT JOIN (SELECT user_id, count(*) AS n, string_agg(DISTINCT question_type, ',' ORDER BY question_type) AS types FROM learning GROUP BY user_id) l USING (user_id)
           LEFT JOIN (SELECT user_id, string_agg(tag || '=' || correct_count, ',' ORDER BY tag) AS counts FROM words GROUP BY user_id) c USING (user_id)""",
        _CANDIDATES, _POOL, _LEARNING, _WORDS, _READY,
    ),
)
def session_debug(spark, sf):
    users, unit_tags, strength = _learner(spark, sf, stored=True)
    session = S.learning_session(users, unit_tags, strength, _pool(spark, sf), SEED)
    found = session.groupBy("user_id").agg(F.count("*").alias("n"), F.collect_set("question_type").alias("types"))
    # The tags of one unit, so the list is bounded by the lexicon.
    count = F.struct("tag", F.concat_ws("=", "tag", "correct_count").alias("c"))
    words = P.unit_words(users, unit_tags, strength).groupBy("user_id").agg(F.array_sort(F.collect_list(count)).alias("counts"))
    ready = P.unit_ready(users, unit_tags, strength).join(users.select("user_id", "graduated_units"), "user_id")
    joined = ready.join(found, "user_id", "left").join(words, "user_id", "left")
    listed = F.transform("counts", lambda c: c["c"])
    return joined.select(
        "user_id", "current_unit", F.array_join("graduated_units", ",").alias("graduated_units"), "unit_tags", "ready",
        F.coalesce("n", F.lit(0)).alias("questions_found"),
        F.coalesce(F.array_join(F.array_sort("types"), ","), F.lit("")).alias("sample_types"),
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("sample_correct_counts"),
    )
