"""Practice sessions for all learners at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.rows import unnest
from lexloom.functions.scalars import hash_bucket, hash_number, seeded_order
from lexloom.operators import strength as S
from lexloom.operators.ordering import number_within
from lexloom.operators.progress import unit_ready, unit_words
from lexloom.sources.store import materialise

_TYPE_FIELDS = "question_type string, tier int, unlock int, priority int, speaking boolean, sentence boolean, source_type string, slug string"


def _type_rows(rules: C.Rules) -> list[tuple]:
    n = len(C.QUESTION_TYPES)
    return [
        (name, tier, rules.tier_unlock[tier - 1], n - i, speaking, sentence, source, name.replace(" ", "_"))
        for i, (name, tier, speaking, sentence, source) in enumerate(C.QUESTION_TYPES)
    ]


def question_types(spark: SparkSession, rules: C.Rules = C.RULES) -> DataFrame:
    """The question types with their unlock count and review priority."""
    return spark.createDataFrame(_type_rows(rules), _TYPE_FIELDS)


def unlocked_types(count: Column, rules: C.Rules = C.RULES) -> Column:
    """Types a tag may be asked with once it was answered right ``count`` times."""
    every = F.array(
        *[
            F.struct(
                F.lit(name).alias("question_type"),
                F.lit(tier).alias("tier"),
                F.lit(unlock).alias("unlock"),
                F.lit(priority).alias("priority"),
            )
            for name, tier, unlock, priority, *_ in _type_rows(rules)
        ]
    )
    return F.filter(every, lambda t: t["unlock"] <= count)


POOL_KEY = ["tag", "question_type", "unit"]


def _numbered(rows: DataFrame, key: list[str], seed: str) -> DataFrame:
    """Number the rows of each key from 0 in an order given by the seed and the id."""
    keyed = rows.withColumn("_o", seeded_order(seed, F.col("id")))
    block = F.conv(F.substring("_o", 1, 2), 16, 10).cast("long")
    numbered = number_within(keyed, key, ["_o", "id"], block)
    return numbered.withColumn("place", F.col("n") - 1).drop("_o", "n")


def question_pool(questions: DataFrame, seed: str) -> DataFrame:
    """Every question of a (tag, question_type, unit) with its ``place`` from 0 on, in an order given by the seed."""
    rows = questions.select(*POOL_KEY, "id").distinct()
    return _numbered(rows, POOL_KEY, seed)


def _offers(pool: DataFrame, types: DataFrame) -> DataFrame:
    """For each tag its types with their fields, and in ``units`` how many questions (``n``) each unit has; bounded by types times units."""
    totals = pool.groupBy(*POOL_KEY).agg(F.count("*").alias("n"))
    units = F.array_sort(F.collect_list(F.struct("unit", "n"))).alias("units")
    typed = totals.groupBy("tag", "question_type").agg(units).join(types.select("question_type", "tier", "unlock", "priority"), "question_type")
    return typed.groupBy("tag").agg(F.collect_list(F.struct("question_type", "tier", "unlock", "priority", "units")).alias("offers"))


def _unit_place(units: Column, place: Column) -> Column:
    """The unit, and the place in it, of a place among the questions of all units one after the other."""
    start = F.struct(place.alias("place"), F.lit(None).cast("int").alias("unit"))

    def step(at: Column, u: Column) -> Column:
        here = F.struct(at["place"].alias("place"), u["unit"].cast("int").alias("unit"))
        behind = F.struct((at["place"] - u["n"]).alias("place"), F.lit(None).cast("int").alias("unit"))
        return F.when(at["unit"].isNotNull(), at).when(at["place"] < u["n"], here).otherwise(behind)

    return F.aggregate(units, start, step)


def _picks(
    tags: DataFrame, pool: DataFrame, types: DataFrame, may: Callable[[Column], Column], order: Callable[[Column], list[Column]],
    per_tag: int, seed: str, rules: C.Rules,
) -> DataFrame:
    """The questions of each user's session: its candidates are walked in order, and each takes its first free question.

    ``tags`` has a row for each user and tag with ``units``, from which its questions may come; a candidate is a tag with one of its
    types that ``may`` be asked and has questions. The questions of the units stand one after the other; the seed names a place
    among all of them, and that place and the ones after it (from the end on to the start) are drawn.

    A candidate with as many questions as a session has always finds a free one. So what comes behind ``per_tag`` such ones of its
    tag, or behind a session's size of those left, is never asked and is not looked up; and the candidate at place ``r`` meets at
    most ``r - 1`` questions that are taken, so it draws no more than ``r``.
    """
    size = rules.session_size

    def candidate(o: Column) -> Column:
        units = F.filter(o["units"], lambda u: F.array_contains("units", u["unit"]))
        n = F.aggregate(units, F.lit(0).cast("long"), lambda n, u: n + u["n"])
        key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order(o))], F.col("tag").alias("tag"), o["question_type"].alias("question_type"))
        return F.struct(key.alias("key"), n.alias("n"), units.alias("units"))

    listed = F.array_sort(F.filter(F.transform(F.filter("offers", may), candidate), lambda c: c["n"] > 0))
    rows = tags.join(_offers(pool, types), "tag").withColumn("_c", listed)
    last = F.get(F.filter("_c", lambda c: c["n"] >= size), F.lit(per_tag - 1))["key"]
    asked = F.filter("_c", lambda c: F.coalesce(c["key"] <= last, F.lit(True)))
    each = unnest(rows, asked, ["user_id"], "_c").select("user_id", "_c.*")
    mine = Window.partitionBy("user_id").orderBy("key")
    sure = F.count_if(F.col("n") >= size).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    ranked = each.withColumns({"_rank": F.row_number().over(mine), "_sure": sure}).where(F.col("_sure") < size)
    # The number is made below the steps, else it would be made again for every step.
    number = hash_number(F.concat_ws(":", F.lit(seed), "user_id", "key.tag", "key.question_type"))
    started = ranked.withColumn("_start", number % F.col("n"))
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.lit(size), F.col("_rank"), F.col("n")) - 1)
    drawn = F.transform(steps, lambda i: _unit_place(F.col("units"), (F.col("_start") + i) % F.col("n")))
    places = unnest(started, drawn, ["user_id", "_rank", "key.tag", "key.question_type"], "_p", at="_i")
    found = places.select("user_id", "_rank", "tag", "question_type", "_i", "_p.*").join(pool, [*POOL_KEY, "place"])
    return _greedy(found, per_tag, size)


def _greedy(drawn: DataFrame, per_tag: int, size: int) -> DataFrame:
    """Walk each user's candidates in order and take free questions.

    A user's candidates are the types of the tags of some units; their number
    does not grow with the answer log.
    """
    ranked = F.array_sort(F.collect_list(F.struct("_rank", "_i", "tag", "question_type", "unit", "id")))
    pick_type = "array<struct<tag:string,question_type:string,unit:int,id:string>>"

    def take(picked: Column, c: Column) -> Column:
        same = lambda p: p["tag"] == c["tag"]
        taken = F.exists(picked, lambda p: (p["id"] == c["id"]) | (same(p) & (p["question_type"] == c["question_type"])))
        fits = (F.size(picked) < size) & ~taken & (F.size(F.filter(picked, same)) < per_tag)
        pick = F.struct(c["tag"].alias("tag"), c["question_type"].alias("question_type"), c["unit"].alias("unit"), c["id"].alias("id"))
        return F.when(fits, F.concat(picked, F.array(pick))).otherwise(picked)

    chosen = F.aggregate("ranked", F.array().cast(pick_type), take)
    return drawn.groupBy("user_id").agg(ranked.alias("ranked")).select("user_id", chosen.alias("picked"))


def _shuffled(sessions: DataFrame, seed: str, session_type: str) -> DataFrame:
    """One row per question, in reproducible random order."""
    keyed = F.array_sort(
        F.transform("picked", lambda p: F.struct(seeded_order(seed, F.col("user_id").cast("string"), p["id"]).alias("o"), p.alias("p")))
    )
    rows = sessions.select("user_id", F.posexplode(keyed).alias("pos", "x"))
    return rows.select("user_id", F.lit(session_type).alias("session_type"), "pos", "x.p.*")


def learning_candidates(
    users: DataFrame, unit_tags: DataFrame, strength: DataFrame, rules: C.Rules = C.RULES
) -> DataFrame:
    """Tags of the current unit, times the types unlocked for them; a tag without a row was never answered."""
    known = unit_words(users, unit_tags, strength)
    typed = unnest(known, unlocked_types(F.col("correct_count"), rules), ["*"], "t")
    count = _effective_count(F.col("t"), rules)
    return typed.select("user_id", "unit", "tag", "correct_count", "t.question_type", "t.priority", count.alias("effective_count"))


def _effective_count(kind: Column, rules: C.Rules) -> Column:
    easy = (kind["tier"] == 1) & (F.col("correct_count") >= rules.easy_after)
    return F.when(easy, F.greatest("correct_count", F.lit(rules.easy_count))).otherwise(F.col("correct_count"))


def learning_session(
    users: DataFrame, unit_tags: DataFrame, strength: DataFrame, pool: DataFrame, seed: str, rules: C.Rules = C.RULES
) -> DataFrame:
    """Least practised tags of the current unit first, at most two questions per tag."""
    tags = unit_words(users, unit_tags, strength).withColumn("units", F.array("unit"))
    unlocked = lambda t: t["unlock"] <= F.col("correct_count")
    order = lambda t: [_effective_count(t, rules), -t["priority"], F.col("tag")]
    picked = _picks(tags, pool, question_types(tags.sparkSession, rules), unlocked, order, rules.max_per_tag, seed, rules)
    return _shuffled(picked, seed, "practice_session")


def review_scores(
    strength: DataFrame, users: DataFrame, tag_units: DataFrame, now: Column, most: int | None = None, rules: C.Rules = C.RULES
) -> DataFrame:
    """Graduated tags with their strength: those answered, and of the others ``most`` for each user (None: all)."""
    low, high = F.lit(rules.first_unit), F.lit(rules.last_unit)
    answered = S.scores(strength, users, tag_units, now, low, high)
    return answered.unionByName(S.default_scores(strength, users, tag_units, high, most, rules))


def _review_picks(scored: DataFrame, pool: DataFrame, types: DataFrame, seed: str, rules: C.Rules) -> DataFrame:
    # A question may belong to any graduated unit, not only to the first one of its tag.
    tags = scored.select("user_id", "tag", "strength", F.col("graduated_units").alias("units"))
    order = lambda t: [F.col("strength"), F.col("tag"), -t["priority"]]
    return _picks(tags, pool, types, lambda t: F.lit(True), order, 1, seed, rules)


def review_session(
    strength: DataFrame, users: DataFrame, tag_units: DataFrame, pool: DataFrame, types: DataFrame, now: Column, seed: str,
    rules: C.Rules = C.RULES,
) -> DataFrame:
    """Most forgotten graduated tags first, each with its best type that has a question.

    ``strength`` holds the answered tags; those never answered come in with the default. The first few tags of a user
    fill the session unless they have no questions; only users left short are gone through with all their tags.
    """
    enough = 2 * rules.session_size
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("strength", "tag"))
    some = review_scores(strength, users, tag_units, now, enough + 1, rules)
    first = some.withColumn("_place", place).where(F.col("_place") <= enough + 1)
    first = materialise(first, "review-tags")
    picked = materialise(_review_picks(first.where(F.col("_place") <= enough).drop("_place"), pool, types, seed, rules), "review-picks")
    full = picked.where(F.size("picked") >= rules.session_size).select("user_id")
    short = first.where(F.col("_place") > enough).select("user_id").join(full, "user_id", "left_anti")
    scored = review_scores(strength, users.join(short, "user_id", "left_semi"), tag_units, now, None, rules)
    rest = _review_picks(scored, pool, types, seed, rules)
    kept = picked.join(short, "user_id", "left_anti")
    return _shuffled(kept.unionByName(rest), seed, "practice_session")


def unit_pool(questions: DataFrame, seed: str) -> DataFrame:
    """Every question of a unit that a test may ask, with its ``place`` from 0 on."""
    eligible = questions.where(F.col("question_type").isin(C.TYPE_NAMES)).select("unit", "id", "question_type").distinct()
    return _numbered(eligible, ["unit"], seed)


def unit_tests(takers: DataFrame, pool: DataFrame, seed: str, rules: C.Rules = C.RULES) -> DataFrame:
    """A random test of its own for every ``user_id`` and ``unit``, without repeats, from all questions of the unit.

    Places are drawn by hash; where the unit has few questions, those not drawn follow.
    """
    size = rules.test_size
    totals = pool.groupBy("unit").agg(F.count("*").alias("_n"))
    n = F.col("_n")
    tries = F.transform(F.sequence(F.lit(0), F.lit(4 * size - 1)), lambda i: hash_bucket(F.concat_ws(":", F.lit(seed), "user_id", "unit", i), n))
    rest = F.when(n < 4 * size, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    places = F.slice(F.array_distinct(F.concat(tries, rest)), 1, size)
    each = unnest(takers.select("user_id", "unit").join(totals, "unit"), places, ["user_id", "unit"], "place", at="pos")
    return each.join(pool, ["unit", "place"]).select("user_id", "unit", "pos", "question_type", "id")


def pick_one(questions: DataFrame, seed: str) -> DataFrame:
    """One reproducible random question per (tag, type)."""
    key = seeded_order(seed, F.col("id"))
    return questions.groupBy("tag", "question_type").agg(F.min_by("id", F.struct(key, "id")).alias("id"))


def route(
    users: DataFrame,
    unit_tags: DataFrame,
    strength: DataFrame,
    tag_units: DataFrame,
    now: Column,
    rules: C.Rules = C.RULES,
) -> DataFrame:
    """Which session each user gets: review, unit test or learning; ``strength`` holds the answered tags."""
    weak = S.count_weak(strength, users, tag_units, now, rules)
    ready = unit_ready(users, unit_tags, strength, rules).select("user_id", "ready")
    rows = users.join(weak, "user_id").join(ready, "user_id")
    n_weak = F.col("n_weak")
    kind = F.when((F.size("graduated_units") > 0) & (n_weak > 0), "review").when(F.col("ready"), "unit_test").otherwise("learning")
    return rows.select("user_id", "current_unit", n_weak.alias("n_weak"), "ready", kind.alias("route"))


def build_sessions(
    users: DataFrame,
    questions: DataFrame,
    unit_tags: DataFrame,
    strength: DataFrame,
    tag_units: DataFrame,
    types: DataFrame,
    now: Column,
    seed: str,
    rules: C.Rules = C.RULES,
) -> DataFrame:
    """The next session of every user, one row per question.

    The routes and the pool are read by several branches, so each is written once.
    """
    routes = route(users, unit_tags, strength, tag_units, now, rules).select("user_id", "route")
    routed = materialise(users.join(routes, "user_id"), "routes")
    pool = materialise(question_pool(questions, seed), "pool")
    fields = ["user_id", "session_type", "pos", "question_type", "id"]
    review = review_session(strength, routed.where("route = 'review'"), tag_units, pool, types, now, seed, rules).select(*fields)
    learning = learning_session(routed.where("route = 'learning'"), unit_tags, strength, pool, seed, rules).select(*fields)
    takers = routed.where("route = 'unit_test'").select("user_id", F.col("current_unit").alias("unit"))
    tests = unit_tests(takers, unit_pool(questions, seed), seed, rules).withColumn("session_type", F.lit("unit_test"))
    return review.unionByName(learning).unionByName(tests.select(*fields))
