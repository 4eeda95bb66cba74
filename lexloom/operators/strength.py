"""The spaced-repetition model over an answer log.

A right answer doubles the stability of a tag up to a cap, a wrong one halves it
down to a floor, so the order of the answers matters. A run of answers is
one clamped step ``x -> min(max(2**expo * x, lo), hi)``, where ``lo`` and ``hi``
are what the run makes of the floor and of the cap, and two such steps make a
third. The log is therefore range-partitioned by (user, tag, time), each task
reduces its part of a key to one step, and only the steps are put in order.
A key that holds a third of the log is spread over a third of the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.rows import unnest
from lexloom.functions.scalars import retention
from lexloom.operators.containment import content_tags

STEP_SCHEMA = (
    "user_id long, tag string, first_ts timestamp, first_seq long, first_ok boolean, last_ts timestamp, "
    "n long, n_correct long, expo int, lo double, hi double"
)


def most_expo(floor: float, cap: float) -> int:
    """Beyond this exponent a step is constant whatever it is applied to."""
    return math.ceil(math.log2(cap / floor)) + 1


def _then(first: tuple, second: tuple, most: int) -> tuple:
    """The step that does ``first`` and then ``second`` (arrays of expo, lo, hi)."""
    e1, lo1, hi1 = first
    e2, lo2, hi2 = second
    scale = np.exp2(e2.astype(np.float64))
    return (
        np.clip(e1 + e2, -most, most),
        np.minimum(np.maximum(scale * lo1, lo2), hi2),
        np.minimum(np.maximum(scale * hi1, lo2), hi2),
    )


def _reduce_runs(run: np.ndarray, steps: tuple, most: int) -> tuple:
    """Combine neighbours of the same run pairwise until each run is one step."""
    while True:
        n = len(run)
        head = np.ones(n, dtype=bool)
        head[1:] = run[1:] != run[:-1]
        if head.all():
            return steps
        index = np.arange(n)
        offset = index - np.maximum.accumulate(np.where(head, index, 0))
        left = index[offset % 2 == 0]
        right = np.minimum(left + 1, n - 1)
        paired = (left + 1 < n) & (run[right] == run[left])
        both = _then(tuple(s[left] for s in steps), tuple(s[right] for s in steps), most)
        steps = tuple(np.where(paired, b, s[left]) for b, s in zip(both, steps))
        run = run[left]


_ARROW = pa.schema(
    [
        ("user_id", pa.int64()),
        ("tag", pa.string()),
        ("first_ts", pa.timestamp("us", tz="UTC")),
        ("first_seq", pa.int64()),
        ("first_ok", pa.bool_()),
        ("last_ts", pa.timestamp("us", tz="UTC")),
        ("n", pa.int64()),
        ("n_correct", pa.int64()),
        ("expo", pa.int32()),
        ("lo", pa.float64()),
        ("hi", pa.float64()),
    ]
)


def _fold_sorted(batches: Iterator[pa.RecordBatch], floor: float, cap: float) -> Iterator[pa.RecordBatch]:
    """Reduce batches sorted by user, tag and time to one row per key.

    The last key of a batch may go on in the next one, so it waits for it.
    """
    most, held = most_expo(floor, cap), None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = _fold_batch(batch, floor, cap, most)
        if held is not None:
            same = all(held[c][0].as_py() == rows[c][0].as_py() for c in ("user_id", "tag"))
            if same:
                rows = pa.concat_tables([_join_rows(held, rows.slice(0, 1), most), rows.slice(1)])
            else:
                rows = pa.concat_tables([held, rows])
        held = rows.slice(len(rows) - 1)
        yield from rows.slice(0, len(rows) - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _fold_batch(batch: pa.RecordBatch, floor: float, cap: float, most: int) -> pa.Table:
    user = batch.column("user_id").to_numpy(zero_copy_only=False)
    tags = batch.column("tag").dictionary_encode()
    code = tags.indices.to_numpy(zero_copy_only=False)
    right = batch.column("is_correct").to_numpy(zero_copy_only=False).astype(bool)
    head = np.ones(len(user), dtype=bool)
    head[1:] = (user[1:] != user[:-1]) | (code[1:] != code[:-1])
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(user)) - 1
    expo, lo, hi = _reduce_runs(
        np.cumsum(head),
        (
            np.where(right, 1, -1),
            np.where(right, min(2 * floor, cap), floor),
            np.where(right, cap, max(cap / 2, floor)),
        ),
        most,
    )
    first, last = pa.array(starts), pa.array(ends)
    counts = np.add.reduceat(right.astype(np.int64), starts)
    columns = [
        batch.column("user_id").take(first), batch.column("tag").take(first), batch.column("ts").take(first),
        batch.column("seq").take(first), pa.array(right[starts]), batch.column("ts").take(last),
        pa.array(ends - starts + 1), pa.array(counts), pa.array(expo), pa.array(lo), pa.array(hi),
    ]
    return pa.table([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _join_rows(a: pa.Table, b: pa.Table, most: int) -> pa.Table:
    """Two rows of one key as one."""
    x, y = a.to_pylist()[0], b.to_pylist()[0]
    expo, lo, hi = _then(*(tuple(np.array([r[k]]) for k in ("expo", "lo", "hi")) for r in (x, y)), most)
    both = {"n": x["n"] + y["n"], "n_correct": x["n_correct"] + y["n_correct"], "last_ts": y["last_ts"]}
    return pa.Table.from_pylist([x | both | {"expo": int(expo[0]), "lo": float(lo[0]), "hi": float(hi[0])}], schema=_ARROW)


def answer_steps(answers: DataFrame, rules: C.Rules = C.RULES) -> DataFrame:
    """Answers (user_id, tag, ts, seq, is_correct) reduced to steps, a few per key.

    Answers with the same time and sequence number count wrong ones first, so
    the result does not depend on how the log is stored. Answers without user, tag
    or time are ignored, those without a result count as wrong.
    """
    floor, cap = rules.stability_floor, rules.stability_cap
    order = ["user_id", "tag", "ts", "seq", "is_correct"]
    known = answers.where("user_id IS NOT NULL AND tag IS NOT NULL AND ts IS NOT NULL").select(
        "user_id", "tag", "ts", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"),
        F.coalesce("is_correct", F.lit(False)).alias("is_correct"),
    )
    ordered = known.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(lambda batches: _fold_sorted(batches, floor, cap), STEP_SCHEMA)


def _chains(steps: DataFrame, order: tuple[str, ...]) -> DataFrame:
    chain = F.array_sort(F.collect_list(F.struct(*order, "expo", "lo", "hi"))).alias("chain")
    return steps.groupBy("user_id", "tag").agg(chain, F.sum("n_correct").alias("gained"), F.max("last_ts").alias("last_ts"))


def _moved(rows: DataFrame) -> DataFrame:
    moved = F.aggregate(
        "chain",
        F.col("stability"),
        lambda s, step: F.least(F.greatest(s * F.pow(F.lit(2.0), step["expo"]), step["lo"]), step["hi"]),
    )
    return rows.select(
        "user_id",
        "tag",
        (F.col("correct_count") + F.coalesce("gained", F.lit(0))).cast("int").alias("correct_count"),
        F.when(F.col("chain").isNull(), F.col("stability")).otherwise(moved).alias("stability"),
        F.coalesce("last_ts", "last_practice").alias("last_practice"),
    )


def compose(chain: Column, rules: C.Rules = C.RULES) -> Column:
    """A chain of steps, in order, as one: ``expo``, ``lo``, ``hi``."""
    most = most_expo(rules.stability_floor, rules.stability_cap)
    start = F.struct(F.lit(0).alias("expo"), F.lit(rules.stability_floor).alias("lo"), F.lit(rules.stability_cap).alias("hi"))

    def then(a: Column, b: Column) -> Column:
        scale = F.pow(F.lit(2.0), b["expo"])
        return F.struct(
            F.greatest(F.least(a["expo"] + b["expo"], F.lit(most)), F.lit(-most)).alias("expo"),
            F.least(F.greatest(scale * a["lo"], b["lo"]), b["hi"]).alias("lo"),
            F.least(F.greatest(scale * a["hi"], b["lo"]), b["hi"]).alias("hi"),
        )

    return F.aggregate(chain, start, then)


STEP_ORDER = ("first_ts", "first_seq", "first_ok")


def apply_steps(steps: DataFrame, seeds: DataFrame, order: tuple[str, ...] = STEP_ORDER) -> DataFrame:
    """Strength rows after the steps. Answers to tags without a strength row are ignored.

    A key has at most one step per range partition it was spread over.
    """
    return _moved(seeds.join(_chains(steps, order), ["user_id", "tag"], "left"))


def apply_answers(answers: DataFrame, seeds: DataFrame, rules: C.Rules = C.RULES) -> DataFrame:
    """Replay an answer log over the given strength rows."""
    return apply_steps(answer_steps(answers, rules), seeds)


def answered_strength(
    answers: DataFrame, users: DataFrame, tag_units: DataFrame, now: Column, rules: C.Rules = C.RULES
) -> DataFrame:
    """Strength of the tags a user has answered, started from the default row.

    A tag that was never answered has the default row in a store that holds all; here it has none, and
    readers put the default in its place. So the table grows with the answers, not with users times tags.
    """
    steps = answer_steps(answers, rules).join(users.select("user_id"), "user_id", "left_semi")
    steps = steps.join(tag_units.select("tag"), "tag", "left_semi")
    return _moved(_chains(steps, STEP_ORDER).select("*", *_default_row(now, rules)))


def _default_row(now: Column, rules: C.Rules) -> list[Column]:
    return [
        F.lit(0).alias("correct_count"),
        F.lit(rules.seed_stability).alias("stability"),
        (now - F.expr(f"INTERVAL {rules.seed_age_days} DAYS")).alias("last_practice"),
    ]


def batch_answers(batches: DataFrame) -> DataFrame:
    """Submitted batches (parallel arrays of questions and results) to answers per tag."""
    pairs = F.arrays_zip(F.col("list_of_question_data").alias("q"), F.col("is_correct").alias("ok"))
    each = unnest(batches, pairs, ["user_id", "ts"], "a", at="pos")
    tags = unnest(each, content_tags(F.col("a.q.tags")), ["user_id", "ts", "pos", "a.ok"], "tag", at="tag_no")
    return tags.select(
        "user_id", "tag", "ts", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("tag_no")).alias("seq"), F.col("ok").alias("is_correct")
    )


def seed_missing(
    strength: DataFrame, users: DataFrame, tag_units: DataFrame, now: Column, rules: C.Rules = C.RULES
) -> DataFrame:
    """A default row for every tag a user has none of.

    The result is users times tags less the stored rows; only a store that must hold every row needs it.
    Other jobs read ``answered_strength``.
    """
    units = tag_units.agg(F.collect_set("unit")).scalar()
    wanted = users.select("user_id", F.explode(units).alias("unit")).join(tag_units, "unit").select("user_id", "tag")
    missing = wanted.join(strength, ["user_id", "tag"], "left_anti")
    return missing.select("user_id", "tag", *_default_row(now, rules))


def scores(
    strength: DataFrame, users: DataFrame, tag_units: DataFrame, now: Column, low: Column, high: Column
) -> DataFrame:
    """Retention of the tags whose unit is graduated and within [low, high]."""
    rows = strength.join(tag_units, "tag").join(users, "user_id")
    inside = F.col("unit").between(low, high) & F.array_contains("graduated_units", F.col("unit"))
    value = retention(now, F.col("last_practice"), F.col("stability"))
    return rows.where(inside).select(
        "user_id", "tag", "unit", "current_unit", "graduated_units", "stability", value.alias("strength")
    )


def weak_tags(
    strength: DataFrame, users: DataFrame, tag_units: DataFrame, now: Column, rules: C.Rules = C.RULES
) -> DataFrame:
    """Graduated tags of earlier units that are mostly forgotten, of the stored rows."""
    rows = scores(strength, users, tag_units, now, F.lit(rules.first_unit), F.col("current_unit") - 1)
    return rows.where(F.col("strength") < rules.weak_below)


def default_scores(
    strength: DataFrame, users: DataFrame, tag_units: DataFrame, high: Column, most: int | None = None, rules: C.Rules = C.RULES
) -> DataFrame:
    """The graduated tags up to unit ``high`` that a user never answered, with the default's strength.

    ``most`` keeps that many for each user, by tag. The tags of a unit are one value, bounded by the
    lexicon; only the tags that are wanted become rows.
    """
    listed = tag_units.groupBy("unit").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    by_unit = listed.agg(F.map_from_entries(F.collect_list(F.struct("unit", "tags")))).scalar()
    units = F.filter("graduated_units", lambda u: (u >= rules.first_unit) & (u <= high))
    none = F.array().cast("array<struct<tag:string,unit:int>>")
    wanted = F.flatten(F.transform(units, lambda u: F.coalesce(
        F.transform(F.try_element_at("_tags", u), lambda t: F.struct(t.alias("tag"), u.alias("unit"))), none
    )))
    seen = strength.groupBy("user_id").agg(F.collect_set("tag").alias("_seen"))
    rows = users.join(seen, "user_id", "left").withColumn("_tags", by_unit).withColumn("_open", F.array_sort(F.filter(
        wanted, lambda t: ~F.coalesce(F.array_contains("_seen", t["tag"]), F.lit(False))
    )))
    open_tags = F.slice("_open", F.lit(1), F.lit(most)) if most else F.col("_open")
    days = rules.seed_age_days
    value = F.pow(F.lit(0.5), F.lit(float(days)) / F.lit(rules.seed_stability))
    each = unnest(rows, open_tags, ["user_id", "current_unit", "graduated_units"], "t")
    return each.select(
        "user_id", "t.tag", "t.unit", "current_unit", "graduated_units", F.lit(rules.seed_stability).alias("stability"), value.alias("strength")
    )


def count_weak(
    answered: DataFrame, users: DataFrame, tag_units: DataFrame, now: Column, rules: C.Rules = C.RULES
) -> DataFrame:
    """``user_id``, ``n_weak``: graduated tags of earlier units, less those answered and still strong.

    Tags that were never answered are weak; they are counted by unit and never listed.
    """
    sizes = tag_units.groupBy("unit").agg(F.count("*").alias("n"))
    by_unit = sizes.agg(F.map_from_entries(F.collect_list(F.struct("unit", "n")))).scalar()
    earlier = F.filter("graduated_units", lambda u: (u >= rules.first_unit) & (u < F.col("current_unit")))
    every = F.aggregate(earlier, F.lit(0).cast("long"), lambda n, u: n + F.coalesce(F.try_element_at("_sizes", u), F.lit(0)))
    strong = scores(answered, users, tag_units, now, F.lit(rules.first_unit), F.col("current_unit") - 1)
    strong = strong.where(F.col("strength") >= rules.weak_below).groupBy("user_id").agg(F.count("*").alias("_strong"))
    return users.join(strong, "user_id", "left").withColumn("_sizes", by_unit).select("user_id", (every - F.coalesce("_strong", F.lit(0))).alias("n_weak"))
