"""Replay of submitted sessions: strength is updated, a unit test is judged, the unit moves, and the next session sees it.

The loop runs over all users at once. A user's unit at a submission is the one at the start and one for each test passed before, so it is a
running count and no state is carried from row to row; what the answers do to the strength of tags does not depend on units, so they
are folded on their own (``operators.strength``). Counts run within blocks of days, so no user is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.scalars import units_to_csv
from lexloom.operators.ordering import count_before, number_within
from lexloom.operators.strength import answered_strength, apply_answers, batch_answers

NOT_TAKEN, PASSED, FAILED = "unit test not taken", "unit test passed", "unit test failed"


def judged(submissions: DataFrame, users: DataFrame, rules: C.Rules = C.RULES) -> DataFrame:
    """Each submission of a known user with ``n_correct``, ``unit_test_result``, ``unit_before`` and ``unit_after``.

    ``submissions`` has user_id, ts, seq (order among equal times), list_of_question_data, is_correct, is_unit_test; null flags
    count as false. Passing needs the full number of right answers, however many questions were asked.
    """
    right = F.size(F.filter(F.coalesce("is_correct", F.array().cast("array<boolean>")), lambda ok: F.coalesce(ok, F.lit(False))))
    test = F.coalesce("is_unit_test", F.lit(False))
    rows = submissions.withColumn("n_correct", right).withColumn(
        "unit_test_result", F.when(~test, NOT_TAKEN).when(F.col("n_correct") >= rules.pass_count, PASSED).otherwise(FAILED)
    )
    passed = F.col("unit_test_result") == PASSED
    counted = count_before(rows, ["user_id"], ["ts", "seq"], F.unix_date(F.to_date("ts")), passed, "_passed")
    units = users.select("user_id", F.col("current_unit").alias("_start"))
    known = counted.join(units, "user_id").withColumn("unit_before", (F.col("_start") + F.col("_passed")).cast("int"))
    return known.withColumn("unit_after", F.col("unit_before") + passed.cast("int")).drop("_start", "_passed")


def users_after(judgements: DataFrame, users: DataFrame) -> DataFrame:
    """Users with the unit they are in and the units they have graduated from, after all submissions."""
    passed = judgements.where(F.col("unit_test_result") == PASSED).groupBy("user_id").agg(F.count("*").cast("int").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    gained = F.when(n > 0, F.sequence(F.col("current_unit"), F.col("current_unit") + n - 1)).otherwise(F.array().cast("array<int>"))
    return users.join(passed, "user_id", "left").select(
        "user_id", (F.col("current_unit") + n).cast("int").alias("current_unit"),
        units_to_csv(F.array_union("graduated_units", gained)).alias("graduated_units"),
    )


def answers_of(submissions: DataFrame) -> DataFrame:
    """The answers of all submissions per content tag, in the order they count: by submission, question and tag.

    A submission has fewer than 65,536 questions, a question fewer tags than that.
    """
    numbered = number_within(submissions, ["user_id"], ["ts", "seq"], F.unix_date(F.to_date("ts")), "_no")
    each = batch_answers(numbered.withColumn("ts", F.struct("ts", "_no")))
    place = F.shiftright("seq", 32) * 65536 + F.col("seq").bitwiseAND(65535)
    return each.select("user_id", "tag", F.col("ts.ts").alias("ts"), (F.shiftleft(F.col("ts._no"), 32) + place).alias("seq"), "is_correct")


def strength_after(submissions: DataFrame, seeds: DataFrame, rules: C.Rules = C.RULES) -> DataFrame:
    """Strength rows after all submissions; tags without a row are ignored."""
    return apply_answers(answers_of(submissions), seeds, rules)


def answered_after(submissions: DataFrame, users: DataFrame, tag_units: DataFrame, now: Column, rules: C.Rules = C.RULES) -> DataFrame:
    """The same for users and tags of the lexicon that were answered, from the default row."""
    return answered_strength(answers_of(submissions), users, tag_units, now, rules)
