"""Progress reports, readiness, test results and session scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.scalars import round_tenth, units_to_csv


def unit_progress(
    users: DataFrame, unit_tags: DataFrame, strength: DataFrame, rules: C.Rules = C.RULES
) -> DataFrame:
    """Per user and unit with tags: how many are learnt and how well.

    A tag the user has no record of counts 0 but stays in the denominator.
    """
    totals = unit_tags.groupBy("unit").agg(F.count("*").cast("int").alias("total_tags"))
    units = totals.agg(F.collect_set("unit")).scalar()
    per_user = (
        strength.join(unit_tags, "tag")
        .groupBy("user_id", "unit")
        .agg(
            F.count_if(F.col("correct_count") >= rules.graduation_count).alias("_grad"),
            F.sum("correct_count").alias("_sum"),
        )
    )
    every = users.withColumn("unit", F.explode(units)).join(totals, "unit")
    rows = every.join(per_user, ["user_id", "unit"], "left")
    graduated = F.coalesce(F.col("_grad"), F.lit(0)).cast("int")
    average = F.coalesce(F.col("_sum"), F.lit(0)) / F.col("total_tags")
    return rows.select(
        "user_id",
        "unit",
        "total_tags",
        graduated.alias("graduated_tags"),
        F.rint(graduated / F.col("total_tags") * 100).cast("int").alias("progress_pct"),
        round_tenth(average).alias("avg_correct_count"),
        F.array_contains("graduated_units", F.col("unit")).alias("is_graduated"),
        (F.col("unit") == F.col("current_unit")).alias("is_current"),
    )


def unit_status(progress: DataFrame) -> DataFrame:
    """Where each unit stands for a user."""
    status = F.when(F.col("is_current"), "current").when(F.col("is_graduated"), "graduated").otherwise("locked")
    return progress.select("user_id", "unit", status.alias("status"), "progress_pct")


def unit_words(users: DataFrame, unit_tags: DataFrame, strength: DataFrame) -> DataFrame:
    """Count per word of the user's current unit, 0 where there is no record."""
    wanted = users.select("user_id", F.col("current_unit").alias("unit")).join(unit_tags, "unit")
    counts = strength.select("user_id", "tag", "correct_count")
    joined = wanted.join(counts, ["user_id", "tag"], "left")
    return joined.select("user_id", "unit", "tag", F.coalesce("correct_count", F.lit(0)).alias("correct_count"))


def unit_ready(
    users: DataFrame, unit_tags: DataFrame, strength: DataFrame, rules: C.Rules = C.RULES
) -> DataFrame:
    """Whether all tags of the current unit are learnt; true for a unit without tags."""
    learnt = F.col("correct_count") >= rules.graduation_count
    words = unit_words(users, unit_tags, strength).groupBy("user_id").agg(
        F.bool_and(learnt).alias("_all"), F.count("*").alias("_n")
    )
    return users.join(words, "user_id", "left").select(
        "user_id",
        "current_unit",
        F.coalesce("_n", F.lit(0)).alias("unit_tags"),
        F.coalesce("_all", F.lit(True)).alias("ready"),
    )


def test_result(answers: DataFrame, session: list[str], rules: C.Rules = C.RULES) -> DataFrame:
    """Passed with enough right answers, however many questions were asked."""
    right = F.count_if("is_correct")
    return answers.groupBy(*session).agg(
        F.count("*").alias("asked"),
        right.alias("correct"),
        F.when(right >= rules.pass_count, "unit test passed").otherwise("unit test failed").alias("unit_test_result"),
    )


def graduate(users: DataFrame, passed: DataFrame) -> DataFrame:
    """Add the current unit to the graduated ones and move on, for users who passed."""
    done = users.join(passed.select("user_id").distinct().withColumn("_passed", F.lit(True)), "user_id", "left")
    moved = F.coalesce("_passed", F.lit(False))
    grown = F.array_union("graduated_units", F.array("current_unit"))
    return done.select(
        "user_id",
        F.when(moved, F.col("current_unit") + 1).otherwise(F.col("current_unit")).alias("current_unit"),
        units_to_csv(F.when(moved, grown).otherwise(F.col("graduated_units"))).alias("graduated_units"),
    )


def set_unit(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Move users to the unit given for them (user_id, new_unit), others stay."""
    moved = users.join(changes.select("user_id", "new_unit"), "user_id", "left")
    return moved.withColumn("current_unit", F.coalesce("new_unit", "current_unit")).drop("new_unit")


def session_score(answers: DataFrame, session: list[str]) -> DataFrame:
    """Right answers out of all asked; a question asked again counts again."""
    return answers.groupBy(*session).agg(
        F.count_if("is_correct").alias("score"), F.count("*").alias("asked")
    )


def requeue_rate(answers: DataFrame, session: list[str]) -> DataFrame:
    """Per question, how often it came back within a session."""
    tries = answers.groupBy(*session, "question_id").agg(
        F.count("*").alias("_tries"), F.count_if(~F.col("is_correct")).alias("_wrong")
    )
    return tries.groupBy("question_id").agg(
        F.count("*").alias("sessions"),
        F.sum("_tries").alias("attempts"),
        F.sum(F.col("_tries") - 1).alias("retries"),
        F.sum("_wrong").alias("wrong"),
    )


def quality_counts(flagged: DataFrame, stages: list[str]) -> DataFrame:
    """Rows, rows dropped by each stage among the survivors of the ones before, and rows left.

    Per (source, unit), per unit and overall.
    """
    alive = F.lit(True)
    counts = []
    for stage in stages:
        ok = F.coalesce(F.col(stage), F.lit(False))
        counts.append(F.count_if(alive & ~ok).alias(f"dropped_{stage}"))
        alive = alive & ok
    return flagged.groupingSets([["source", "unit"], ["unit"], []], "source", "unit").agg(
        F.count("*").alias("extracted"), *counts, F.count_if(alive).alias("final")
    )
