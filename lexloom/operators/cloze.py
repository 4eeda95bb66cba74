"""Cloze items: solved exercises, generated ones, filled templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.rows import unnest
from lexloom.functions.text import BLANK, cloze_questions, script_units
from lexloom.operators.containment import contained_words


def expand(items: DataFrame, blanked: str = "blanked", answers: str = "answers", gloss: str = "gloss") -> DataFrame:
    """One single-blank question per blank."""
    keep = [c for c in items.columns if c not in (blanked, answers, gloss)]
    found = cloze_questions(F.col(blanked), F.col(answers), F.col(gloss))
    return unnest(items, found, keep, "q", at="blank_no").select(*keep, "blank_no", "q.*")


def generate(sentences: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """For each sentence and each marker of its unit that it contains: blank the first one."""
    found = contained_words(sentences, markers, key)
    own = sentences.join(found, key).join(markers.select("unit", "word").distinct(), ["unit", "word"])
    at = F.instr("text", F.col("word"))
    question = F.concat(
        F.substring("text", F.lit(1), at - 1),
        F.lit(BLANK),
        F.substring(F.col("text"), at + F.length("word"), F.length("text")),
        F.lit("("),
        F.col("gloss"),
        F.lit(")"),
    )
    return own.select(key, "unit", question.alias("question"), F.col("word").alias("answer"))


def validate_filled(filled: DataFrame, unit_text: DataFrame, key: str, script: C.Script = C.CJK) -> DataFrame:
    """Filled templates without leftovers, using only what stands in their unit's text."""
    clean = filled.where(
        ~F.col("text").contains("/") & ~F.col("text").contains("……") & ~F.col("text").contains(BLANK)
    )
    taught = unnest(unit_text, F.array_distinct(script_units(F.col("text"), script)), ["unit"], "tok").distinct()
    used = unnest(clean, F.array_distinct(script_units(F.col("text"), script)), [key, "unit"], "tok")
    foreign = used.join(taught, ["unit", "tok"], "left_anti").select(key).distinct()
    return clean.join(foreign, key, "left_anti")
