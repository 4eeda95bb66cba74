"""Duplicate removal and merging of entries, sentences and cloze items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.text import script_only
from lexloom.operators.ordering import first_per_key


def lowest_unit(entries: DataFrame) -> DataFrame:
    """Per word the entry of the lowest unit, ties to the first seen.

    ``first_seq`` is where the word first appeared, the order of the output.
    """
    rest = [c for c in entries.columns if c != "word"]
    best = F.min_by(F.struct(*rest), F.struct("unit", "seq")).alias("best")
    out = entries.groupBy("word").agg(best, F.min("seq").alias("first_seq"))
    return out.select("word", "best.*", "first_seq")


def first_section(entries: DataFrame) -> DataFrame:
    """Per word the entry of the first section that has it."""
    return first_per_key(entries, ["word"], ["section_rank", "seq"])


def by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key; a missing key is a value like any other."""
    return first_per_key(rows, key, order)


def removed_count(rows: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """Rows and rows that ``by_key`` removes, per group (which must be part of the key)."""
    per_key = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return per_key.groupBy(*group).agg(
        F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_removed")
    )


def append_new(existing: DataFrame, fresh: DataFrame, key: str = "text") -> DataFrame:
    """Rows of ``fresh`` whose non-empty key is not there yet, first one per key."""
    usable = fresh.where(F.coalesce(F.col(key), F.lit("")) != "")
    return first_per_key(usable.join(existing.select(key), key, "left_anti"), [key], ["seq"])


def merge_sentences(rows: DataFrame, script: C.Script = C.CJK, text: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per unit, one sentence for each script-only content, best source first.

    Contents meet by digest. With ``keep`` only those columns go along, else all of them and ``content``.
    """
    content = script_only(F.col("text") if text is None else text, script)
    keyed = rows.withColumn("_content", content).where("_content <> ''").withColumn("_content", F.unhex(F.md5("_content")))
    if keep is not None:
        keyed = keyed.select(*dict.fromkeys([*keep, "unit", "source_rank", "seq"]), "_content")
    merged = first_per_key(keyed, ["unit", "_content"], ["source_rank", "seq"]).drop("_content")
    return merged.withColumn("content", content) if keep is None else merged.select(*keep)


def merge_cloze(rows: DataFrame) -> DataFrame:
    """Per unit, one cloze item for each question and answer, best source first."""
    return first_per_key(rows, ["unit", "question", "answer"], ["source_rank", "seq"])


def source_rank(source: Column, order: tuple[str, ...] = ("textbook", "workbook")) -> Column:
    """Named sources first, in order; the others share the last rank."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(source == name, F.lit(i)).otherwise(rank)
    return rank
