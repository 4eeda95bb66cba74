"""From raw index rows to the lexicon, and the clean-up of a stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.romanise import diacritic_to_numeric, sandhi_space_tokens
from lexloom.functions.text import blank_to_empty, is_truncated
from lexloom.operators import dedup


def classify(section: Column, pos: Column) -> Column:
    """Proper nouns by section, particles and auxiliaries as grammar, the rest as vocabulary."""
    kind = F.lower(blank_to_empty(pos))
    grammar = F.lit(False)
    for prefix in C.GRAMMAR_POS_PREFIXES:
        grammar = grammar | kind.startswith(prefix)
    return (
        F.when(section == "proper_noun", F.lit("proper_noun")).when(grammar, F.lit("grammar")).otherwise(F.lit("vocab"))
    )


def flag_usable(raw: DataFrame) -> DataFrame:
    """Add cleaned ``word``, integer ``unit_no`` and ``usable`` to raw rows."""
    word, reading = blank_to_empty(F.col("word")), blank_to_empty(F.col("reading"))
    unit = F.trim(F.col("unit").cast("string")).try_cast("int")
    clear = ~word.contains(C.UNCLEAR) & ~reading.contains(C.UNCLEAR)
    cleaned = raw.withColumn("word", word).withColumn("unit_no", unit)
    return cleaned.withColumn("usable", (F.col("word") != "") & clear & F.col("unit_no").isNotNull())


def reject_unusable(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the rows skipped."""
    flagged = flag_usable(raw)
    return flagged.where("usable").drop("usable"), flagged.where("NOT usable").drop("usable")


def build(raw: DataFrame) -> DataFrame:
    """Raw rows (word, reading, pos, gloss, unit, section, seq) to one entry per word."""
    usable, _ = reject_unusable(raw)
    entries = usable.select(
        "word",
        diacritic_to_numeric(F.col("reading")).alias("reading"),
        blank_to_empty(F.col("gloss")).alias("gloss"),
        F.col("unit_no").alias("unit"),
        classify(F.col("section"), F.col("pos")).alias("type"),
        "seq",
    )
    return dedup.lowest_unit(entries)


def validate_index(index: DataFrame) -> DataFrame:
    """Fix readings and keep the first entry of each word per section."""
    fixed = index.withColumn("reading", F.when(F.col("reading") != "", sandhi_space_tokens(F.col("reading"))).otherwise(F.col("reading")))
    return dedup.by_key(fixed, ["type", "word"], ["seq"])


def validate_sentences(sentences: DataFrame) -> DataFrame:
    """Fix readings, drop truncated sentences, keep the first of each text per unit."""
    fixed = sentences.withColumn("reading", F.when(F.col("reading") != "", sandhi_space_tokens(F.col("reading"))).otherwise(F.col("reading")))
    whole = fixed.where(~is_truncated(F.col("text"), F.col("gloss")))
    return dedup.by_key(whole, ["unit", "text"], ["seq"])
