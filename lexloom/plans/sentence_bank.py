"""From extracted sentences to the validated, tagged and merged sentence bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.romanise import sandhi_word_tags
from lexloom.functions.rows import where_once
from lexloom.operators import containment, dedup, segmentation
from lexloom.sources.store import materialise


def flag_stages(
    sentences: DataFrame,
    docs: DataFrame,
    lexicon: DataFrame,
    doc_keys: list[str],
    key: str,
    script: C.Script = C.CJK,
    text: Column | None = None,
    survivors: bool = False,
    **sandhi: str,
) -> DataFrame:
    """Add the outcome of each stage: ``verbatim``, ``known`` and ``tagged``, and the tags and reading.

    Only survivors of a stage go through the next one; with ``survivors`` the others are left out, for who needs no counts. Tags given by an extractor
    are used where they are valid.
    """
    checked = containment.flag_verbatim(sentences, docs, doc_keys)
    gated = segmentation.flag_vocab_gate(checked, lexicon, script, text)
    alive = F.col("verbatim") & F.col("known")
    # Read twice below, once to search for words and once for the result. Not stored, each row would take its document along to the search.
    gated = materialise(where_once(gated, alive) if survivors else gated, "gated")
    if "tags" in sentences.columns:
        content = F.col("text") if text is None else text
        spoken = segmentation.tag_and_romanise(gated.where(alive).withColumn("text", content), lexicon, key, script, **sandhi)
        found = spoken.select(key, F.col("tags").alias("found_tags"), "romanised")
        joined = gated.drop("tags").join(found, key, "left")
        return joined.withColumn("tagged", F.col("found_tags").isNotNull())
    found = segmentation.segment(gated, lexicon, key, script, text, only=alive)
    tagged = F.coalesce(alive & (F.size("tags") > 0), F.lit(False))
    spoken = F.array_join(sandhi_word_tags(F.col("tags"), F.col("readings"), **sandhi), " ")
    return found.withColumns(
        {"tagged": tagged, "romanised": F.when(tagged, spoken), "found_tags": F.when(tagged, F.col("tags"))}
    ).drop("tags", "readings")


def build(flagged: DataFrame, script: C.Script = C.CJK, text: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The sentences that passed every stage, one per content and unit, best source first; of their columns those to ``keep``."""
    passed = flagged.where(F.col("verbatim") & F.col("known") & F.col("tagged"))
    return dedup.merge_sentences(passed, script, text, keep)
