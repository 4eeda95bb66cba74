"""One build from raw index rows, extracted sentences and solved exercises to the questions of every unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.rows import unnest, where_once
from lexloom.operators import automaton, containment, dedup, segmentation
from lexloom.operators import cloze as cloze_items
from lexloom.operators.ordering import number_within
from lexloom.operators.progress import quality_counts
from lexloom.operators.questions import ID_BLOCK
from lexloom.plans import question_bank, sentence_bank
from lexloom.sources.store import block_of, materialise, unit_documents


def flag_cloze(
    items: DataFrame, docs: DataFrame, lexicon: DataFrame, doc_keys: list[str], script: C.Script = C.CJK, text: Column | None = None
) -> DataFrame:
    """Add ``verbatim`` and ``known`` to solved exercises (``blanked``, ``answers``, ``full``).

    The blanked text must stand in its document, the full one use taught characters only.
    """
    checked = containment.flag_verbatim_cloze(items, docs, doc_keys, "blanked")
    return segmentation.flag_vocab_gate(checked, lexicon, script, F.col("full") if text is None else text)


def cloze_questions(flagged: DataFrame) -> DataFrame:
    """The exercises that passed, one question for each blank; ``source``, ``unit``, ``source_rank`` and ``seq`` are kept."""
    passed = where_once(flagged, F.col("verbatim") & F.col("known"))
    fields = ["source", "unit", "source_rank", "seq", "blanked", "answers", "gloss"]
    return cloze_items.expand(passed.select(*fields))


def build(
    lexicon: DataFrame, flagged_sentences: DataFrame, flagged_cloze: DataFrame, blocklist: DataFrame, script: C.Script = C.CJK,
    text: Column | None = None, tagged: bool = True,
) -> DataFrame:
    """The tagged questions on the lexicon, the sentences and the exercises that passed every check.

    Or, not ``tagged``, the items with the ids of their questions, for ``documents``, which tags them where they end up.
    """
    # Stored one after the other, so that the shuffles of one are gone when the next begins; the second is read twice below.
    passed = sentence_bank.build(flagged_sentences, script, text, ["unit", "seq", "text", "romanised", "gloss"])
    spoken = materialise(passed.withColumnRenamed("romanised", "reading"), "spoken")
    merged = materialise(dedup.merge_cloze(cloze_questions(flagged_cloze).drop("source")), "merged")
    # The blanks of one exercise stand in its place, in their order.
    numbered = number_within(merged, ["unit"], ["seq", "blank_no"], F.floor(F.col("seq") / ID_BLOCK), out="place")
    questions = numbered.drop("seq").withColumnRenamed("place", "seq").select("unit", "seq", "question", "answer")
    return (question_bank.build if tagged else question_bank.ask)(lexicon, spoken, questions, blocklist)


def documents(bank: DataFrame, block_size: int = 10_000, lexicon: DataFrame | None = None, limit: automaton.Limit = automaton.LIMIT) -> DataFrame:
    """The bank as nested documents, the questions of a unit in the order in which they were made.

    ``bank`` has tagged questions or, with a lexicon, items that were not tagged. An item's texts then go once to the task that makes its
    document, in ranges of units; there they become questions and get their tags, which are far larger than the texts.
    """
    if lexicon is None:
        placed = number_within(bank, ["unit"], ["section_rank", "seq", "id"], question_bank.place_block(), out="place")
        return unit_documents(placed, "place", F.struct("id", "question_type", "question", "answer", "tags"), block_size)

    def block(asked: Column) -> Column:
        return block_of(asked["place"], block_size)

    split = unnest(bank, F.array_distinct(F.transform("asked", block)), ["*"], "block")
    mine = split.withColumn("asked", F.filter("asked", lambda a: block(a) == F.col("block")))
    asked = question_bank.expand_asked(mine.repartitionByRange("unit", "block"))
    docs = unit_documents(asked, "place", F.struct("id", "question_type", "question", "answer", "source_text"), block_size, "block")
    tagged = question_bank.tag_records(docs, lexicon, limit)
    if tagged is not None:
        return tagged
    keyed = bank.withColumn("text_id", F.md5("source_text"))
    rows = question_bank.tag(question_bank.expand_asked(keyed), keyed, lexicon, limit)
    return unit_documents(rows, "place", F.struct("id", "question_type", "question", "answer", "tags"), block_size).hint("rebalance", "unit")


def counts(flagged_sentences: DataFrame, flagged_cloze: DataFrame, script: C.Script = C.CJK, text: Column | None = None) -> DataFrame:
    """What each source gave and each check dropped per unit, and in rows without a source what is left after the merge."""
    key = ["source", "unit"]
    sentences = quality_counts(flagged_sentences, ["verbatim", "known", "tagged"]).where("source IS NOT NULL AND unit IS NOT NULL")
    solved = flagged_cloze.groupBy(*key).agg(
        F.count("*").alias("cloze_solved"), F.count_if(~F.col("verbatim")).alias("cloze_dropped_verbatim"),
        F.count_if(F.col("verbatim") & ~F.col("known")).alias("cloze_dropped_known"),
    )
    asked = cloze_questions(flagged_cloze)
    per_source = sentences.join(solved, key, "full").join(asked.groupBy(*key).agg(F.count("*").alias("cloze_final")), key, "full")
    merged = sentence_bank.build(flagged_sentences, script, text).groupBy("unit").agg(F.count("*").alias("final")).join(
        dedup.merge_cloze(asked).groupBy("unit").agg(F.count("*").alias("cloze_final")), "unit", "full"
    )
    names = [c for c in per_source.columns if c not in key]
    return per_source.select(*key, *names).unionByName(
        merged.withColumn("source", F.lit(None).cast("string")), allowMissingColumns=True
    )
