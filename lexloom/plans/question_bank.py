"""From lexicon, sentences and cloze items to the tagged question bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.text import cloze_restore
from lexloom.operators import automaton, containment, dedup, questions
from lexloom.operators.ordering import number_within
from lexloom.sources.store import materialise

_TEXTS = ["text", "reading", "gloss", "question", "answer"]
_FIELDS = ["kind", "unit", "section_rank", "seq", "source_text", *_TEXTS]


def _shape(rows: DataFrame) -> DataFrame:
    for field in _TEXTS:
        if field not in rows.columns:
            rows = rows.withColumn(field, F.lit(None).cast("string"))
    return rows.select(*_FIELDS)


def items(lexicon: DataFrame, sentences: DataFrame, cloze: DataFrame, blocklist: DataFrame) -> DataFrame:
    """All items that yield questions, without repeats and blocked sentences."""
    rank = F.lit(0)
    for i, (_, kind) in enumerate(C.SECTIONS):
        rank = F.when(F.col("type") == kind, F.lit(i)).otherwise(rank)
    words = lexicon.select(
        F.col("type").alias("kind"), "unit", rank.alias("section_rank"), "seq",
        F.col("word").alias("source_text"), F.col("word").alias("text"), "reading", "gloss",
    )
    some = sentences.where(F.coalesce(F.col("text"), F.lit("")) != "")
    distinct = dedup.by_key(some.select("unit", "seq", "text", "reading", "gloss"), ["unit", "text"], ["seq"])
    allowed = containment.drop_blocked(distinct, blocklist, F.col("text")).select(
        F.lit("sentence").alias("kind"), "unit", F.lit(3).alias("section_rank"), "seq",
        F.col("text").alias("source_text"), "text", "reading", "gloss",
    )
    one_each = dedup.by_key(cloze.select("unit", "seq", "question", "answer"), ["unit", "question", "answer"], ["seq"])
    restored = one_each.withColumn("source_text", cloze_restore(F.col("question"), F.col("answer")))
    blanks = containment.drop_blocked(restored, blocklist, F.col("source_text")).select(
        F.lit("cloze").alias("kind"), "unit", F.lit(4).alias("section_rank"), "seq", "source_text", "question", "answer"
    )
    return _shape(words).unionByName(_shape(allowed)).unionByName(_shape(blanks))


def place_block() -> Column:
    """Blocks along the order of a unit's questions."""
    return F.col("section_rank") * F.lit(1 << 40) + F.floor(F.col("seq") / questions.ID_BLOCK)


def ask(lexicon: DataFrame, sentences: DataFrame, cloze: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Each item once, with its questions as ``asked``: type, id, and place among all questions of the unit.

    Ids and places are counted on rows without texts; an item's texts move once, to meet them.
    """
    rows = items(lexicon, sentences, cloze, blocklist).drop("source_text")
    stored = materialise(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    bare = stored.select("item", "kind", "unit", "section_rank", "seq", *[F.lit(None).cast("string").alias(c) for c in _TEXTS])
    ids = questions.add_ids(questions.expand_items(bare)).select("item", "unit", "section_rank", "seq", "question_type", "id")
    placed = number_within(ids, ["unit"], ["section_rank", "seq", "id"], place_block(), out="place")
    asked = placed.groupBy("item").agg(F.collect_list(F.struct("question_type", "id", "place")).alias("asked"))
    return stored.join(asked, "item").withColumn("source_text", _source_text())


def _source_text() -> Column:
    """The text that an item was made from; no column of a stored item, as it follows from the others."""
    return F.when(F.col("kind") == "cloze", cloze_restore(F.col("question"), F.col("answer"))).otherwise(F.col("text"))


def expand_asked(rows: DataFrame) -> DataFrame:
    """A row for each of ``asked``, with its id and place. The types of a kind differ, so they tell its questions apart."""
    mine = F.get(F.filter("asked", lambda a: a["question_type"] == F.col("question_type")), F.lit(0))
    found = questions.expand_items(rows).withColumn("_mine", mine).where("_mine IS NOT NULL")
    return found.withColumns({"id": F.col("_mine.id"), "place": F.col("_mine.place")}).drop("_mine", "asked")


def tag(asked: DataFrame, rows: DataFrame, lexicon: DataFrame, limit: automaton.Limit = automaton.LIMIT) -> DataFrame:
    """Questions on items (``rows``) with their ``tags``; both have ``text_id``, a digest of the items' ``source_text``."""
    texts = rows.groupBy("text_id").agg(F.first("source_text").alias("text"))
    found = containment.with_contained(texts, lexicon, "text_id", limit=limit).select("text_id", "words")
    return asked.join(found, "text_id", "left").withColumn(
        "tags",
        containment.question_tags(
            F.coalesce("words", F.array().cast("array<string>")), F.col("question_type"), F.col("unit")
        ),
    )


def tag_records(docs: DataFrame, lexicon: DataFrame, limit: automaton.Limit = automaton.LIMIT) -> DataFrame | None:
    """Documents of untagged records (with ``source_text``) with ``tags`` in its place; None if the lexicon is not within ``limit``."""
    texts = docs.withColumn("_texts", F.transform("records", lambda r: r["source_text"]))
    found = containment.with_contained_each(texts, lexicon, "_texts", "_words", limit)
    if found is None:
        return None

    def tagged(r: Column, words: Column) -> Column:
        tags = containment.question_tags(words, r["question_type"], F.col("unit"))
        return F.struct(*[r[c].alias(c) for c in ("id", "question_type", "question", "answer")], tags.alias("tags"))

    return found.withColumn("records", F.zip_with("records", "_words", tagged)).drop("_texts", "_words")


def build(lexicon: DataFrame, sentences: DataFrame, cloze: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Questions with id, tags and unit.

    Each distinct text is searched for words once. A text's pieces carry its digest, not the text.
    """
    rows = items(lexicon, sentences, cloze, blocklist).withColumn("text_id", F.md5("source_text"))
    tagged = tag(questions.add_ids(questions.expand_items(rows)), rows, lexicon)
    return tagged.select("id", "question_type", "question", "answer", "tags", "unit", "section_rank", "seq")
