"""Verbatim checks, blocklists and tagging by contained words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.rows import unnest
from lexloom.functions.text import BLANK, normalize_punct, normalize_width, slug
from lexloom.operators import automaton, verbatim


def _lines(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Documents as they are searched, and their size as they came, which is no smaller."""
    return docs.select(*keys, normalize_width(F.col("doc_text")).alias("_doc"), F.length("doc_text").alias("_size"))


def flag_verbatim(sentences: DataFrame, docs: DataFrame, keys: list[str], **sizes: int) -> DataFrame:
    """Add ``verbatim``: the sentence stands inside one line of its own document.

    Line breaks survive normalisation, so a match without one stays in a line.
    """
    return verbatim.flag_contained(sentences, _lines(docs, keys), keys, normalize_width(F.col("text")), **sizes)


def flag_verbatim_cloze(items: DataFrame, docs: DataFrame, keys: list[str], blanked: str = "question", **sizes: int) -> DataFrame:
    """Add ``verbatim``: the text around the blanks stands, in order, in one line."""
    parts = F.filter(F.transform(F.split(blanked, BLANK), normalize_width), lambda p: p != "")
    return verbatim.flag_in_order(items, _lines(docs, keys), keys, parts, **sizes)


def block_key(text: Column, punct: str = C.PUNCT_BANK) -> Column:
    return normalize_punct(text, punct)


def drop_blocked(rows: DataFrame, blocklist: DataFrame, text: Column, punct: str = C.PUNCT_BANK) -> DataFrame:
    """Rows whose text, without punctuation, is not on the blocklist."""
    blocked = blocklist.select(block_key(F.col("line"), punct).alias("_key")).distinct()
    keyed = rows.withColumn("_key", block_key(text, punct))
    return keyed.join(blocked, "_key", "left_anti").drop("_key")


def apply_blocklist(questions: DataFrame, blocklist: DataFrame, punct: str = C.PUNCT_BLOCKLIST) -> DataFrame:
    """Drop sentence questions whose question or answer is blocked; keep all other types.

    Two anti joins on one key each instead of one join on either key.
    """
    typed = F.col("question_type").isin(C.SENTENCE_TYPES)
    kept = drop_blocked(questions.where(typed), blocklist, F.col("question"), punct)
    kept = drop_blocked(kept, blocklist, F.col("answer"), punct)
    return questions.where(~typed).unionByName(kept)


def removed_counts(questions: DataFrame, kept: DataFrame, unit: str = "unit") -> DataFrame:
    """How many questions were asked about and how many went, per unit and in all (null)."""
    before = questions.select(unit, F.lit(1).alias("_in"), F.lit(0).alias("_out"))
    after = kept.select(unit, F.lit(0).alias("_in"), F.lit(1).alias("_out"))
    return before.unionByName(after).rollup(unit).agg(
        F.sum("_in").alias("questions"), (F.sum("_in") - F.sum("_out")).alias("removed")
    )


def ngrams(texts: DataFrame, text: str, lengths: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct substrings of each text, of the lengths that occur in the lexicon."""
    # Pieces are cut from an array of characters: a place in a string is found from its start only.
    sized = texts.withColumn("_sizes", lengths.agg(F.collect_set("length")).scalar()).withColumn("_chars", F.split(text, ""))

    def of_length(n: Column) -> Column:
        last = F.length(text) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("_chars", i, n), ""))

    grams = F.array_distinct(F.flatten(F.transform("_sizes", of_length)))
    return unnest(sized, grams, keep, "word")


def with_contained(
    texts: DataFrame, lexicon: DataFrame, key: str, text: str = "text", out: str = "words", limit: automaton.Limit = automaton.LIMIT
) -> DataFrame:
    """Add ``out``: every lexicon word that is a substring of the text, once.

    A lexicon within ``limit`` goes with the tasks, and nothing is shuffled. Of a larger one substrings are looked up by equality;
    the distinct lengths of its words are a handful of numbers.
    """
    words = lexicon.select("word").where("word <> ''").distinct()
    if automaton.fits(words, F.length("word"), limit):
        return texts.withColumn(out, automaton.contained(F.col(text), words.toArrow()["word"].to_pylist()))
    lengths = words.select(F.length("word").alias("length")).distinct()
    found = ngrams(texts, text, lengths, [key]).join(words, "word").groupBy(key).agg(F.collect_set("word").alias(out))
    return texts.join(found, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def with_contained_each(texts: DataFrame, lexicon: DataFrame, array: str, out: str, limit: automaton.Limit = automaton.LIMIT) -> DataFrame | None:
    """Add ``out``: for each text of an array the lexicon words it contains, with nothing shuffled. None if the lexicon is not within ``limit``."""
    words = lexicon.select("word").where("word <> ''").distinct()
    if not automaton.fits(words, F.length("word"), limit):
        return None
    return texts.withColumn(out, automaton.contained_in_each(F.col(array), words.toArrow()["word"].to_pylist()))


def contained_words(texts: DataFrame, lexicon: DataFrame, key: str, text: str = "text", **kw) -> DataFrame:
    """Rows (key, word) for every lexicon word that is a substring of the text."""
    return unnest(with_contained(texts.select(key, text), lexicon, key, text, "_words", **kw), "_words", [key], "word")


def question_tags(words: Column, question_type: Column, unit: Column) -> Column:
    """Contained words longest first, then the type's slug, then the unit's tag."""
    ordered = F.transform(
        F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))),
        lambda x: x["w"],
    )
    unit_tag = F.concat(F.lit(C.UNIT_TAG_PREFIX), unit.cast("string"))
    return F.concat(ordered, F.array(slug(question_type), unit_tag))


def content_tags(tags: Column) -> Column:
    """Tags without the question types and units among them."""
    return F.filter(tags, lambda t: ~t.isin(C.TYPE_SLUGS) & ~t.startswith(C.UNIT_TAG_PREFIX))
