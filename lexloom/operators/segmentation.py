"""Known vocabulary by unit, the vocabulary gate, and longest-match segmentation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom import config as C
from lexloom.functions.romanise import sandhi_word_tags
from lexloom.functions.rows import unnest
from lexloom.functions.text import script_only, script_units
from lexloom.operators import automaton


def known_word_counts(lexicon: DataFrame, units: DataFrame) -> DataFrame:
    """Words known by each unit: a running total over units instead of a range join."""
    first = lexicon.groupBy("word").agg(F.min("unit").alias("unit"))
    per_unit = first.groupBy("unit").agg(F.count("*").alias("_new"))
    every = units.select("unit").distinct().join(per_unit, "unit", "full")
    # One row per unit is left here, so one task for the running total is enough.
    upto = Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    return every.select("unit", F.coalesce(F.sum("_new").over(upto), F.lit(0)).alias("n_known"))


def first_units(lexicon: DataFrame, script: C.Script = C.CJK) -> DataFrame:
    """Unit in which each character is first taught; no larger than the script."""
    chars = unnest(lexicon, F.array_distinct(F.split(script_only(F.col("word"), script), "")), ["unit"], "ch")
    return chars.where("ch <> ''").groupBy("ch").agg(F.min("unit").alias("unit"))


def known_chars(lexicon: DataFrame, units: DataFrame, script: C.Script = C.CJK) -> DataFrame:
    """Per unit, all characters taught up to it, as one sorted string."""
    taught = first_units(lexicon, script).agg(F.collect_list(F.struct("unit", "ch"))).scalar()
    rows = units.select("unit").distinct().withColumn("taught", taught)
    upto = F.transform(F.filter("taught", lambda t: t["unit"] <= F.col("unit")), lambda t: t["ch"])
    return rows.select("unit", F.array_join(F.array_sort(upto), "").alias("known"))


def passes_gate(text: Column, known: Column, script: C.Script = C.CJK) -> Column:
    """No character of the script is left once the known ones are taken out."""
    return F.length(F.call_function("translate", script_only(text, script), known, F.lit(""))) == 0


def flag_vocab_gate(
    rows: DataFrame, lexicon: DataFrame, script: C.Script = C.CJK, text: Column | None = None
) -> DataFrame:
    """Add ``known``: all characters of the text are taught by the row's unit.

    The known characters of each unit of the lexicon are one value, no larger
    than units times script, that every row looks into. The texts are neither
    exploded nor joined nor shuffled.
    """
    content = F.col("text") if text is None else text
    per_unit = known_chars(lexicon, lexicon, script)
    taught = per_unit.agg(F.array_sort(F.collect_list(F.struct("unit", "known")))).scalar()
    looked = rows.withColumn("_taught", taught)
    upto = F.filter("_taught", lambda t: t["unit"] <= F.col("unit"))
    mine = F.coalesce(F.get(upto, F.size(upto) - 1)["known"], F.lit(""))
    return looked.withColumn("_mine", mine).withColumn("known", passes_gate(content, F.col("_mine"), script)).drop(
        "_taught", "_mine"
    )


def phrase_lexicon(lexicon: DataFrame, script: C.Script = C.CJK) -> DataFrame:
    """Words as runs of segmentation units: ``phrase`` and its ``length``.

    Words without a unit of the script are dropped: they could never be matched.
    """
    units = script_units(F.col("word"), script)
    return lexicon.select(
        "*", F.array_join(units, script.joiner).alias("phrase"), F.size(units).alias("length")
    ).where("length > 0")


def _matches(texts: DataFrame, lexicon: DataFrame, key: str, script: C.Script) -> DataFrame:
    """Per text all words that match somewhere, ordered by place and preference."""
    words = phrase_lexicon(lexicon, script)
    units = texts.select(
        key,
        F.col("unit").alias("text_unit"),
        script_units(F.col("text"), script).alias("units"),
        words.agg(F.collect_set("length")).scalar().alias("sizes"),
    )

    def runs(i: Column) -> Column:
        fitting = F.filter("sizes", lambda n: i + n <= F.size("units"))
        return F.transform(
            fitting,
            lambda n: F.struct(
                i.alias("at"), F.array_join(F.slice("units", i + 1, n), script.joiner).alias("phrase")
            ),
        )

    positions = F.transform("units", lambda _, i: i)
    grams = unnest(units, F.flatten(F.transform(positions, runs)), [key, "text_unit"], "g")
    hits = grams.select(key, "text_unit", "g.*").join(words, "phrase").where("unit <= text_unit")
    reading = F.col("reading") if "reading" in lexicon.columns else F.lit(None).cast("string")
    hit = F.struct(
        "at", (-F.length("word")).alias("shorter"), "seq", "word", "length", reading.alias("reading")
    )
    return hits.groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias("matches"))


def segment(
    texts: DataFrame,
    lexicon: DataFrame,
    key: str,
    script: C.Script = C.CJK,
    text: Column | None = None,
    only: Column | None = None,
    limit: automaton.Limit = automaton.LIMIT,
) -> DataFrame:
    """Longest-match segmentation with the words known by the text's unit.

    A lexicon within ``limit`` goes with the tasks and nothing is shuffled; a larger one is joined to all runs of units.

    Adds ``tags`` and ``readings``: the words in order and how they are read, or
    null if any position has no match. There is no going back: a dead end is
    null even if another split exists. Rows that are not ``only`` are kept
    without looking for words in them.
    """
    content = F.col("text") if text is None else text
    words = phrase_lexicon(lexicon, script)
    if automaton.fits(words, F.col("length"), limit):
        reading = F.col("reading") if "reading" in lexicon.columns else F.lit(None).cast("string")
        entries = words.select(script_units(F.col("word"), script).alias("phrase"), "word", "unit", "seq", reading.alias("reading")).toArrow()
        units = script_units(content, script)
        looked = automaton.segmented(units if only is None else F.when(only, units), F.col("unit"), entries)
        rows = texts.drop("tags", "readings").withColumn("_found", looked)
        return rows.withColumns({"tags": F.col("_found.tags"), "readings": F.col("_found.readings")}).drop("_found")

    wanted = texts if only is None else texts.where(only)
    searched = wanted.select(key, "unit", content.alias("text"))
    joined = texts.drop("tags", "readings").join(_matches(searched, lexicon, key, script), key, "left")
    size = F.size(script_units(content, script))
    at, length = (F.transform("matches", lambda m: m[f]) for f in ("at", "length"))
    nothing = F.array().cast("array<struct<word:string,reading:string>>")
    walked = F.transform(
        _path(at, length, size), lambda i: F.struct(F.get("matches", i)["word"].alias("word"), F.get("matches", i)["reading"].alias("reading"))
    )
    hits = F.when(F.col("matches").isNotNull(), walked).when(size == 0, nothing)
    done = joined.withColumn("hits", hits if only is None else F.when(only, hits))
    return done.withColumns(
        {"tags": F.transform("hits", lambda h: h["word"]), "readings": F.transform("hits", lambda h: h["reading"])}
    ).drop("hits", "matches")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _path(at: pa.Array, length: pa.Array, size: pa.Array) -> pa.Array:
    """Which matches are taken from place 0 on, or null if they end before ``size``.

    Matches come by place, the preferred one first; all rows are walked in step.
    """
    sizes = np.maximum(size.fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    starts = np.append(0, np.cumsum(sizes))
    many = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, number = np.repeat(np.arange(len(sizes)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    place = starts[row] + at.flatten().to_numpy(zero_copy_only=False)
    ahead, kept = np.unique(place, return_index=True)
    first, step = np.full(int(starts[-1]), -1, np.int64), np.zeros(int(starts[-1]), np.int64)
    first[ahead], step[ahead] = number[kept], length.flatten().to_numpy(zero_copy_only=False)[kept]
    who, what, done = automaton.follow(first, step, starts)
    valid = done & np.asarray(at.is_valid())
    keep = valid[who]
    return automaton.lists(who[keep], len(sizes), pa.array(what[keep].astype(np.int32)), valid)


def validate_tags(rows: DataFrame, lexicon: DataFrame, key: str, script: C.Script = C.CJK) -> DataFrame:
    """Add ``valid``: tags are not empty, all known by the unit, and spell the text.

    ``readings`` holds how the tags are read.
    """
    reading = F.col("reading") if "reading" in lexicon.columns else F.lit(None).cast("string")
    words = lexicon.groupBy(F.col("word").alias("tag")).agg(
        F.min("unit").alias("_first"), F.min_by(reading, F.col("seq")).alias("_reading")
    )
    tags = unnest(rows, "tags", [key, "unit"], "tag", at="at")
    checked = tags.join(words, "tag", "left").groupBy(key).agg(
        F.bool_and(F.coalesce(F.col("_first") <= F.col("unit"), F.lit(False))).alias("_allowed"),
        F.array_sort(F.collect_list(F.struct("at", "_reading"))).alias("_read"),
    )

    def spelled(text: Column) -> Column:
        return F.array_join(script_units(text, script), script.joiner)

    same = F.array_join(F.transform("tags", spelled), script.joiner) == spelled(F.col("text"))
    joined = rows.join(checked, key, "left")
    valid = (F.size("tags") > 0) & F.col("_allowed") & same
    return joined.withColumns(
        {"valid": F.coalesce(valid, F.lit(False)), "readings": F.transform("_read", lambda x: x["_reading"])}
    ).drop("_allowed", "_read")


def tag_and_romanise(
    rows: DataFrame,
    lexicon: DataFrame,
    key: str,
    script: C.Script = C.CJK,
    negation: str = "不",
    one: str = "一",
) -> DataFrame:
    """Given tags if valid, else the segmentation, else the row is dropped; plus the reading."""
    if "tags" in rows.columns:
        given = validate_tags(rows, lexicon, key, script).withColumnsRenamed({"tags": "_given", "readings": "_read"})
        found = segment(given, lexicon, key, script, only=~F.col("valid"))
        tagged = found.withColumns(
            {
                "tags": F.when(F.col("valid"), F.col("_given")).otherwise(F.col("tags")),
                "readings": F.when(F.col("valid"), F.col("_read")).otherwise(F.col("readings")),
            }
        ).drop("valid", "_given", "_read")
    else:
        tagged = segment(rows, lexicon, key, script)
    # An empty segmentation (a text without script) is no valid tagging.
    kept = tagged.where(F.size("tags") > 0)
    spoken = sandhi_word_tags(F.col("tags"), F.col("readings"), negation, one)
    return kept.withColumn("romanised", F.array_join(spoken, " ")).drop("readings")


def word_units(text: Column, words: list[str], script: C.Script = C.CJK) -> Column:
    """Split a text into runs outside the script, the longest word, or one character. The words have been found to fit a task."""
    inside = F.regexp_replace(text, f"[{script.chars}]", "\x01")
    return automaton.split(text, inside, words)


def _of_script(tags: DataFrame, script: C.Script) -> DataFrame:
    """The distinct tags (a column ``tag``) that have a character of the script."""
    return tags.select("tag").where(F.col("tag").rlike(f"[{script.chars}]")).distinct()


def usable_words(tags: DataFrame, script: C.Script = C.CJK, limit: automaton.Limit = automaton.LIMIT) -> list[str]:
    """The distinct tags that have a character of the script, if they are few enough to go with the tasks."""
    words = _of_script(tags, script)
    if not automaton.fits(words, F.length("tag"), limit):
        raise ValueError(f"more than {limit.words} words or {limit.symbols} characters")
    return sorted(words.toArrow()["tag"].to_pylist())


def with_word_units(
    rows: DataFrame, tags: DataFrame, text: str, out: str = "units", script: C.Script = C.CJK, limit: automaton.Limit = automaton.LIMIT
) -> DataFrame:
    """Add ``out``: the text split by ``word_units`` at the tags.

    Tags within ``limit`` go with the tasks. More of them are joined to the substrings of the distinct texts, and the longest at each
    place goes back to its text.
    """
    words = _of_script(tags, script)
    if automaton.fits(words, F.length("tag"), limit):
        return rows.withColumn(out, word_units(F.col(text), sorted(words.toArrow()["tag"].to_pylist()), script))
    sizes = words.agg(F.array_sort(F.collect_set(F.length("tag")))).scalar()
    texts = rows.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    cut = texts.select("_text", F.split("_text", "").alias("_chars"), sizes.alias("_sizes"))

    def starting(at: Column) -> Column:
        fitting = F.filter("_sizes", lambda n: at + n <= F.size("_chars"))
        return F.transform(fitting, lambda n: F.struct(at.alias("at"), n.alias("n"), F.array_join(F.slice("_chars", at + 1, n), "").alias("tag")))

    grams = unnest(cut, F.flatten(F.transform("_chars", lambda _, i: starting(i))), ["_text"], "_g").select("_text", "_g.*")
    longest = grams.join(words, "tag").groupBy("_text", "at").agg(F.max("n").alias("n"))
    hits = longest.groupBy("_text").agg(F.collect_list(F.struct("at", "n")).alias("_hits"))
    joined = rows.join(hits, F.col(text) == F.col("_text"), "left").drop("_text")
    inside = F.regexp_replace(text, f"[{script.chars}]", "\x01")
    at, size = (F.coalesce(F.transform("_hits", lambda h: h[c]), F.array().cast("array<int>")) for c in ("at", "n"))
    return joined.withColumn(out, automaton.split_at(F.col(text), inside, at, size)).drop("_hits")
