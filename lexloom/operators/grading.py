"""Grading of typed and spoken answers, readings of texts, and the audio work list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.romanise import sandhi_syllables, split_syllables, with_tones_match
from lexloom.functions.rows import unnest
from lexloom.functions.scalars import content_key
from lexloom.functions.text import hallucination_flag, has_script, strip, variant_match

_PUNCT = f"(?U)[{C.PUNCT_ROMANISE}\\s]"


def _override(text: Column, overrides: dict[str, str]) -> Column:
    if not overrides:
        return F.lit(None).cast("string")
    pairs = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    return pairs[text]


def readings_of(texts: DataFrame, readings: DataFrame, overrides: dict[str, str] = C.READING_OVERRIDES) -> DataFrame:
    """Distinct texts with their reading: override, else the characters' readings joined.

    ``readings`` (char, reading) is no larger than the script, so it is
    broadcast when small; a character without a reading stands for itself.
    """
    # A text is named by its digest where its characters are rows.
    named = texts.select("text", F.md5("text").alias("_id")).where("text IS NOT NULL")
    bare = named.groupBy("_id").agg(F.first("text").alias("text")).withColumn("bare", F.regexp_replace("text", _PUNCT, ""))
    chars = unnest(bare, F.regexp_extract_all("bare", F.lit("(?s)."), F.lit(0)), ["_id"], "char", at="at")
    read = chars.join(readings.select("char", "reading"), "char", "left").select(
        "_id", "at", F.coalesce(_override(F.col("char"), overrides), "reading", "char").alias("r")
    )
    joined = read.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("at", "r"))).alias("rs"))
    spelled = F.array_join(F.transform("rs", lambda x: x["r"]), "")
    whole = _override(F.col("bare"), overrides)
    return bare.join(joined, "_id", "left").select(
        "text", F.when(whole.isNotNull(), whole).otherwise(F.lower(F.coalesce(spelled, F.lit("")))).alias("reading")
    )


def with_readings(rows: DataFrame, readings: DataFrame, columns: list[str], **kw) -> DataFrame:
    """Add ``<column>_reading`` for each text column."""
    texts = rows.select(F.explode(F.array(*[F.coalesce(c, F.lit("")) for c in columns])).alias("text"))
    table = readings_of(texts, readings, **kw)
    for c in columns:
        named = table.select(F.col("text").alias("_t"), F.col("reading").alias(f"{c}_reading"))
        rows = rows.join(named, F.coalesce(F.col(c), F.lit("")) == F.col("_t")).drop("_t")
    return rows


def homophone_match(rows: DataFrame, readings: DataFrame, given: str = "given", expected: str = "expected", **kw) -> DataFrame:
    """Add ``same_sound``: both are not empty and sound alike."""
    read = with_readings(rows, readings, [given, expected], **kw)
    some = (strip(F.col(given)) != "") & (strip(F.col(expected)) != "")
    heard = with_tones_match(read, F.col(f"{given}_reading"), F.col(f"{expected}_reading"), "same_sound")
    return heard.withColumn("same_sound", F.coalesce(some & F.col("same_sound"), F.lit(False)))


def sound_forms(texts: DataFrame, readings: DataFrame, **kw) -> DataFrame:
    """How texts sound: ``sound`` (the syllables, tones aside) and ``tones`` as spoken, with the texts that sound so.

    A row for each form, with ``n_texts``, ``n_rows`` and ``first_text``. Blank texts have no sound.
    """
    counted = texts.where(strip(F.col("text")) != "").groupBy("text").agg(F.count("*").alias("n"))
    read = readings_of(counted, readings, **kw).withColumn("_s", split_syllables(F.col("reading")))
    heard = read.withColumn("_s", sandhi_syllables(F.col("_s"))).select(
        "text", F.array_join(F.transform("_s", lambda x: x["base"]), " ").alias("sound"), F.array_join(F.transform("_s", lambda x: x["tone"]), "").alias("tones")
    )
    return heard.join(counted, "text").groupBy("sound", "tones").agg(
        F.count("*").alias("n_texts"), F.sum("n").alias("n_rows"), F.min("text").alias("first_text")
    )


def homophone_classes(texts: DataFrame, readings: DataFrame, **kw) -> DataFrame:
    """All texts against each other: for each form, ``n_accepted`` rows that are right where a text of this form is expected.

    Texts are compared by their sound, never in pairs: they are reduced to forms first, so a sound that very many rows share is a
    few rows from then on. A neutral tone in what is expected accepts any, so the forms of a sound are also counted
    with the tones struck out that some form of it leaves open, and a form looks up the count that leaves open what it does.
    """
    forms = sound_forms(texts, readings, **kw)
    opened = F.translate("tones", "1234", "----")
    masks = forms.where(F.contains("tones", F.lit("5"))).select("sound", opened.alias("mask")).distinct()
    struck = F.zip_with(F.split("tones", ""), F.split("mask", ""), lambda t, m: F.when(m == "5", m).otherwise(t))
    counts = forms.join(masks, "sound").select("sound", "mask", F.array_join(struck, "").alias("tones"), "n_rows")
    counts = counts.groupBy("sound", "mask", "tones").agg(F.sum("n_rows").alias("n_accepted"))
    told = forms.withColumn("mask", opened).join(counts, ["sound", "mask", "tones"], "left")
    return told.select("sound", "tones", "n_texts", "n_rows", "first_text", F.coalesce("n_accepted", "n_rows").alias("n_accepted"))


def grade_answers(attempts: DataFrame, readings: DataFrame, **kw) -> DataFrame:
    """Add ``verdict``: exact, homophone (listening sentences only) or wrong."""
    matched = attempts.withColumn("_exact", variant_match(F.col("given"), F.col("expected")))
    read = homophone_match(matched, readings, **kw)
    heard = (F.col("question_type") == "listening sentence") & F.col("same_sound")
    verdict = F.when(F.col("_exact"), "exact").when(heard, "homophone").otherwise("wrong")
    return read.withColumn("verdict", verdict).drop("_exact", "same_sound")


def grade_speech(transcripts: DataFrame, readings: DataFrame, script: C.Script = C.CJK, **kw) -> DataFrame:
    """Transcribed speech against the expected text."""
    read = with_readings(transcripts, readings, ["transcript", "expected"], **kw)
    plain = F.translate(F.lower(strip(F.col("expected"))), " ,", "")
    wanted = F.when(has_script(F.col("expected"), script), F.col("expected_reading")).otherwise(plain)
    flag = hallucination_flag(F.col("transcript"), F.col("expected"))
    out = read.withColumn("hallucination", flag).withColumn("expected_reading", wanted)
    heard = F.when(F.col("hallucination"), F.lit("")).otherwise(F.col("transcript_reading"))
    out = out.withColumn("transcript_reading", heard)
    out = with_tones_match(out, F.col("transcript_reading"), F.col("expected_reading"), "is_correct")
    return out.withColumn("is_correct", ~F.col("hallucination") & F.col("is_correct"))


def audio_worklist(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct (text, slow) whose audio is not there yet."""
    keyed = requests.select("text", "slow").distinct().withColumn("key", content_key(F.col("text"), F.col("slow")))
    return keyed.join(done.select("key"), "key", "left_anti")


def lookup(words: DataFrame, dictionary: DataFrame, readings: DataFrame, **kw) -> DataFrame:
    """Reading and gloss of each word; a word not in the dictionary gets a computed reading."""
    entries = dictionary.select("word", F.col("reading").alias("_reading"), "gloss", F.lit(True).alias("_known"))
    found = words.join(entries, "word", "left")
    computed = readings_of(
        found.where(F.col("_known").isNull()).select(F.col("word").alias("text")), readings, **kw
    ).withColumnRenamed("text", "word").withColumnRenamed("reading", "_computed")
    out = found.join(computed, "word", "left")
    reading = F.when(F.col("_known"), F.col("_reading")).otherwise(F.col("_computed"))
    return out.withColumn("reading", reading).drop("_reading", "_computed", "_known")


def fill_missing(rows: DataFrame, word: str, reading: str, readings: DataFrame, overrides: dict[str, str] = C.MARKER_READINGS) -> DataFrame:
    """Fill absent readings from the overrides, else from the characters."""
    absent = rows.where(F.col(reading).isNull()).select(F.col(word).alias("text"))
    table = readings_of(absent, readings, overrides={}).withColumnRenamed("text", word).withColumnRenamed("reading", "_computed")
    joined = rows.join(table, word, "left")
    return joined.withColumn(reading, F.coalesce(reading, _override(F.col(word), overrides), "_computed")).drop("_computed")
