"""Romanised readings: syllables, tones and tone sandhi as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.text import strip

# The initials, finals and tones of ``config`` with common beginnings taken together, so that no place is tried for one after the other.
_FINALS = (
    "i(?:a(?:ng?+|o)?+|ong|ng?+|e|u)?+|u(?:a(?:ng?+|i)?+|eng?+|o|i|n)?+|a(?:ng?+|o|i)?+|e(?:ng?+|i|r)?+|o(?:ng|u)?+|v[en]?+|ng"
)
_SYLLABLE = f"(?:(?:[zcs]h?+|[bpmfdtnlgkhjqxrwy])?+(?:{_FINALS})|ng)[1-5]?+"


def _with_next(array: Column, fn) -> Column:
    """Apply ``fn(element, following element or null)`` over an array in one pass."""
    return F.zip_with(array, F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(0))), fn)


def sandhi_space_tokens(reading: Column) -> Column:
    """``bu4`` becomes ``bu2`` when the next blank-separated token ends in tone 4."""
    tokens = F.filter(F.split(reading, r"(?U)\s+"), lambda t: t != "")
    fixed = _with_next(
        tokens,
        lambda t, after: F.when((t == "bu4") & after.rlike("[a-zv]4$"), F.lit("bu2")).otherwise(t),
    )
    return F.array_join(fixed, " ")


def first_tone(reading: Column) -> Column:
    digit = F.regexp_extract(reading, r"\d", 0)
    return F.when(digit != "", digit.cast("int"))


def sandhi_word_tags(tags: Column, readings: Column, negation: str = "不", one: str = "一") -> Column:
    """Readings of the words of a sentence with 不 and 一 bent to the word that follows."""
    def bend(word: Column, after: Column) -> Column:
        tag, tone = word["tag"], first_tone(after["reading"])
        return (
            F.when(tag == negation, F.when(tone == 4, F.lit("bu2")).otherwise("bu4"))
            .when(
                tag == one,
                F.when(tone.isin(4, 5), F.lit("yi2")).when(tone.isin(1, 2, 3), F.lit("yi4")).otherwise("yi1"),
            )
            .otherwise(word["reading"])
        )

    words = F.zip_with(tags, readings, lambda t, r: F.struct(t.alias("tag"), r.alias("reading")))
    return _with_next(words, bend)


def split_syllables(reading: Column) -> Column:
    """Syllables as ``(base, tone)``; the tone is 5 where none is written."""
    found = F.regexp_extract_all(F.lower(reading), F.lit(_SYLLABLE), F.lit(0))

    def apart(s: Column) -> Column:
        # Only the end of a syllable can be a digit.
        last = F.right(s, F.lit(1))
        return F.struct(F.rtrim(s, F.lit("12345")).alias("base"), F.when(last.between("1", "5"), last).otherwise("5").alias("tone"))

    return F.transform(found, apart)


def sandhi_syllables(syllables: Column) -> Column:
    """Spoken tones; every rule looks at the written tone of the next syllable."""
    def bend(s: Column, following: Column) -> Column:
        base, tone, after = s["base"], s["tone"], following["tone"]
        spoken = (
            F.when((base == "bu") & (tone == "4") & (after == "4"), F.lit("2"))
            .when(
                (base == "yi") & (tone == "1"),
                F.when(after == "4", F.lit("2")).when(after.isin("1", "2", "3"), F.lit("4")).otherwise(tone),
            )
            .when((tone == "3") & (after == "3"), F.lit("2"))
            .otherwise(tone)
        )
        return F.struct(base.alias("base"), spoken.alias("tone"))

    return _with_next(syllables, bend)


def with_tones_match(df: DataFrame, given: Column, expected: Column, out: str) -> DataFrame:
    """Add ``out``: same syllables and tones as spoken; an expected neutral tone accepts any.

    The syllables are columns of their own, so each reading is taken apart once. Equal readings match without being taken apart,
    and those of different lengths never do, so the spoken tones are not worked out for them.
    """
    equal = given == expected
    both = df.withColumns({c: F.when(equal, F.lit(None)).otherwise(split_syllables(x)) for c, x in (("_g", given), ("_e", expected))})
    as_long = F.size("_g") == F.size("_e")
    both = both.withColumns({c: F.when(as_long, sandhi_syllables(F.col(c))) for c in ("_g", "_e")} | {"_as_long": as_long})
    same = F.zip_with(
        "_g", "_e", lambda g, e: (g["base"] == e["base"]) & ((e["tone"] == "5") | (g["tone"] == e["tone"]))
    )
    alike = F.col("_as_long") & F.forall(same, lambda ok: F.coalesce(ok, F.lit(False)))
    return both.withColumn(out, F.when(equal, F.lit(True)).otherwise(alike)).drop("_g", "_e", "_as_long")


def render_syllables(syllables: Column) -> Column:
    return F.array_join(F.transform(syllables, lambda s: F.concat(s["base"], s["tone"])), "")


_VOWELS = "aeiouvüAEIOUVÜ" + C.TONE_MARKED + C.TONE_MARKED.upper()
_BREAKS = " \\-'’"
_MARKED_SYLLABLE = (
    f"[^{_VOWELS}{_BREAKS}]*[{_VOWELS}]+(?:[rR](?![{_VOWELS}]))*"
    f"(?:[nN][gG](?![{_VOWELS}])|[nN](?![{_VOWELS}]))?"
    f"|[^{_VOWELS}{_BREAKS}]+"
)


def diacritic_to_numeric(reading: Column) -> Column:
    """Accented readings to tone digits; text that has digits already is kept.

    A syllable is consonants, vowels and an ``n``, ``ng`` or ``r`` that no vowel
    follows. Its tone is that of its first accented vowel, else neutral.
    """
    text = strip(F.coalesce(reading, F.lit("")))
    marks = C.TONE_MARKED + C.TONE_MARKED.upper()
    plain = C.TONE_PLAIN + C.TONE_PLAIN.upper()
    digits = C.TONE_DIGITS * 2

    def numbered(s: Column) -> Column:
        mark = F.regexp_extract(s, f"[{marks}]", 0)
        tone = F.when(mark == "", F.lit("5")).otherwise(F.translate(mark, marks, digits))
        return F.concat(F.translate(s, marks + "üÜ", plain + "vV"), tone)

    syllables = F.regexp_extract_all(text, F.lit(_MARKED_SYLLABLE), F.lit(0))
    return F.when(text.rlike("[1-5]"), text).otherwise(
        F.array_join(F.transform(syllables, numbered), "")
    )
