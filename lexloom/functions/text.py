"""Column expressions over course text. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import config as C

BLANK = "___"
# Every kind of white space, the ideographic one included.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# A word edge as browsers see it: only ASCII letters, digits and _ are word characters.
_EDGE_L, _EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def blank_to_empty(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def normalize_punct(text: Column, punct: str = C.PUNCT_BANK) -> Column:
    """Delete a punctuation class, then strip."""
    return strip(F.translate(text, punct, ""))


def normalize_width(text: Column) -> Column:
    """Full-width punctuation to ASCII; blanks and tabs dropped, newlines kept."""
    return F.regexp_replace(F.translate(text, C.WIDE_PUNCT, C.NARROW_PUNCT), r"[ \t]+", "")


def script_only(text: Column, script: C.Script = C.CJK) -> Column:
    return F.regexp_replace(text, f"[^{script.chars}]", "")


def has_script(text: Column, script: C.Script = C.CJK) -> Column:
    return text.rlike(f"[{script.chars}]")


def script_units(text: Column, script: C.Script = C.CJK) -> Column:
    """The text as an array of segmentation units."""
    return F.regexp_extract_all(text, F.lit(script.unit), F.lit(0))


def has_paren_hint(text: Column, script: C.Script = C.CJK) -> Column:
    """Text of the script followed by a Latin name in brackets."""
    return text.rlike(rf"[{script.chars}][（(][A-Za-z][A-Za-z\s]*[）)]")


def is_template(text: Column, script: C.Script = C.CJK) -> Column:
    """A line with a gap to fill: blank, ellipsis or slash alternative."""
    slash = rf"[{script.chars}][/／][{script.chars}]"
    return (
        has_script(text, script)
        & (F.length(strip(text)) >= 4)
        & ~has_paren_hint(text, script)
        & (text.contains(BLANK) | text.contains("……") | text.rlike(slash))
    )


def strip_bullet(text: Column) -> Column:
    return F.regexp_replace(text, r"^[（(]?\d+[）)]?\s*", "")


def is_truncated(text: Column, gloss: Column) -> Column:
    """The text breaks off at a comma, or its gloss does."""
    def last(col: Column) -> Column:
        return F.right(F.rtrim(F.coalesce(col, F.lit("")), F.lit(SPACE)), F.lit(1))

    return last(text).isin("，", ",") | (last(gloss) == ",")


def cloze_restore(question: Column, answer: Column) -> Column:
    """The full sentence of a cloze question: gloss cut off, blanks filled."""
    note = F.length(F.substring_index(question, "(", -1)) + 1
    core = F.when(question.contains("("), F.left(question, F.length(question) - note)).otherwise(question)
    return F.replace(strip(core), F.lit(BLANK), answer)


def cloze_questions(blanked: Column, answers: Column, gloss: Column) -> Column:
    """One ``(question, answer)`` per blank, the other blanks filled in.

    Empty when the number of blanks and answers differ.
    """
    parts = F.split(blanked, BLANK)
    note = blank_to_empty(gloss)
    suffix = F.when(note != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise("")

    def question(answer: Column, i: Column) -> Column:
        filled = F.transform(
            parts,
            lambda part, j: F.concat(
                part,
                F.when(j >= F.size(answers), F.lit(""))
                .when(j == i, F.lit(BLANK))
                .otherwise(F.element_at(answers, (j + 1).cast("int"))),
            ),
        )
        return F.struct(
            F.concat(F.array_join(filled, ""), suffix).alias("question"),
            answer.alias("answer"),
        )

    usable = (F.size(answers) > 0) & (F.size(parts) - 1 == F.size(answers))
    return F.when(usable, F.transform(answers, question)).otherwise(F.array())


def clean_answer(text: Column) -> Column:
    """A typed answer without case, punctuation, articles or contractions."""
    out = F.translate(F.lower(text), C.PUNCT_ANSWER, "")
    out = F.regexp_replace(out, r"(?U)([\x{4e00}-\x{9fff}])\s+([\x{4e00}-\x{9fff}])", "$1$2")
    for short, full in [("im", "i am"), ("youre", "you are"), ("hes", "he is"), ("shes", "she is")]:
        out = F.regexp_replace(out, f"{_EDGE_L}{short}{_EDGE_R}", full)
    out = F.regexp_replace(out, f"{_EDGE_L}(?:an|a|the){_EDGE_R}", "")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def variant_match(given: Column, expected: Column) -> Column:
    """The cleaned answer equals one of the comma-separated expected variants."""
    variants = F.transform(F.split(expected, ","), clean_answer)
    return F.array_contains(variants, clean_answer(given))


def is_short_answer(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^A-Za-z0-9\x{4e00}-\x{9fff}]", "")) <= 2


def hallucination_flag(transcript: Column, expected: Column, ratio: int = C.RULES.transcript_ratio) -> Column:
    """Nothing was heard, or far more than was expected."""
    heard = F.length(F.replace(transcript, F.lit(" "), F.lit("")))
    wanted = F.length(F.replace(strip(expected), F.lit(" "), F.lit("")))
    return (F.coalesce(transcript, F.lit("")) == "") | ((wanted > 0) & (heard > wanted * ratio))


def slug(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def normalize_blanks(text: Column) -> Column:
    """Any printed blank (underscores, empty brackets) to ``___``."""
    return F.regexp_replace(text, r"_{2,}|＿+|[（(][ \x{3000}]*[）)]", BLANK)


def quote(text: Column) -> Column:
    """Escape a value for use inside a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def any_of(values: list[str]) -> str:
    """A pattern matching any of the literal values."""
    return "|".join(re.escape(v) for v in values)


def contains_any(text: Column, values: list[str]) -> Column:
    return text.rlike(any_of(values))


STOPS = ".!?。？！"


def runs_of(text: Column, stops: str = STOPS) -> Column:
    """The text cut at line breaks and behind each stop; stops on their own are left out.

    Plain replacing and splitting: the time is linear however long a line without stops is.
    """
    cut = text
    for stop in stops:
        cut = F.replace(cut, F.lit(stop), F.lit(stop + "\n"))
    return F.filter(F.split(cut, "\n"), lambda r: (F.length(r) > 1) | ~F.lit(stops).contains(r))


def sentences_of(text: Column, stops: str = STOPS) -> Column:
    """Runs of text that end in a full stop, question or exclamation mark, stripped."""
    ended = F.filter(runs_of(text, stops), lambda r: F.lit(stops).contains(F.right(r, F.lit(1))))
    return F.transform(ended, strip)


def json_block(text: Column) -> Column:
    """The JSON inside free text: fenced block, else the first balanced brackets, else all."""
    body = strip(text)
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(\[.*?\]|\{.*?\})\s*```", 1)
    return F.coalesce(
        F.when(fenced != "", fenced),
        _balanced(body, "[", "]"),
        _balanced(body, "{", "}"),
        body,
    )


def _balanced(text: Column, opening: str, closing: str) -> Column:
    """From the first opening bracket to the one that closes it, or null."""
    start = F.instr(text, opening)
    pieces = F.split(F.substring(text, start, F.length(text)), re.escape(closing))

    def step(state: Column, piece: Column) -> Column:
        opened = F.length(piece) - F.length(F.replace(piece, F.lit(opening), F.lit("")))
        depth = state["depth"] + opened - 1
        n = state["n"] + 1
        return F.struct(
            n.alias("n"),
            depth.alias("depth"),
            F.coalesce(state["found"], F.when(depth == 0, n)).alias("found"),
        )

    zero = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("found")
    )
    found = F.aggregate(pieces, zero, step)["found"]
    block = F.concat(F.array_join(F.slice(pieces, F.lit(1), found), closing), F.lit(closing))
    # The last piece has no closing bracket behind it, so a hit there is no hit.
    return F.when((start > 0) & (found < F.size(pieces)), block)
