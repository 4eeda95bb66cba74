"""Structure of course text: sections, templates, tables, blanks, dialogue glosses.

A document is one row, so its lines are handled as an array in that row; only
what is found is exploded, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.rows import unnest
from lexloom.functions.text import (
    BLANK,
    contains_any,
    has_paren_hint,
    has_script,
    is_template,
    normalize_blanks,
    runs_of,
    sentences_of,
    strip,
    strip_bullet,
)
from lexloom.operators.ordering import number_within


def _marked_lines(docs: DataFrame, text: str, mark) -> DataFrame:
    """Add ``lines`` and ``marks``: position and value of the lines ``mark`` is not null for,
    each with the position of the next marked line."""
    lined = docs.withColumn("lines", F.split(text, "\n"))
    marks = F.filter(
        F.transform("lines", lambda line, i: F.struct(i.alias("i"), mark(line).alias("mark"))),
        lambda m: m["mark"].isNotNull(),
    )
    marked = lined.withColumn("marks", marks)
    following = F.slice("marks", F.lit(2), F.greatest(F.size("marks"), F.lit(0)))
    ranged = F.zip_with(
        "marks",
        following,
        lambda m, n: F.struct(m["i"].alias("i"), m["mark"].alias("mark"), F.coalesce(n["i"], F.size("lines")).alias("to")),
    )
    return marked.withColumn("marks", ranged)


def _line_run(m: Column) -> Column:
    return F.slice("lines", m["i"] + 1, m["to"] - m["i"])


def extract_sections(
    docs: DataFrame,
    text: str = "text",
    start: list[str] = C.EXERCISE_MARKERS,
    end: list[str] = C.EXERCISE_END_MARKERS,
) -> DataFrame:
    """Add ``kept``: the lines from a start marker up to an end marker.

    An end marker wins on the same line. With nothing kept, all lines are.
    """
    def state(line: Column) -> Column:
        return F.when(contains_any(line, end), F.lit(False)).when(contains_any(line, start), F.lit(True))

    marked = _marked_lines(docs, text, state)
    runs = F.flatten(F.transform(F.filter("marks", lambda m: m["mark"]), _line_run))
    found = marked.withColumn("found", runs)
    some = F.exists("found", lambda line: strip(line) != "")
    return found.withColumn("kept", F.when(some, F.col("found")).otherwise(F.col("lines"))).drop(
        "lines", "marks", "found"
    )


def extract_templates(docs: DataFrame, text: str = "text", script: C.Script = C.CJK, **markers) -> DataFrame:
    """Template sentences of the exercise sections, in order, each once."""
    kept = extract_sections(docs, text, **markers).withColumn(
        "found",
        F.array_distinct(
            F.filter(
                F.transform(
                    F.filter(F.transform("kept", strip), lambda line: is_template(line, script)),
                    lambda line: strip(strip_bullet(line)),
                ),
                lambda line: line != "",
            )
        ),
    )
    keep = [c for c in docs.columns if c != text]
    return unnest(kept, "found", keep, "template", at="seq")


def drop_sections(
    docs: DataFrame,
    text: str = "text",
    heading: str = "^## ",
    skipped: list[str] = C.SKIPPED_HEADINGS,
) -> DataFrame:
    """Leave out the sections whose heading names a skipped kind; text before any heading stays."""
    marked = _marked_lines(docs, text, lambda line: F.when(line.rlike(heading), ~contains_any(line, skipped)))
    before = F.when(F.size("marks") == 0, F.col("lines")).otherwise(
        F.slice("lines", F.lit(1), F.get("marks", F.lit(0))["i"])
    )
    runs = F.flatten(F.transform(F.filter("marks", lambda m: m["mark"]), _line_run))
    return marked.withColumn("kept", F.concat(before, runs)).drop("lines", "marks")


def table_rows(docs: DataFrame, text: str = "text", proper: list[str] = ("Proper Nouns", "专有名词")) -> DataFrame:
    """Rows of the index tables; header, rule and letter divider rows are skipped."""
    keep = [c for c in docs.columns if c != text]
    marked = _marked_lines(docs, text, lambda line: F.when(line.rlike("^## "), contains_any(line, list(proper))))
    runs = F.transform("marks", lambda m: F.struct(m["mark"].alias("proper"), m["i"].alias("first"), _line_run(m).alias("rows")))
    parts = unnest(marked, runs, keep, "s")
    rows = unnest(parts, "s.rows", [*keep, "s.proper", "s.first"], "line", at="n").where(
        F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(r"^[\s|:\-]+$")
    )
    # The text before the first and after the last bar is no cell.
    split = F.split(strip(F.col("line")), r"\|")
    cells = rows.withColumn("cells", F.transform(F.slice(split, F.lit(2), F.greatest(F.size(split) - 2, F.lit(0))), strip))
    body = cells.where(
        ~F.get("cells", F.lit(0)).isin("Word", "词语")
        & ~(F.get("cells", F.lit(0)).rlike("^[A-Z]$") & F.forall(F.slice("cells", F.lit(2), F.greatest(F.size("cells"), F.lit(0))), lambda c: c == ""))
    )

    def cell(vocab: int, proper_at: int) -> Column:
        return F.when(F.col("proper"), F.get("cells", F.lit(proper_at))).otherwise(F.get("cells", F.lit(vocab)))

    pos = F.when(F.col("proper"), F.lit("")).otherwise(F.get("cells", F.lit(2)))
    names = F.create_map(*[F.lit(x) for pair in C.POS_NAMES.items() for x in pair])
    return body.select(
        *keep,
        (F.col("first") + F.col("n")).alias("line_no"),
        cell(0, 0).alias("word"),
        cell(1, 1).alias("reading"),
        pos.alias("pos"),
        F.when(~F.col("proper"), names[pos]).alias("pos_name"),
        cell(3, 2).alias("gloss"),
        F.regexp_extract(cell(4, 3), r"^(\d+)", 1).try_cast("int").alias("unit"),
        F.when(F.col("proper"), F.lit("proper_noun"))
        .when(pos.isin("m.", "part."), F.lit("grammar"))
        .otherwise(F.lit("vocab"))
        .alias("type"),
    )


def find_cloze(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every sentence with a printed blank, all blank shapes as ``___``."""
    keep = [c for c in docs.columns if c != text]
    found = F.filter(runs_of(normalize_blanks(F.col(text))), lambda r: r.contains(BLANK))
    return unnest(docs, F.transform(found, strip), keep, "blanked", at="seq")


def find_sentences(docs: DataFrame, text: str = "text", script: C.Script = C.CJK) -> DataFrame:
    """Complete sentences without blanks, ellipses, slash alternatives or name hints."""
    keep = [c for c in docs.columns if c != text]
    rows = unnest(docs, sentences_of(F.col(text)), keep, "sentence", at="seq")
    s = F.col("sentence")
    slash = rf"[{script.chars}][/／][{script.chars}]"
    return rows.where(
        has_script(s, script)
        & ~s.contains(BLANK)
        & ~s.contains("……")
        & ~s.rlike(slash)
        & ~has_paren_hint(s, script)
    )


def pair_gloss(lines: DataFrame, doc: str, order: str, is_gloss: Column, text: str = "text") -> DataFrame:
    """Pair the n-th source line of a block with its n-th gloss line.

    A block is a run of source lines and the run of gloss lines after it, so a line without a gloss shifts
    no pair of another block. ``n`` counts within the block.
    """
    flagged = lines.select(doc, F.col(order).alias("at"), F.col(text).alias("line"), is_gloss.alias("gloss"))
    along = Window.partitionBy(doc).orderBy("at")
    opens = ~F.col("gloss") & F.coalesce(F.lag("gloss").over(along), F.lit(False))
    blocked = flagged.withColumn("_opens", opens.cast("int")).withColumn("block", F.sum("_opens").over(along)).drop("_opens")
    numbered = number_within(blocked, [doc, "block", "gloss"], ["at"], F.floor(F.col("at") / 4096))
    key = [doc, "block", "n"]
    source = numbered.where(~F.col("gloss")).select(*key, F.col("line").alias("source_line"))
    gloss = numbered.where("gloss").select(*key, F.col("line").alias("gloss_line"))
    return source.join(gloss, key)


def quality_markers(lines: DataFrame, group: list[str], line: str = "line") -> DataFrame:
    """How often the transcriber gave up, per group."""
    counts = [
        F.count_if(F.col(line).contains(marker)).alias(f"n_{name}") for name, marker in C.QUALITY_MARKERS.items()
    ]
    return lines.groupBy(*group).agg(F.count("*").alias("n_lines"), *counts)

