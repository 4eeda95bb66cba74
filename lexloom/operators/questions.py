"""The question bank: items to questions, ids, tags and the indexes over tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.rows import unnest
from lexloom.functions.text import slug
from lexloom.operators.containment import content_tags
from lexloom.operators.ordering import number_within

ID_BLOCK = 65_536


def expand_items(items: DataFrame) -> DataFrame:
    """Items (kind, unit, seq and text fields) to questions, per kind as the plan says."""
    def questions(kind: str) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(qtype).alias("question_type"),
                    F.col(q).alias("question"),
                    F.col(a).alias("answer"),
                )
                for qtype, q, a in C.QUESTION_PLAN[kind]
            ]
        )

    plan = F.when(F.col("kind") == "vocab", questions("vocab"))
    for kind in list(C.QUESTION_PLAN)[1:]:
        plan = plan.when(F.col("kind") == kind, questions(kind))
    rows = unnest(items, plan, ["*"], "q").drop("question", "answer")
    return rows.select("*", "q.*").drop("q")


def add_ids(questions: DataFrame) -> DataFrame:
    """``u{unit}_{slug}_{n}``: n counts per unit and type in generation order."""
    slugged = questions.withColumn("_slug", slug(F.col("question_type")))
    block = F.col("section_rank") * F.lit(1 << 40) + F.floor(F.col("seq") / ID_BLOCK)
    numbered = number_within(slugged, ["unit", "_slug"], ["section_rank", "seq"], block, out="_n")
    return numbered.withColumn("id", F.concat(F.lit("u"), "unit", F.lit("_"), "_slug", F.lit("_"), "_n")).drop(
        "_slug", "_n"
    )


def question_tags(questions: DataFrame) -> DataFrame:
    """One row per question and content tag."""
    return unnest(questions, content_tags(F.col("tags")), ["*"], "tag")


def posting_blocks(tagged: DataFrame, block_size: int = 1024) -> DataFrame:
    """Inverted index: the questions of each tag as ordered lists of bounded length.

    A tag is continued in further blocks, so a frequent tag is never one list.
    """
    block = F.floor(F.col("seq") / block_size)
    posted = F.array_sort(F.collect_list(F.struct("seq", "id")))
    blocks = tagged.groupBy("tag", block.alias("block")).agg(posted.alias("p"))
    return blocks.select("tag", "block", F.transform("p", lambda x: x["id"]).alias("ids"))


def first_unit_of_tag(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("tag").agg(F.min("unit").alias("unit"))


def tags_of_unit(questions: DataFrame) -> DataFrame:
    """Distinct tags per unit; a unit without tags keeps one row with a null tag."""
    tags = question_tags(questions).select("unit", "tag").distinct()
    return questions.select("unit").distinct().join(tags, "unit", "left")


def replace_cycle(questions: DataFrame, splits: DataFrame) -> DataFrame:
    """The bank with its parts in turn in place of combined sentences; all other questions stay as they are.

    ``splits`` has ``combined`` and its ordered array ``parts``. Hits are counted
    per combined sentence in unit and question order.
    """
    hit = F.col("question_type").isin(C.SENTENCE_TYPES)
    known = splits.select(F.col("combined").alias("_combined"), F.col("parts").alias("_parts"))
    marked = questions.join(known, hit & (F.col("question") == F.col("_combined")), "left")
    hits = marked.where("_combined IS NOT NULL")
    block = F.col("unit") * F.lit(1 << 40) + F.floor(F.col("seq") / ID_BLOCK)
    counted = number_within(hits, ["_combined"], ["unit", "seq"], block, out="_n")
    part = F.get("_parts", ((F.col("_n") - 1) % F.size("_parts")).cast("int"))
    rest = marked.where("_combined IS NULL").select(*questions.columns)
    return counted.withColumn("question", part).select(*questions.columns).unionByName(rest)


def type_counts(questions: DataFrame) -> DataFrame:
    """Questions per unit and type, with totals per unit and overall."""
    return questions.rollup("unit", "question_type").agg(F.count("*").alias("n"))
