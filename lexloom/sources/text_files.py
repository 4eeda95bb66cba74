"""Course text: whole files, lines and page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.rows import unnest
from lexloom.functions.text import strip
from lexloom.operators.ordering import next_within


def read_course_text(spark: SparkSession, path: str) -> DataFrame:
    """Files named ``<source>_unit<N>.<ext>`` as rows of source, unit and text."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(name, r"^(.*?)_?unit_?(\d+)", 1).alias("source"),
        F.regexp_extract(name, r"unit_?(\d+)", 1).try_cast("int").alias("unit"),
        F.col("value").alias("text"),
    )


def lines(docs: DataFrame, text: str = "text", keep_blank: bool = False) -> DataFrame:
    """One row per line, numbered from 0 and stripped."""
    keep = [c for c in docs.columns if c != text]
    rows = unnest(docs, F.split(text, "\n"), keep, "line", at="line_no")
    rows = rows.withColumn("line", strip(F.col("line")))
    return rows if keep_blank else rows.where("line <> ''")


def page_ranges(starts: DataFrame, last_page: Column) -> DataFrame:
    """The end page of a unit is the page before the next unit starts."""
    following = next_within(starts, ["source"], "start_page", 4096, "_next")
    return following.withColumn("end_page", F.coalesce(F.col("_next") - 1, last_page)).drop("_next")


def pages_to_units(pages: DataFrame, ranges: DataFrame, span: int = 64) -> DataFrame:
    """Assign each page to the unit whose range holds it.

    Ranges are cut into blocks of ``span`` pages, so the range test becomes an
    equality on (source, block) with a filter and never a nested loop.
    """
    blocks = ranges.withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("start_page") / span), F.floor(F.col("end_page") / span))),
    )
    paged = pages.withColumn("block", F.floor(F.col("page") / span))
    inside = paged["page"].between(blocks["start_page"], blocks["end_page"])
    same = (paged["source"] == blocks["source"]) & (paged["block"] == blocks["block"])
    return paged.join(blocks, same & inside).select(paged["*"], blocks["unit"]).drop("block")
