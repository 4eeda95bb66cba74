"""JSON documents with dynamic keys, flattened to tables.

Keys such as unit numbers and words are data, so documents are read as text and
parsed as maps; a plain JSON read would make one column per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.rows import unnest
from lexloom.functions.text import json_block

QUESTION = "struct<id:string,question_type:string,question:string,answer:string,tags:array<string>>"
ENTRY = "struct<hanzi:string,pinyin:string,english:string,part_of_speech:string,unit:int>"
DICTIONARY_ENTRY = "struct<pinyin:string,english:string,type:string,unit:int>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path`` and ``body``."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("body")
    )


def unit_map(docs: DataFrame, body: str = "body", record: str = QUESTION) -> DataFrame:
    """``{unit: [record, ...]}`` to rows of ``unit``, ``seq`` and the record's fields."""
    keep = [c for c in docs.columns if c != body]
    parsed = F.from_json(body, f"map<string,array<{record}>>")
    units = unnest(docs, parsed, keep, "unit", "records")
    rows = unnest(units, "records", [*keep, F.col("unit").cast("int").alias("unit")], "r", at="seq")
    return rows.select(*keep, "unit", "seq", "r.*")


def sections(docs: DataFrame, body: str = "body") -> DataFrame:
    """The three lexicon sections as one table with their type and rank."""
    keep = [c for c in docs.columns if c != body]
    schema = ",".join(f"{name}:array<{ENTRY}>" for name, _ in C.SECTIONS)
    doc = docs.select(*keep, F.from_json(body, f"struct<{schema}>").alias("d"))
    each = F.array(
        *[
            F.struct(F.lit(rank).alias("section_rank"), F.lit(kind).alias("type"), F.col(f"d.{name}").alias("rows"))
            for rank, (name, kind) in enumerate(C.SECTIONS)
        ]
    )
    parts = unnest(doc, each, keep, "s")
    rows = unnest(parts, "s.rows", [*keep, "s.section_rank", "s.type"], "r", at="seq")
    return rows.select(
        *keep,
        "section_rank",
        "type",
        "seq",
        F.col("r.hanzi").alias("word"),
        F.col("r.pinyin").alias("reading"),
        F.col("r.english").alias("gloss"),
        F.col("r.part_of_speech").alias("pos"),
        F.col("r.unit").alias("unit"),
    )


def dictionary(docs: DataFrame, body: str = "body", entry: str = DICTIONARY_ENTRY) -> DataFrame:
    """A flat ``{word: entry}`` object to rows."""
    keep = [c for c in docs.columns if c != body]
    parsed = F.from_json(body, f"map<string,{entry}>")
    rows = unnest(docs, parsed, keep, "word", "e")
    return rows.select(*keep, "word", "e.*") if entry.startswith("struct") else rows.withColumnRenamed("e", "value")


def parse_responses(responses: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Add ``block`` (the JSON found in the text) and ``parsed`` (null if it is not valid)."""
    block = json_block(F.col(body))
    return responses.withColumn("block", block).withColumn("parsed", _valid(F.col("block"), schema))


def _valid(block: Column, schema: str) -> Column:
    parsed = F.from_json(
        block, f"struct<v:{schema},bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    )
    if schema.startswith("array"):
        # An array cannot carry a corrupt-record field, so it is parsed inside an object.
        parsed = F.from_json(
            F.concat(F.lit('{"v":'), block, F.lit("}")),
            f"struct<v:{schema},bad:string>",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"},
        )
    return F.when(parsed["bad"].isNull(), parsed["v"])


def quarantine(parsed: DataFrame, fallback: Column) -> tuple[DataFrame, DataFrame]:
    """Split into usable rows (bad ones get the fallback value) and the raw bad rows."""
    bad = F.col("parsed").isNull()
    usable = parsed.withColumn("failed", bad).withColumn("parsed", F.coalesce("parsed", fallback))
    return usable, parsed.where(bad).drop("parsed")
