"""Sources and sinks: JSON documents, text files, page ranges, stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.catalog import bindings as B
from lexloom.catalog.bindings import sql
from lexloom.catalog.registry import query
from lexloom.functions.rows import unnest
from lexloom.functions.text import json_block
from lexloom.session import shared_dir
from lexloom.sources import json_docs, store, text_files


def _question(prefix, qtype, question, answer, *tags):
    return F.struct(
        F.concat(F.lit(prefix), "p_partkey").alias("id"),
        F.lit(qtype).alias("question_type"),
        question.alias("question"),
        answer.alias("answer"),
        F.array(*tags).alias("tags"),
    )


@query(
    "scan_unit_map",
    sql(
        [],
        """SELECT p_partkey AS doc, 3 + p_size % 13 AS unit, 0 AS seq, 'a' || p_partkey AS id, 'listening vocab' AS question_type,
                  p_name AS question, p_brand AS answer, p_name || '|unit' AS tags FROM part
           UNION ALL SELECT p_partkey, 3 + p_size % 13, 1, 'b' || p_partkey, 'speaking vocab', p_name, p_type, p_type FROM part
           UNION ALL SELECT p_partkey, 40 + p_size, 0, 'c' || p_partkey, 'fill in the blank', p_type, p_name, p_brand FROM part""",
    ),
)
def scan_unit_map(spark, sf):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    body = F.to_json(
        F.create_map(
            (3 + F.col("p_size") % 13).cast("string"),
            F.array(
                _question("a", "listening vocab", name, brand, name, F.lit("unit")),
                _question("b", "speaking vocab", name, kind, kind),
            ),
            (40 + F.col("p_size")).cast("string"),
            F.array(_question("c", "fill in the blank", kind, name, brand)),
        )
    )
    docs = B.table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), body.alias("body"))
    return json_docs.unit_map(docs).withColumn("tags", F.array_join("tags", "|"))


@query(
    "scan_sections",
    sql(
        [],
        """SELECT p_partkey AS doc, 0 AS section_rank, 'vocab' AS type, 0 AS seq, p_name AS word, p_brand AS reading,
                  p_type AS gloss, 'noun' AS pos, p_size AS unit FROM part
           UNION ALL SELECT p_partkey, 0, 'vocab', 1, p_type, p_brand, p_name, NULL, p_size FROM part WHERE p_size % 2 = 0
           UNION ALL SELECT p_partkey, 1, 'grammar', 0, p_brand, NULL, p_name, 'particle', p_size FROM part
           UNION ALL SELECT p_partkey, 2, 'proper_noun', 0, p_brand, p_type, p_name, NULL, NULL FROM part WHERE p_size % 3 = 0""",
    ),
)
def scan_sections(spark, sf):
    def entry(word, reading, gloss, pos, unit):
        names = ["hanzi", "pinyin", "english", "part_of_speech", "unit"]
        return F.struct(*[v.alias(n) for n, v in zip(names, (word, reading, gloss, pos, unit))])

    name, brand, kind, size = (F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    one = entry(name, brand, kind, F.lit("noun"), size)
    two = entry(kind, brand, name, text, size)
    body = F.to_json(
        F.struct(
            F.when(size % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("vocab"),
            F.array(entry(brand, text, name, F.lit("particle"), size)).alias("grammar"),
            F.when(size % 3 == 0, F.array(entry(brand, kind, name, text, number))).alias("proper_nouns"),
        )
    )
    docs = B.table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), body.alias("body"))
    return json_docs.sections(docs)


@query(
    "scan_dictionary",
    sql(
        [],
        """SELECT p_partkey AS doc, p_name AS word, p_brand AS pinyin, p_type AS english, 'vocab' AS type, p_size AS unit FROM part
           UNION ALL SELECT p_partkey, p_brand, NULL, p_name, 'grammar', p_size FROM part""",
    ),
)
def scan_dictionary(spark, sf):
    def entry(pinyin, english, kind):
        return F.struct(pinyin.alias("pinyin"), english.alias("english"), F.lit(kind).alias("type"), F.col("p_size").alias("unit"))

    body = F.to_json(
        F.create_map(
            F.col("p_name"), entry(F.col("p_brand"), F.col("p_type"), "vocab"),
            F.col("p_brand"), entry(F.lit(None).cast("string"), F.col("p_name"), "grammar"),
        )
    )
    docs = B.table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), body.alias("body"))
    return json_docs.dictionary(docs)


@query(
    "scan_text_lines",
    sql(["doc_lines"], f"SELECT doc_id, line_no, line FROM (SELECT doc_id, line_no, {B.sql_strip('line')} AS line FROM doc_lines) WHERE line <> ''"),
)
def scan_text_lines(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    return text_files.lines(docs).select("doc_id", "line_no", "line")


@query("sink_unit_json", sql(["entries"], "SELECT unit, seq, word, gloss, type FROM entries"))
def sink_unit_json(spark, sf):
    path = shared_dir(spark, "units")
    docs = store.unit_documents(B.entries(spark, sf), "seq", F.struct("seq", "word", "gloss", "type"), block_size=500)
    store.write_units(docs, path, "json")
    record = "struct<seq:long,word:string,gloss:string,type:string>"
    back = spark.read.schema(f"block long, records array<{record}>, unit int").json(path)
    return unnest(back, "records", ["unit"], "r").select("unit", "r.*")


@query(
    "unit_documents",
    sql(["entries"], """SELECT unit, seq // 500 AS block, CAST(count(*) AS INTEGER) AS n, string_agg(word, ',' ORDER BY seq) AS words
        FROM entries GROUP BY ALL"""),
)
def unit_documents(spark, sf):
    docs = store.unit_documents(B.entries(spark, sf), "seq", F.struct("word", "gloss"), block_size=500)
    words = F.array_join(F.transform("records", lambda r: r["word"]), ",")
    return docs.select("unit", "block", F.size("records").alias("n"), words.alias("words"))


def _fresh(rows):
    """A rerun of some units: other answers, and only the longer ones."""
    return rows.where("unit IN (4, 6) AND length(answer) > 5").withColumn("answer", F.lower("answer"))


@query(
    "upsert_partition",
    sql(["bank"], """SELECT unit, id, answer FROM bank WHERE unit NOT IN (4, 6)
        UNION ALL SELECT unit, id, lower(answer) FROM bank WHERE unit IN (4, 6) AND length(answer) > 5"""),
)
def upsert_partition(spark, sf):
    bank = B.bank(spark, sf).select("unit", "seq", "id", "answer")
    path = shared_dir(spark, "bank")
    store.write_units(bank, path, "parquet")
    store.write_units(_fresh(bank), path, "parquet")
    return spark.read.schema("id string, answer string, unit int").parquet(path)


@query(
    "upsert_units",
    sql(["bank"], """SELECT unit, id, answer FROM bank WHERE unit NOT IN (4, 6)
        UNION ALL SELECT unit, id, lower(answer) FROM bank WHERE unit IN (4, 6) AND length(answer) > 5"""),
)
def upsert_units(spark, sf):
    bank = B.bank(spark, sf).select("unit", "seq", "id", "answer")
    return store.upsert_units(bank, _fresh(bank)).drop("seq")


@query(
    "source_fallback",
    sql(
        [],
        """SELECT unit, id, src_rank FROM (SELECT *, min(src_rank) OVER (PARTITION BY unit) AS best FROM ranked) WHERE src_rank = best""",
        "parts AS (SELECT p_size AS unit, p_partkey AS id, p_type, p_brand FROM part)",
        """ranked AS (SELECT unit, id, 0 AS src_rank FROM parts WHERE p_type = 'PROMO' AND p_brand IN ('Brand#1', 'Brand#2')
            UNION ALL SELECT unit, id, 1 FROM parts WHERE p_type = 'SMALL' AND p_brand IN ('Brand#3', 'Brand#4')
            UNION ALL SELECT unit, id, 2 FROM parts)""",
    ),
)
def source_fallback(spark, sf):
    parts = B.table(spark, sf, "part").select(F.col("p_size").alias("unit"), F.col("p_partkey").alias("id"), "p_type", "p_brand")
    fresh = parts.where("p_type = 'PROMO' AND p_brand IN ('Brand#1', 'Brand#2')")
    stored = parts.where("p_type = 'SMALL' AND p_brand IN ('Brand#3', 'Brand#4')")
    return store.first_available([fresh, stored, parts]).select("unit", "id", "src_rank")


@query("select_units", sql(["entries"], "SELECT seq, word, unit, gloss AS source FROM entries WHERE unit IN (4, 5) AND gloss IN ('PROMO', 'SMALL')"))
def select_units(spark, sf):
    rows = B.entries(spark, sf).select("seq", "word", "unit", F.col("gloss").alias("source"))
    return store.select_units(rows, [4, 5], ["PROMO", "SMALL"])


_BLOCK = """'[{"lang": "' || lang || '", "n": ' || n_chars || '}]'"""


def _block():
    return F.concat(F.lit('[{"lang": "'), "lang", F.lit('", "n": '), "n_chars", F.lit("}]"))


@query(
    "json_from_text",
    sql(
        [],
        f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN {_BLOCK} WHEN 1 THEN {_BLOCK} WHEN 2 THEN '{{"rows": 1, "v": {{"n": ' || n_chars || '}}}}'
              WHEN 3 THEN '[1]' WHEN 4 THEN {B.sql_strip("replace(replace(replace(replace(text, '[', ''), ']', ''), '{{', ''), '}}', '')")}
              ELSE '{{"n": ' || n_chars || '}}' END AS block FROM documents""",
    ),
)
def json_from_text(spark, sf):
    d = B.table(spark, sf, "documents")
    obj = F.concat(F.lit('{"rows": 1, "v": {"n": '), "n_chars", F.lit("}}"))
    case = F.col("doc_id") % 6
    body = (
        F.when(case == 0, F.concat(F.lit("Here is the list [as asked]:\n```json\n"), _block(), F.lit("\n```\nDone [1].")))
        .when(case == 1, F.concat(F.lit("Result: "), _block(), F.lit(" and [more]")))
        .when(case == 2, F.concat(F.lit("Object "), obj, F.lit(" {done}")))
        .when(case == 3, F.concat(F.lit("See [1] and "), obj))
        .when(case == 4, F.translate("text", "[]{}", ""))
        .otherwise(F.concat(F.lit("[ never closed {\"n\": "), "n_chars", F.lit("} end")))
    )
    docs = d.select("doc_id", body.alias("body"))
    return docs.select("doc_id", json_block(F.col("body")).alias("block"))


@query(
    "quarantine_bad_json",
    sql([], """SELECT doc_id, doc_id % 3 = 2 AS failed, CASE WHEN doc_id % 3 = 2 THEN 'none' ELSE lang END AS lang,
               CASE WHEN doc_id % 3 = 2 THEN 0 ELSE n_chars END AS n FROM documents"""),
)
def quarantine_bad_json(spark, sf):
    case = F.col("doc_id") % 3
    body = (
        F.when(case == 0, F.concat(F.lit("```json\n"), _block(), F.lit("\n```")))
        .when(case == 1, F.concat(F.lit("Sure: "), _block()))
        .otherwise(F.concat(F.lit('[{"lang": "x", "n": '), "n_chars"))
    )
    docs = B.table(spark, sf, "documents").select("doc_id", body.alias("body"))
    parsed = json_docs.parse_responses(docs, "array<struct<lang:string,n:bigint>>")
    usable, _ = json_docs.quarantine(parsed, F.array(F.struct(F.lit("none").alias("lang"), F.lit(0).cast("long").alias("n"))))
    return usable.select("doc_id", "failed", F.inline("parsed"))


def _starts(spark, sf):
    return B.table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_size").alias("unit"), F.col("p_partkey").alias("start_page"))


def _last_page(spark, sf):
    return B.table(spark, sf, "part").agg(F.max("p_partkey") + 50).scalar()


_RANGES = """ranges AS (SELECT p_brand AS source, p_size AS unit, p_partkey AS start_page,
    coalesce(lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1, (SELECT max(p_partkey) + 50 FROM part)) AS end_page FROM part)"""


@query("page_ranges", sql([], "SELECT * FROM ranges", _RANGES))
def page_ranges(spark, sf):
    return text_files.page_ranges(_starts(spark, sf), _last_page(spark, sf))


@query(
    "pages_to_units",
    sql([], """SELECT o_orderkey, o.source, page, unit FROM
        (SELECT o_orderkey, 'Brand#' || (o_orderkey % 25 + 1) AS source, o_custkey AS page FROM orders) o
        JOIN ranges r ON r.source = o.source AND page BETWEEN start_page AND end_page""", _RANGES),
)
def pages_to_units(spark, sf):
    pages = B.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("Brand#"), F.col("o_orderkey") % 25 + 1).alias("source"), F.col("o_custkey").alias("page")
    )
    return text_files.pages_to_units(pages, text_files.page_ranges(_starts(spark, sf), _last_page(spark, sf)))
