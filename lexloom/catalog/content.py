"""The whole content build, from index rows and course text to the questions of every unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.catalog import bindings as B
from lexloom.catalog.bank import _RANK, _STAGES, _first
from lexloom.catalog.bindings import sql
from lexloom.catalog.matching import _BARE, documents
from lexloom.catalog.registry import query
from lexloom.functions.rows import unnest
from lexloom.functions.text import sentences_of
from lexloom.operators import dedup
from lexloom.plans import content, lexicon, sentence_bank
from lexloom.session import shared_dir
from lexloom.sources import store
from lexloom.sources.store import materialise


def _lexicon(spark, sf):
    """Index rows on the words of the benchmark texts; the second mention of a word in a later unit must go."""
    words = B.phrase_lexicon(spark, sf)
    raw = words.select(
        "word", "reading", F.col("word").alias("gloss"), F.col("unit").cast("string").alias("unit"), F.lit("vocab").alias("section"),
        F.lit("n.").alias("pos"), (F.col("seq") * 2).alias("seq"),
    )
    again = raw.where(F.length("word") > 6).withColumns(
        {"unit": (F.col("unit").cast("int") + 1).cast("string"), "seq": F.col("seq") + 1, "gloss": F.lit("later")}
    )
    broken = raw.where(F.length("word") == 4).withColumns({"unit": F.lit("?"), "seq": F.col("seq") + 1})
    return lexicon.build(raw.unionByName(again).unionByName(broken))


def _sentences(spark, sf):
    d = B.table(spark, sf, "documents")
    rows = unnest(d, sentences_of(F.replace("text", F.lit("\n"), F.lit(" "))), ["doc_id", "lang", "source"], "text", at="i")
    moved = F.when(F.col("i") % 4 == 3, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    return rows.select(
        moved.alias("doc_id"), "source", F.concat_ws(":", "doc_id", "i").alias("key"), "text", F.col("lang").alias("gloss"),
        (3 + moved % 13).cast("int").alias("unit"), (F.shiftleft(F.col("doc_id"), 32) + F.col("i")).alias("seq"),
        dedup.source_rank(F.col("source"), ("src0", "src1")).alias("source_rank"),
    )


def _flagged(spark, sf, words, survivors=False):
    """Sentences and exercises (a common word blanked) with the outcome of their checks; of the sentences all, or those that survive the first two."""
    rows, docs = _sentences(spark, sf), documents(spark, sf)
    flagged = sentence_bank.flag_stages(rows, docs, words, ["doc_id"], "key", C.LATIN, F.lower("text"), survivors, negation="the", one="and")
    # The readings of the test lexicon are made up; the words stand for them.
    flagged = flagged.withColumn("romanised", F.array_join("found_tags", " "))
    blanked = F.replace("text", F.lit(" the "), F.lit(" ___ "))
    items = rows.where(F.col("text").contains(" the ")).select(
        "doc_id", "source", "key", "unit", "seq", "source_rank", "gloss", F.col("text").alias("full"), blanked.alias("blanked"),
        F.array_repeat(F.lit("the"), F.size(F.split(blanked, "___")) - 1).alias("answers"),
    )
    return flagged, content.flag_cloze(items, docs, words, ["doc_id"], C.LATIN, F.lower("full"))


_SEQ = "CAST(split_part(key, ':', 1) AS BIGINT) * 4294967296 + CAST(split_part(key, ':', 2) AS BIGINT)"
_BUILT = [
    *_STAGES,
    _BARE,
    f"placed AS (SELECT *, {_SEQ} AS seq, {_RANK} AS source_rank, regexp_replace(lower(text), '[^a-zà-ÿ]', '', 'g') AS content FROM flagged)",
    f"sent AS ({_first('(SELECT * FROM placed WHERE verbatim AND known AND tagged)', 'unit, content', 'source_rank, seq', '*')})",
    r"""exercises AS (SELECT *, string_split(replace(text, ' the ', ' ___ '), '___') AS parts FROM placed WHERE contains(text, ' the ')),
      flagged_cloze AS (SELECT * REPLACE (coalesce(EXISTS (SELECT 1 FROM bare_lines b WHERE b.doc_id = x.doc_id AND regexp_matches(b.line,
          array_to_string(list_transform(x.parts, lambda p: regexp_escape(replace(p, ' ', ''))), '.*?'))), false) AS verbatim) FROM exercises x),
      blanks AS (SELECT *, unnest(range(len(parts) - 1)) AS i FROM flagged_cloze WHERE verbatim AND known),
      asked AS (SELECT source, unit, source_rank, seq, i, 'the' AS answer, array_to_string(list_transform(parts, lambda p, j: p || CASE WHEN j = len(parts) THEN '' WHEN j = i + 1 THEN '___' ELSE 'the' END), '')
          || ' (' || lang || ')' AS question FROM blanks)""",
    f"cloze AS ({_first('asked', 'unit, question, answer', 'source_rank, seq', '*')})",
]
_BANK = [
    f"""src AS (
        SELECT 'vocab' AS kind, unit, 0 AS section_rank, seq * 2 AS seq, word AS source_text, word AS text, CASE WHEN regexp_matches(reading, '[1-5]') THEN reading ELSE reading || '5' END AS reading, word AS gloss, NULL AS q, NULL AS a FROM phrases
        UNION ALL SELECT 'sentence', unit, 3, seq, text, text, array_to_string(tags, ' '), lang, NULL, NULL FROM ({_first('sent', 'unit, text', 'seq', '*')})
        UNION ALL SELECT 'cloze', unit, 4, row_number() OVER (PARTITION BY unit ORDER BY seq, i), replace(regexp_replace(question, ' \\([a-z]+\\)$', ''), '___', 'the'), NULL, NULL, NULL, question, answer FROM cloze)""",
    "plan(kind, question_type, qf, af) AS (VALUES " + ", ".join(f"('{kind}', '{t}', '{q}', '{a}')" for kind, rows in C.QUESTION_PLAN.items() for t, q, a in rows) + ")",
    """numbered AS (SELECT *, 'u' || unit || '_' || replace(question_type, ' ', '_') || '_' || row_number() OVER (PARTITION BY unit, question_type ORDER BY section_rank, seq) AS id FROM
         (SELECT s.*, p.question_type, CASE qf WHEN 'text' THEN text WHEN 'gloss' THEN gloss WHEN 'question' THEN q END AS question,
            CASE af WHEN 'text' THEN text WHEN 'reading' THEN reading WHEN 'gloss' THEN gloss WHEN 'answer' THEN s.a END AS answer FROM src s JOIN plan p ON p.kind = s.kind))""",
    """tagged AS (SELECT source_text, string_agg(word || ' ', '' ORDER BY length(word) DESC, word) AS words FROM (SELECT DISTINCT source_text FROM src) s
         JOIN (SELECT DISTINCT word FROM phrases) l ON contains(source_text, l.word) GROUP BY source_text)""",
    """bank AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY section_rank, seq, id) AS place, coalesce(t.words, '') || replace(question_type, ' ', '_') || ' unit_' || unit AS tags
         FROM numbered LEFT JOIN tagged t USING (source_text))""",
]


@query(
    "build_content",
    sql(
        ["doc_lines", "phrases"],
        """SELECT unit, place // 1000 AS block, count(*) AS questions, md5(string_agg(id || '|' || question || '|' || coalesce(answer, '') || '|' || tags, chr(10) ORDER BY place)) AS digest
           FROM bank GROUP BY ALL""",
        *_BUILT, *_BANK,
    ),
)
def build_content(spark, sf):
    words = materialise(_lexicon(spark, sf), "lexicon")
    sentences, exercises = _flagged(spark, sf, words, survivors=True)
    blocklist = spark.createDataFrame([("no such line",)], "line string")
    asked = content.build(words, sentences, exercises, blocklist, C.LATIN, F.lower("text"), tagged=False)
    path = shared_dir(spark, "content")
    store.write_units(content.documents(asked, 1000, words), path, "json", dealt=True, compression="gzip")
    record = "struct<id:string,question_type:string,question:string,answer:string,tags:array<string>>"
    docs = spark.read.schema(f"block long, records array<{record}>, unit int").json(path)
    line = F.transform("records", lambda r: F.concat_ws("|", r["id"], r["question"], F.coalesce(r["answer"], F.lit("")), F.array_join(r["tags"], " ")))
    return docs.select("unit", "block", F.size("records").cast("long").alias("questions"), F.md5(F.array_join(line, "\n")).alias("digest"))


@query(
    "content_counts",
    sql(
        ["doc_lines", "phrases"],
        """SELECT * FROM (SELECT source, unit, count(*) AS extracted, count(*) FILTER (NOT verbatim) AS dropped_verbatim, count(*) FILTER (verbatim AND NOT known) AS dropped_known,
               count(*) FILTER (verbatim AND known AND NOT tagged) AS dropped_tagged, count(*) FILTER (verbatim AND known AND tagged) AS final FROM placed GROUP BY ALL)
             FULL JOIN (SELECT source, unit, count(*) AS cloze_solved, count(*) FILTER (NOT verbatim) AS cloze_dropped_verbatim, count(*) FILTER (verbatim AND NOT known) AS cloze_dropped_known
               FROM flagged_cloze GROUP BY ALL) USING (source, unit)
             FULL JOIN (SELECT source, unit, count(*) AS cloze_final FROM asked GROUP BY ALL) USING (source, unit)
           UNION ALL SELECT NULL, unit, NULL, NULL, NULL, NULL, s, NULL, NULL, NULL, c FROM
             (SELECT unit, count(*) AS s FROM sent GROUP BY unit) FULL JOIN (SELECT unit, count(*) AS c FROM cloze GROUP BY unit) USING (unit)""",
        *_BUILT,
    ),
)
def content_counts(spark, sf):
    words = materialise(_lexicon(spark, sf), "lexicon")
    sentences, exercises = _flagged(spark, sf, words)
    return content.counts(materialise(sentences, "sentences"), materialise(exercises, "cloze"), C.LATIN, F.lower("text"))
