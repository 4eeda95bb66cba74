"""Duplicates, merging, indexes over tags, and the content builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.catalog import bindings as B
from lexloom.catalog.bindings import sql, sql_spoken, sql_words
from lexloom.catalog.matching import (
    SQL_CANDIDATES,
    SQL_SEGMENT,
    candidates,
    documents,
)
from lexloom.catalog.registry import query
from lexloom.catalog.structure import _RAW, raw_entries
from lexloom.operators import dedup
from lexloom.operators import progress as P
from lexloom.operators import questions as Q
from lexloom.plans import lexicon, question_bank, sentence_bank


def _first(rows: str, keys: str, order: str, cols: str) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _n FROM {rows}) WHERE _n = 1"


# ------------------------------------------------------------ duplicates
@query(
    "dedup_lowest_unit",
    sql(["entries"], f"""SELECT e.word, reading, gloss, unit, type, e.seq, first_seq FROM ({_first('entries', 'word', 'unit, seq', '*')}) e
        JOIN (SELECT word, min(seq) AS first_seq FROM entries GROUP BY word) f ON f.word = e.word"""),
)
def dedup_lowest_unit(spark, sf):
    return dedup.lowest_unit(B.entries(spark, sf).drop("section_rank"))


@query("dedup_first_section", sql(["entries"], _first("entries", "word", "section_rank, seq", "word, reading, gloss, unit, type, seq, section_rank")))
def dedup_first_section(spark, sf):
    return dedup.first_section(B.entries(spark, sf))


_NULLED = "nulled AS (SELECT doc_id, lang, source, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE text END AS text FROM documents)"


@query("dedup_by_key", sql([], _first("nulled", "lang, text", "doc_id", "doc_id, lang, source, md5(text) AS text"), _NULLED))
def dedup_by_key(spark, sf):
    d = B.table(spark, sf, "documents")
    rows = d.select("doc_id", "lang", "source", F.when(F.col("n_chars") % 5 != 0, F.col("text")).alias("text"))
    return dedup.by_key(rows, ["lang", "text"], ["doc_id"]).withColumn("text", F.md5("text"))


@query(
    "dedup_removed",
    sql([], "SELECT lang, count(*) AS n_rows, count(*) - count(DISTINCT coalesce(text, '-')) AS n_removed FROM nulled GROUP BY lang", _NULLED),
)
def dedup_removed(spark, sf):
    d = B.table(spark, sf, "documents")
    rows = d.select("lang", F.when(F.col("n_chars") % 5 != 0, F.col("text")).alias("text"))
    return dedup.removed_count(rows, ["lang", "text"], ["lang"])


@query(
    "append_new",
    sql(["doc_sentences"], """SELECT min(doc_id) AS seq, md5(text) AS text FROM doc_sentences d WHERE source <> 'src0' AND text <> ''
        AND NOT EXISTS (SELECT 1 FROM doc_sentences b WHERE b.source = 'src0' AND b.text = d.text) GROUP BY text"""),
)
def append_new(spark, sf):
    rows = B.doc_sentences(spark, sf).select(F.col("doc_id").alias("seq"), "text", "source")
    existing = rows.where("source = 'src0'")
    fresh = rows.where("source <> 'src0'").drop("source")
    return dedup.append_new(existing, fresh).withColumn("text", F.md5("text"))


_RANK = "CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END"


@query(
    "merge_sources",
    sql(
        ["doc_sentences"],
        _first("keyed", "unit, content", "source_rank, seq", "unit, source, seq, md5(content) AS content"),
        f"""keyed AS (SELECT *, {_RANK} AS source_rank, regexp_replace(lower(text), '[^a-zà-ÿ]', '', 'g') AS content, doc_id * 100000 + pos AS seq,
            CAST(3 + pos % 13 AS INTEGER) AS unit FROM doc_sentences WHERE regexp_matches(lower(text), '[a-zà-ÿ]'))""",
    ),
)
def merge_sources(spark, sf):
    rows = B.doc_sentences(spark, sf).select(
        "source", "text", (F.col("doc_id") * 100_000 + F.col("pos")).alias("seq"), (3 + F.col("pos") % 13).cast("int").alias("unit")
    )
    ranked = rows.withColumn("source_rank", dedup.source_rank(F.col("source"), ("src0", "src1")))
    merged = dedup.merge_sentences(ranked, C.LATIN, F.lower("text"))
    return merged.select("unit", "source", "seq", F.md5("content").alias("content"))


@query(
    "merge_cloze",
    sql(["entries"], _first("ranked", "unit, question, answer", "source_rank, seq", "unit, question, answer, seq"),
        "ranked AS (SELECT unit, word || ' ___' AS question, gloss AS answer, seq, CASE reading WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 ELSE 2 END AS source_rank FROM entries)"),
)
def merge_cloze(spark, sf):
    e = B.entries(spark, sf)
    rows = e.select("unit", F.concat("word", F.lit(" ___")).alias("question"), F.col("gloss").alias("answer"), "seq", F.col("reading").alias("source"))
    ranked = rows.withColumn("source_rank", dedup.source_rank(F.col("source"), ("Brand#1", "Brand#2")))
    return dedup.merge_cloze(ranked).select("unit", "question", "answer", "seq")


@query(
    "dedup_exact",
    sql(["doc_sentences"], "SELECT lang AS unit, min(doc_id * 100000 + pos) AS seq, md5(text) AS text FROM doc_sentences GROUP BY lang, text"),
)
def dedup_exact(spark, sf):
    rows = B.doc_sentences(spark, sf).select(F.col("lang").alias("unit"), "text", (F.col("doc_id") * 100_000 + F.col("pos")).alias("seq"))
    return dedup.by_key(rows, ["unit", "text"], ["seq"]).withColumn("text", F.md5("text"))


@query(
    "set_algebra",
    sql(["bank", "tagged", "types"], """SELECT 'union' AS op, tag FROM (SELECT tag FROM tagged JOIN types USING (question_type) WHERE tier = 3 UNION SELECT tag FROM tagged WHERE unit = 3)
        UNION ALL SELECT 'except', tag FROM (SELECT tag FROM tagged EXCEPT SELECT tag FROM tagged WHERE unit = 3)
        UNION ALL SELECT 'intersect', tag FROM (SELECT tag FROM tagged JOIN types USING (question_type) WHERE tier = 3 INTERSECT SELECT tag FROM tagged WHERE unit = 3)"""),
)
def set_algebra(spark, sf):
    tagged = B.tagged_bank(spark, sf)
    third = tagged.where(F.col("question_type") == "translate english sentence to chinese").select("tag")
    unit3, every = tagged.where("unit = 3").select("tag"), tagged.select("tag")

    def named(op, df):
        return df.select(F.lit(op).alias("op"), "tag")

    return named("union", third.union(unit3).distinct()).union(named("except", every.subtract(unit3))).union(
        named("intersect", third.intersect(unit3))
    )


# ------------------------------------------------------------ indexes
@query(
    "inverted_index",
    sql(["bank", "tagged"], "SELECT tag, seq // 1024 AS block, string_agg(id, ',' ORDER BY seq) AS ids FROM tagged GROUP BY ALL"),
)
def inverted_index(spark, sf):
    blocks = Q.posting_blocks(B.tagged_bank(spark, sf))
    return blocks.select("tag", "block", F.array_join("ids", ",").alias("ids"))


@query("tag_first_unit", sql(["bank", "tagged"], "SELECT tag, min(unit) AS unit FROM tagged GROUP BY tag"))
def tag_first_unit(spark, sf):
    return Q.first_unit_of_tag(B.tagged_bank(spark, sf))


# Questions of units 3 and 4 lose their content tags, so two units have none.
@query("unit_tag_set", sql(["bank", "tagged"], "SELECT DISTINCT unit, CASE WHEN unit <= 4 THEN NULL ELSE tag END AS tag FROM tagged"))
def unit_tag_set(spark, sf):
    bank = B.bank(spark, sf)
    bare = F.when(F.col("unit") <= 4, F.filter("tags", lambda t: ~t.startswith("tag_"))).otherwise(F.col("tags"))
    return Q.tags_of_unit(bank.withColumn("tags", bare))


@query(
    "group_by_unit",
    sql(["entries"], "SELECT unit, type, count(*) AS n, count(DISTINCT word) AS n_words, min(seq) AS first_seq FROM entries GROUP BY unit, type"),
)
def group_by_unit(spark, sf):
    return B.entries(spark, sf).groupBy("unit", "type").agg(
        F.count("*").alias("n"), F.count_distinct("word").alias("n_words"), F.min("seq").alias("first_seq")
    )


@query("type_counts", sql(["bank"], "SELECT unit, question_type, count(*) AS n FROM bank GROUP BY ROLLUP (unit, question_type)"))
def type_counts(spark, sf):
    return Q.type_counts(B.bank(spark, sf))


# ------------------------------------------------------------ builds
@query(
    "build_lexicon",
    sql(
        [],
        f"""SELECT word, CASE WHEN regexp_matches(reading, '[1-5]') THEN reading ELSE reading || '5' END AS reading, gloss, unit, type, seq, first_seq FROM
            ({_first('usable', 'word', 'unit, seq', '*')}) JOIN (SELECT word, min(seq) AS first_seq FROM usable GROUP BY word) USING (word)""",
        _RAW.replace("p_brand END AS reading", "lower(left(p_type, 2)) END AS reading, p_type, p_name, p_partkey"),
        r"""usable AS (SELECT trim(word) AS word, reading, p_name AS gloss, TRY_CAST(trim(unit) AS INTEGER) AS unit, seq,
              CASE WHEN p_partkey % 3 = 2 THEN 'proper_noun' WHEN p_type = 'PROMO' THEN 'grammar' ELSE 'vocab' END AS type
            FROM raw WHERE trim(coalesce(word, '')) <> '' AND NOT contains(word, '[unclear]') AND reading <> '[unclear]' AND TRY_CAST(trim(unit) AS INTEGER) IS NOT NULL)""",
    ).replace("reading || '5'", "CASE reading WHEN 'ec' THEN 'e5c5' ELSE reading || '5' END"),
)
def build_lexicon(spark, sf):
    raw = raw_entries(spark, sf)
    two = F.lower(F.left("p_type", F.lit(2)))
    rows = raw.select(
        "seq", "word", F.when(F.col("reading") == "[unclear]", F.col("reading")).otherwise(two).alias("reading"), "unit", F.col("p_name").alias("gloss"),
        F.when(F.col("p_type") == "PROMO", "part.").otherwise("n.").alias("pos"),
        F.when(F.col("seq") % 3 == 2, "proper_noun").otherwise("vocab").alias("section"),
    )
    return lexicon.build(rows)


def _index(spark, sf):
    return B.entries(spark, sf).withColumn("reading", F.concat(F.lit("bu4 "), F.lower("gloss"), F.col("unit") % 5))


@query(
    "validate_index",
    sql(["entries"], _first("entries", "type, word", "seq", "type, word, seq, CASE WHEN unit % 5 = 4 THEN 'bu2 ' ELSE 'bu4 ' END || lower(gloss) || (unit % 5) AS reading")),
)
def validate_index(spark, sf):
    return lexicon.validate_index(_index(spark, sf)).select("type", "word", "seq", "reading")


@query(
    "validate_bank",
    sql(
        ["doc_sentences"],
        f"""SELECT unit, seq, md5(text) AS text, md5(array_to_string(list_transform(r, lambda t, i: CASE WHEN t = 'bu4' AND coalesce(regexp_matches(r[i + 1], '[a-zv]4$'), false) THEN 'bu2' ELSE t END), ' ')) AS reading
            FROM (SELECT *, {sql_spoken(sql_words('text'))} AS r FROM ({_first('cut', 'unit, text', 'seq', 'unit, seq, text')}))""",
        """cut AS (SELECT lang AS unit, doc_id * 100000 + pos AS seq, CASE WHEN contains(text, ', ') AND pos % 3 = 0 THEN split_part(text, ', ', 1) || ',' ELSE text END AS text
           FROM doc_sentences WHERE NOT (contains(text, ', ') AND pos % 3 = 0))""",
    ),
)
def validate_bank(spark, sf):
    rows = B.doc_sentences(spark, sf)
    broken = F.col("text").contains(", ") & (F.col("pos") % 3 == 0)
    text = F.when(broken, F.concat(F.substring_index("text", ", ", 1), F.lit(", "))).otherwise(F.col("text"))
    sentences = rows.select(
        F.col("lang").alias("unit"), (F.col("doc_id") * 100_000 + F.col("pos")).alias("seq"), text.alias("text"),
        F.array_join(B.spoken(B.words_of(F.col("text"))), " ").alias("reading"), F.lit("a gloss").alias("gloss"),
    )
    kept = lexicon.validate_sentences(sentences)
    return kept.select("unit", "seq", F.md5("text").alias("text"), F.md5("reading").alias("reading"))


_STAGES = [
    SQL_CANDIDATES,
    "chars AS (SELECT ch, min(unit) AS unit FROM (SELECT unit, unnest(string_split(regexp_replace(word, '[^a-zà-ÿ]', '', 'g'), '')) AS ch FROM phrases) GROUP BY ch)",
    "doc_flat AS (SELECT doc_id, replace(text, ' ', '') AS body FROM documents)",
    """checked AS (SELECT c.key, c.doc_id, c.source, c.lang, CAST(3 + c.doc_id % 13 AS INTEGER) AS unit, c.text, coalesce(contains(d.body, replace(c.text, ' ', '')), false) AS verbatim
       FROM candidates c LEFT JOIN doc_flat d ON d.doc_id = c.doc_id)""",
    """foreign_rows AS (SELECT DISTINCT key FROM (SELECT key, unit, unnest(string_split(regexp_replace(lower(text), '[^a-zà-ÿ]', '', 'g'), '')) AS ch FROM checked) x
         LEFT JOIN chars c ON c.ch = x.ch WHERE x.ch <> '' AND (c.ch IS NULL OR c.unit > x.unit))""",
    "gate AS (SELECT k.*, key NOT IN (SELECT key FROM foreign_rows) AS known FROM checked k)",
    "seg_rows AS (SELECT key, unit, lower(text) AS text FROM gate WHERE verbatim AND known)",
    SQL_SEGMENT,
    "flagged AS (SELECT g.*, s.tags, coalesce(len(s.tags) > 0, false) AS tagged FROM gate g LEFT JOIN segmented s ON s.key = g.key)",
]


def _flagged(spark, sf):
    """Candidate sentences with the outcome of every stage."""
    rows = candidates(spark, sf).withColumn("unit", (3 + F.col("doc_id") % 13).cast("int"))
    return sentence_bank.flag_stages(
        rows, documents(spark, sf), B.phrase_lexicon(spark, sf), ["doc_id"], "key", C.LATIN, F.lower("text"),
        negation="the", one="and",
    )


@query(
    "build_question_bank",
    sql(
        ["entries", "benchmark_sentences"],
        """SELECT a.id, a.question_type, md5(a.question) AS question, a.answer, a.unit, md5(coalesce(t.words, '') || replace(a.question_type, ' ', '_') || ' unit_' || a.unit) AS tags
           FROM numbered a LEFT JOIN tagged t ON t.source_text = a.source_text""",
        """blocked AS (SELECT 'red plate' AS line)""",
        f"""src AS (
            SELECT type AS kind, unit, section_rank, seq, word AS source_text, word AS text, reading, gloss, NULL AS q, NULL AS a FROM entries
            UNION ALL SELECT 'sentence', unit, 3, seq, text, text, NULL, lang, NULL, NULL FROM ({_first('bs', 'unit, text', 'seq', '*')})
            UNION ALL SELECT 'cloze', unit, 4, seq, replace(q, '___', a), NULL, NULL, NULL, q, a FROM ({_first('cz', 'unit, q, a', 'seq', '*')}) WHERE replace(q, '___', a) <> 'red plate')""",
        "plan(kind, question_type, qf, af) AS (VALUES " + ", ".join(f"('{kind}', '{t}', '{q}', '{a}')" for kind, rows in C.QUESTION_PLAN.items() for t, q, a in rows) + ")",
        """numbered AS (SELECT *, 'u' || unit || '_' || replace(question_type, ' ', '_') || '_' || row_number() OVER (PARTITION BY unit, question_type ORDER BY section_rank, seq) AS id FROM
             (SELECT s.*, p.question_type, CASE qf WHEN 'text' THEN text WHEN 'gloss' THEN gloss WHEN 'question' THEN q END AS question,
                CASE af WHEN 'text' THEN text WHEN 'reading' THEN reading WHEN 'gloss' THEN gloss WHEN 'answer' THEN s.a END AS answer FROM src s JOIN plan p ON p.kind = s.kind))""",
        """tagged AS (SELECT source_text, string_agg(word || ' ', '' ORDER BY length(word) DESC, word) AS words FROM (SELECT DISTINCT source_text FROM src) s
             JOIN (SELECT DISTINCT word FROM entries UNION SELECT DISTINCT gloss FROM entries WHERE false) l ON contains(source_text, l.word) GROUP BY source_text)""",
    ).replace(
        "src AS (",
        """bs AS (SELECT CAST(3 + item_id % 13 AS INTEGER) AS unit, item_id * 1000 + pos AS seq, text || ' red plate' AS text, 'en' AS lang FROM benchmark_sentences),
          cz AS (SELECT unit, seq, split_part(word, ' ', 1) || ' ___' AS q, split_part(word, ' ', 2) AS a FROM entries),
          src AS (""",
        1,
    ),
)
def build_question_bank(spark, sf):
    entries = B.entries(spark, sf)
    sentences = B.benchmark_sentences(spark, sf).select(
        (3 + F.col("item_id") % 13).cast("int").alias("unit"), (F.col("item_id") * 1000 + F.col("pos")).alias("seq"),
        F.concat("text", F.lit(" red plate")).alias("text"), F.lit(None).cast("string").alias("reading"), F.lit("en").alias("gloss"),
    )
    cloze = entries.select(
        "unit", "seq", F.concat(F.substring_index("word", " ", 1), F.lit(" ___")).alias("question"), F.substring_index("word", " ", -1).alias("answer")
    )
    blocklist = spark.createDataFrame([("red plate.",)], "line string")
    bank = question_bank.build(entries, sentences, cloze, blocklist)
    return bank.select("id", "question_type", F.md5("question").alias("question"), "answer", "unit", F.md5(F.array_join("tags", " ")).alias("tags"))


@query(
    "build_sentence_bank",
    sql(
        ["doc_lines", "phrases"],
        f"SELECT unit, key, md5(content) AS content, array_to_string(tags, '|') AS tags FROM ({_first('passed', 'unit, content', 'source_rank, key', '*')})",
        *_STAGES,
        f"passed AS (SELECT *, {_RANK} AS source_rank, regexp_replace(lower(text), '[^a-zà-ÿ]', '', 'g') AS content FROM flagged WHERE verbatim AND known AND tagged)",
    ),
)
def build_sentence_bank(spark, sf):
    flagged = _flagged(spark, sf)
    ranked = flagged.withColumn("source_rank", dedup.source_rank(F.col("source"), ("src0", "src1"))).withColumn("seq", F.col("key"))
    built = sentence_bank.build(ranked, C.LATIN, F.lower("text"))
    return built.select("unit", "key", F.md5("content").alias("content"), F.array_join("found_tags", "|").alias("tags"))


@query(
    "quality_counts",
    sql(
        ["doc_lines", "phrases"],
        """SELECT source, unit, count(*) AS extracted, count(*) FILTER (NOT verbatim) AS dropped_verbatim, count(*) FILTER (verbatim AND NOT known) AS dropped_known,
             count(*) FILTER (verbatim AND known AND NOT tagged) AS dropped_tagged, count(*) FILTER (verbatim AND known AND tagged) AS final
           FROM flagged GROUP BY GROUPING SETS ((source, unit), (unit), ())""",
        *_STAGES,
    ),
)
def quality_counts(spark, sf):
    return P.quality_counts(_flagged(spark, sf), ["verbatim", "known", "tagged"])
