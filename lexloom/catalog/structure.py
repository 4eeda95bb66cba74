"""Filters, generators and the structure of course text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.catalog import bindings as B
from lexloom.catalog.bindings import sql, sql_gapped, sql_strip, sql_words
from lexloom.catalog.registry import query
from lexloom.catalog.wording import _CLAUSES, SQL_ROMAN, SQL_TEMPLATE, SQL_TRUNCATED, clauses
from lexloom.functions.rows import unnest
from lexloom.functions.text import is_truncated, sentences_of
from lexloom.operators import cloze, grading, sections, segmentation
from lexloom.operators import questions as Q
from lexloom.operators.containment import content_tags
from lexloom.plans import lexicon

START, END = ["The ", "Les ", "Die "], ["And ", "De ", "Und "]

# ------------------------------------------------------------ lexicon rows
_RAW = """raw AS (SELECT p_partkey AS seq,
    CASE p_size % 10 WHEN 0 THEN '   ' WHEN 1 THEN p_name || ' [unclear]' WHEN 2 THEN NULL ELSE '  ' || p_name || ' ' END AS word,
    CASE WHEN p_size % 11 = 0 THEN '[unclear]' ELSE p_brand END AS reading,
    CASE p_size % 7 WHEN 0 THEN 'x' WHEN 1 THEN ' 5 ' WHEN 2 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS unit FROM part)"""


def raw_entries(spark, sf):
    """Index rows as read: unclear marks, blanks and unit numbers that are none."""
    size, name = F.col("p_size"), F.col("p_name")
    word = (
        F.when(size % 10 == 0, F.lit("   ")).when(size % 10 == 1, F.concat(name, F.lit(" [unclear]")))
        .when(size % 10 != 2, F.concat(F.lit("　 "), name, F.lit(" ")))
    )
    unit = F.when(size % 7 == 0, F.lit("x")).when(size % 7 == 1, F.lit(" 5 ")).when(size % 7 != 2, size.cast("string"))
    return B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), word.alias("word"),
        F.when(size % 11 == 0, F.lit("[unclear]")).otherwise(F.col("p_brand")).alias("reading"),
        unit.alias("unit"), "p_type", "p_name",
    )


@query(
    "reject_unusable",
    sql([], r"""SELECT seq, trim(coalesce(word, '')) AS word, TRY_CAST(trim(unit) AS INTEGER) AS unit_no,
          trim(coalesce(word, '')) <> '' AND NOT contains(coalesce(word, ''), '[unclear]') AND reading <> '[unclear]'
            AND TRY_CAST(trim(unit) AS INTEGER) IS NOT NULL AS usable FROM raw""", _RAW),
)
def reject_unusable(spark, sf):
    raw = raw_entries(spark, sf)
    good, bad = lexicon.reject_unusable(raw)
    rows = good.withColumn("usable", F.lit(True)).unionByName(bad.withColumn("usable", F.lit(False)))
    return rows.select("seq", "word", "unit_no", "usable")


@query("drop_truncated", sql([], f"SELECT doc_id, pos, md5(text) AS text FROM clauses WHERE NOT {SQL_TRUNCATED}", _CLAUSES.replace("unnest(range(len(l))) AS pos", "CAST(unnest(range(len(l))) AS INTEGER) AS pos")))
def drop_truncated(spark, sf):
    whole = clauses(spark, sf).where(~is_truncated(F.col("text"), F.col("gloss")))
    return whole.select("doc_id", "pos", F.md5("text").alias("text"))


@query("type_filter", sql(["types", "bank"], "SELECT id, question_type FROM bank JOIN types USING (question_type) WHERE sentence"))
def type_filter(spark, sf):
    return B.bank(spark, sf).where(F.col("question_type").isin(C.SENTENCE_TYPES)).select("id", "question_type")


@query("meta_tag_filter", sql(["bank", "tagged"], "SELECT id, string_agg(tag, ',' ORDER BY CASE WHEN tag = 'tag_' || (seq % 10) THEN 0 ELSE 1 END) AS tags FROM tagged GROUP BY id"))
def meta_tag_filter(spark, sf):
    return B.bank(spark, sf).select("id", F.array_join(content_tags(F.col("tags")), ",").alias("tags"))


@query("explode_tags", sql(["bank", "tagged"], "SELECT id, unit, tag FROM tagged"))
def explode_tags(spark, sf):
    return B.tagged_bank(spark, sf).select("id", "unit", "tag")


@query(
    "fill_missing",
    sql(
        ["letters"],
        """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_brand WHEN p_name = 'red plate' THEN 'hong2pan2' ELSE reading END AS reading
           FROM part LEFT JOIN romanised ON text = p_name""",
        "wanted AS (SELECT p_name AS text FROM part)",
        SQL_ROMAN.replace("CASE WHEN c = 'z' THEN 'zei2' END", "NULL"),
    ),
)
def fill_missing(spark, sf):
    rows = B.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("word"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("reading")
    )
    filled = grading.fill_missing(rows, "word", "reading", B.letter_readings(spark, sf), {"red plate": "hong2pan2"})
    return filled.select("p_partkey", "reading")


# ------------------------------------------------------------ sections of documents
def _has(x: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{v}')" for v in values) + ")"


_STATE = f"""state AS (SELECT doc_id, line_no, line,
    last_value(CASE WHEN {_has('line', END)} THEN 0 WHEN {_has('line', START)} THEN 1 END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY line_no) AS inside FROM doc_lines)"""
_KEPT = f"""kept AS (SELECT doc_id, line_no, line FROM (SELECT *, max(CASE WHEN inside = 1 AND {sql_strip('line')} <> '' THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id) AS found FROM state) WHERE inside = 1 OR found = 0)"""


def _gapped_docs(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", B.gapped(F.col("text")).alias("text"))


@query(
    "section_extract",
    sql(["doc_lines"], "SELECT doc_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM kept GROUP BY doc_id", _STATE, _KEPT),
)
def section_extract(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    kept = sections.extract_sections(docs, start=START, end=END)
    return kept.select("doc_id", F.size("kept").alias("n"), F.md5(F.array_join("kept", "\n")).alias("body"))


_GAPPED_LINES = f"""doc_lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no
    FROM (SELECT doc_id, string_split({sql_gapped('text')}, chr(10)) AS l FROM documents))"""


@query(
    "template_extract",
    sql(
        [],
        r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS seq, md5(template) AS template
            FROM (SELECT doc_id, template, min(line_no) AS first FROM cleaned WHERE template <> '' GROUP BY doc_id, template)""",
        _GAPPED_LINES, _STATE, _KEPT,
        rf"""cleaned AS (SELECT doc_id, line_no, {sql_strip(r"regexp_replace(g, '^[（(]?\d+[）)]?\s*', '')")} AS template
            FROM (SELECT doc_id, line_no, {sql_strip('line')} AS g FROM kept) WHERE {SQL_TEMPLATE})""",
    ),
)
def template_extract(spark, sf):
    found = sections.extract_templates(_gapped_docs(spark, sf), script=C.LATIN, start=START, end=END)
    return found.select("doc_id", "seq", F.md5("template").alias("template"))


_HTML_LINES = """html_lines AS (SELECT page_id, unnest(l) AS line, unnest(range(len(l))) AS line_no
    FROM (SELECT page_id, string_split(replace(html, '<', chr(10) || '<'), chr(10)) AS l FROM pages))"""


@query(
    "section_drop",
    sql(
        [],
        """SELECT page_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM
           (SELECT *, last_value(CASE WHEN regexp_matches(line, '^<(h1|p|div|nav|footer|article)') THEN
               CASE WHEN contains(line, '<nav') OR contains(line, '<div') OR contains(line, '<footer') THEN 0 ELSE 1 END END IGNORE NULLS)
               OVER (PARTITION BY page_id ORDER BY line_no) AS keep FROM html_lines)
           WHERE coalesce(keep, 1) = 1 GROUP BY page_id""",
        _HTML_LINES,
    ),
)
def section_drop(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<"), F.lit("\n<")).alias("text"))
    kept = sections.drop_sections(pages, heading="^<(h1|p|div|nav|footer|article)", skipped=["<nav", "<div", "<footer"])
    return kept.select("page_id", F.size("kept").alias("n"), F.md5(F.array_join("kept", "\n")).alias("body"))


@query(
    "md_table_rows",
    sql(
        [],
        """SELECT p_partkey, p_name AS word, p_brand AS reading, pos, CASE pos WHEN 'n.' THEN 'noun' WHEN 'm.' THEN 'measure_word' WHEN 'part.' THEN 'particle' ELSE 'other' END AS pos_name,
                  p_type AS gloss, p_size AS unit, CASE WHEN pos IN ('m.', 'part.') THEN 'grammar' ELSE 'vocab' END AS type
           FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'n.' WHEN 1 THEN 'm.' WHEN 2 THEN 'part.' ELSE '' END AS pos FROM part)
           UNION ALL SELECT p_partkey, p_type, p_brand, '', NULL, p_name, p_size, 'proper_noun' FROM part""",
    ),
)
def md_table_rows(spark, sf):
    name, brand, kind, size = (F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))
    case = F.col("p_partkey") % 4
    pos = F.when(case == 0, "n.").when(case == 1, "m.").when(case == 2, "part.").otherwise("")

    def row(*cells):
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    text = F.concat_ws(
        "\n",
        F.lit("Index"), F.lit("## 词语表 Vocabulary"), F.lit("| Word | Pinyin | POS | English | Unit |"), F.lit("| --- | --- | --- | --- | --- |"),
        F.lit("| A | | | | |"), row(name, brand, pos, kind, F.concat(size, F.lit(" (notes)"))), F.lit(""),
        F.lit("## 专有名词 Proper Nouns"), F.lit("| Word | Pinyin | English | Unit |"), F.lit("|---|---|---|---|"), row(kind, brand, name, size),
    )
    docs = B.table(spark, sf, "part").select("p_partkey", text.alias("text"))
    return sections.table_rows(docs).drop("line_no")


_RUNS = r"regexp_extract_all({x}, '[^.!?。？！\n]+[.!?。？！]?')"


@query(
    "cloze_find",
    sql(
        [],
        f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS seq, md5({sql_strip('s')}) AS blanked FROM
            (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT doc_id, {_RUNS.format(x=r"regexp_replace(regexp_replace(text, ' (the|de) ', ' ___ ', 'g'), '(_{2,}|[(] *[)])', '___', 'g')")} AS l FROM documents))
            WHERE contains(s, '___')""",
    ),
)
def cloze_find(spark, sf):
    blank = F.regexp_replace(F.regexp_replace("text", " the ", " ____ "), " de ", " （　） ")
    docs = B.table(spark, sf, "documents").select("doc_id", blank.alias("text"))
    return sections.find_cloze(docs).select("doc_id", "seq", F.md5("blanked").alias("blanked"))


@query(
    "sentence_find",
    sql(
        [],
        rf"""SELECT doc_id, CAST(i AS INTEGER) AS seq, md5(g) AS sentence FROM
            (SELECT doc_id, {sql_strip('s')} AS g, i FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM
              (SELECT doc_id, regexp_extract_all({sql_gapped('text')}, '[^.!?。？！\n]+[.!?。？！]') AS l FROM documents)))
            WHERE regexp_matches(g, '[a-zà-ÿ]') AND NOT contains(g, '___') AND NOT contains(g, '……') AND NOT regexp_matches(g, '[a-zà-ÿ](/|／)[a-zà-ÿ]')
              AND NOT regexp_matches(g, '[a-zà-ÿ][（(][A-Za-z][A-Za-z\s]*[）)]')""",
    ),
)
def sentence_find(spark, sf):
    found = sections.find_sentences(_gapped_docs(spark, sf), script=C.LATIN)
    return found.select("doc_id", "seq", F.md5("sentence").alias("sentence"))


# ------------------------------------------------------------ questions
KINDS = ["vocab", "grammar", "proper_noun", "sentence", "cloze"]
_ITEMS = """items AS (SELECT p_partkey AS seq, (['vocab','grammar','proper_noun','sentence','cloze'])[p_partkey % 5 + 1] AS kind,
    3 + p_size % 13 AS unit, CAST(p_partkey % 5 AS INTEGER) AS section_rank, p_name AS text, p_brand AS reading, p_type AS gloss,
    p_name || ' ___' AS q, p_type AS a FROM part)"""
_PLAN = "plan(kind, question_type, qf, af) AS (VALUES " + ", ".join(
    f"('{kind}', '{t}', '{q}', '{a}')" for kind, rows in C.QUESTION_PLAN.items() for t, q, a in rows
) + ")"
_PICK = "CASE {f} WHEN 'text' THEN text WHEN 'reading' THEN reading WHEN 'gloss' THEN gloss WHEN 'question' THEN q ELSE a END"
_ASKED = f"asked AS (SELECT seq, kind, unit, section_rank, question_type, {_PICK.format(f='qf')} AS question, {_PICK.format(f='af')} AS answer FROM items JOIN plan USING (kind))"


def _items(spark, sf):
    p = B.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("seq"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("kind"),
        (3 + F.col("p_size") % 13).alias("unit"),
        (F.col("p_partkey") % 5).cast("int").alias("section_rank"),
        F.col("p_name").alias("text"), F.col("p_brand").alias("reading"), F.col("p_type").alias("gloss"),
        F.concat("p_name", F.lit(" ___")).alias("question"), F.col("p_type").alias("answer"),
    )


@query("question_expand", sql([], "SELECT seq, kind, unit, question_type, question, answer FROM asked", _ITEMS, _PLAN, _ASKED))
def question_expand(spark, sf):
    return Q.expand_items(_items(spark, sf)).select("seq", "kind", "unit", "question_type", "question", "answer")


@query(
    "question_id",
    sql(
        [],
        """SELECT seq, question_type, 'u' || unit || '_' || replace(question_type, ' ', '_') || '_' ||
             row_number() OVER (PARTITION BY unit, question_type ORDER BY section_rank, seq) AS id FROM asked""",
        _ITEMS, _PLAN, _ASKED,
    ),
)
def question_id(spark, sf):
    return Q.add_ids(Q.expand_items(_items(spark, sf))).select("seq", "question_type", "id")


@query(
    "word_units",
    sql(
        ["doc_sentences"],
        # A tag never goes beyond a run of letters, so every distinct run is walked once.
        """SELECT doc_id, CAST(n_other + coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_tags, 0) AS BIGINT) AS n_tags,
                  round(tagged / letters, 6) AS covered
           FROM (SELECT doc_id, sum(len(regexp_extract_all(low, '[^a-zà-ÿ]+'))) AS n_other FROM sentences GROUP BY doc_id)
           LEFT JOIN (SELECT doc_id, sum(steps) AS n_units, sum(tags) AS n_tags, sum(letters) AS tagged, sum(length(run)) AS letters
             FROM runs JOIN (
               WITH RECURSIVE walk AS (
                 SELECT DISTINCT run, 1 AS p, 0 AS l FROM runs
                 UNION ALL
                 SELECT w.run, w.p + coalesce(h.l, 1), coalesce(h.l, 0) FROM walk w LEFT JOIN hits h ON h.run = w.run AND h.p = w.p WHERE w.p <= length(w.run))
               SELECT run, count(*) - 1 AS steps, count(*) FILTER (l > 0) AS tags, sum(l) AS letters FROM walk GROUP BY run) USING (run) GROUP BY doc_id) USING (doc_id)""",
        "sentences AS (SELECT doc_id, lower(text) AS low FROM doc_sentences)",
        "runs AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(low, '[a-zà-ÿ]+')) AS run FROM sentences)",
        "tags AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS tag FROM benchmark)",
        """hits AS MATERIALIZED (SELECT run, p, max(n) AS l FROM (SELECT run, unnest(range(1, length(run) + 1)) AS p FROM (SELECT DISTINCT run FROM runs))
             CROSS JOIN (SELECT DISTINCT length(tag) AS n FROM tags) JOIN tags ON tag = substr(run, p, n) AND length(tag) = n GROUP BY run, p)""",
    ),
)
def word_units(spark, sf):
    taught = unnest(B.table(spark, sf, "benchmark"), B.words_of(F.lower("text")), [], "tag")
    rows = B.doc_sentences(spark, sf).withColumn("low", F.lower("text"))
    split = segmentation.with_word_units(rows, taught, "low", "u", C.LATIN)
    hits = F.transform(F.filter("u", lambda x: x["tag"]), lambda x: x["unit"])
    letters = F.length(F.regexp_replace("low", "[^a-zà-ÿ]", ""))
    return split.groupBy("doc_id").agg(
        F.sum(F.size("u")).alias("n_units"),
        F.sum(F.size(hits)).alias("n_tags"),
        F.round(F.try_divide(F.sum(F.length(F.array_join(hits, ""))), F.sum(letters)), 6).alias("covered"),
    )


@query(
    "replace_cycle",
    sql(
        ["types", "bank"],
        """SELECT id, question AS old, question_type, CASE WHEN sentence AND seq % 3 > 0 THEN
               (string_split(question, ' ') || [question])[(row_number() OVER (PARTITION BY question, sentence AND seq % 3 > 0 ORDER BY unit, seq) - 1)
                 % (len(string_split(question, ' ')) + 1) + 1] ELSE question END AS question
           FROM (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN question || '!' ELSE question END AS question) FROM bank) JOIN types USING (question_type)""",
    ),
)
def replace_cycle(spark, sf):
    # A third of the questions end in a way that is not among the combined sentences.
    known = B.bank(spark, sf).select("question").distinct()
    parts = F.concat(F.split("question", " "), F.array("question"))
    splits = known.select(F.col("question").alias("combined"), parts.alias("parts"))
    other = F.when(F.col("seq") % 3 == 0, F.concat("question", F.lit("!"))).otherwise(F.col("question"))
    bank = B.bank(spark, sf).withColumns({"question": other, "old": other})
    return Q.replace_cycle(bank, splits).select("id", "old", "question_type", "question")


# ------------------------------------------------------------ cloze
@query(
    "cloze_expand",
    sql(
        ["doc_sentences"],
        """SELECT doc_id, pos, CAST(i AS INTEGER) AS blank_no, md5(array_to_string(list_transform(parts, lambda p, j: p || CASE WHEN j = len(parts) THEN '' WHEN j = i + 1 THEN '___' ELSE 'de' || j END), '')
              || CASE WHEN pos % 2 = 0 THEN ' (' || lang || ')' ELSE '' END) AS question, 'de' || (i + 1) AS answer
           FROM (SELECT *, unnest(range(len(parts) - 1)) AS i FROM (SELECT doc_id, pos, lang, string_split(replace(text, ' de ', ' ___ '), '___') AS parts FROM doc_sentences) WHERE pos % 7 <> 6)""",
    ),
)
def cloze_expand(spark, sf):
    rows = B.doc_sentences(spark, sf)
    blanked = F.replace("text", F.lit(" de "), F.lit(" ___ "))
    n = F.size(F.split(blanked, "___")) - 1
    # One answer too many now and then: such items are skipped.
    count = F.when(F.col("pos") % 7 == 6, n + 1).otherwise(n)
    answers = F.transform(F.filter(F.sequence(F.lit(0), count), lambda i: i > 0), lambda i: F.concat(F.lit("de"), i))
    items = rows.select(
        "doc_id", "pos", blanked.alias("blanked"), answers.alias("answers"),
        F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" "), "lang")).alias("gloss"),
    )
    return cloze.expand(items).select("doc_id", "pos", "blank_no", F.md5("question").alias("question"), "answer")


_CONV_SENTENCES = rf"""conv_sentences AS (SELECT conv_id || ':' || turn || ':' || i AS key, CAST(3 + turn % 3 AS INTEGER) AS unit, role AS gloss, {sql_strip('s')} AS text FROM
    (SELECT *, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT *, regexp_extract_all(text, '[^.!?。？！\n]+[.!?。？！]') AS l FROM conversations)))"""
MARKERS = [(3, "the"), (3, "de"), (3, "und"), (4, "and"), (4, "la"), (5, "of"), (5, "der"), (5, "the")]


def conv_sentences(spark, sf):
    c = B.table(spark, sf, "conversations")
    rows = unnest(c, sentences_of(F.col("text")), ["conv_id", "turn", "role"], "text", at="i")
    return rows.select(
        F.concat_ws(":", "conv_id", "turn", "i").alias("key"), (3 + F.col("turn") % 3).cast("int").alias("unit"), F.col("role").alias("gloss"), "text"
    )


@query(
    "cloze_generate",
    sql(
        [],
        """SELECT key, s.unit, md5(substr(text, 1, instr(text, word) - 1) || '___' || substr(text, instr(text, word) + length(word)) || '(' || gloss || ')') AS question, word AS answer
           FROM conv_sentences s JOIN markers m ON m.unit = s.unit AND contains(text, word)""",
        _CONV_SENTENCES,
        "markers(unit, word) AS (VALUES " + ", ".join(f"({u}, '{w}')" for u, w in MARKERS) + ")",
    ),
)
def cloze_generate(spark, sf):
    markers = spark.createDataFrame(MARKERS, "unit int, word string")
    found = cloze.generate(conv_sentences(spark, sf), markers, "key")
    return found.select("key", "unit", F.md5("question").alias("question"), "answer")


@query(
    "pair_gloss",
    sql(
        [],
        """SELECT s.conv_id, s.block, s.n, md5(s.text) AS source_line, md5(g.text) AS gloss_line FROM numbered s JOIN numbered g
           ON s.conv_id = g.conv_id AND s.block = g.block AND s.n = g.n AND NOT s.gloss AND g.gloss""",
        # Every fourth turn changes sides, so blocks have several lines and some have no partner.
        """said AS (SELECT *, (role = 'assistant') <> (turn % 4 = 3) AS gloss FROM conversations),
        blocks AS (SELECT *, CAST(sum(o) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM
          (SELECT *, CASE WHEN NOT gloss AND coalesce(lag(gloss) OVER (PARTITION BY conv_id ORDER BY turn), false) THEN 1 ELSE 0 END AS o FROM said)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block, gloss ORDER BY turn) AS n FROM blocks)""",
    ),
)
def pair_gloss(spark, sf):
    gloss = (F.col("role") == "assistant") != (F.col("turn") % 4 == 3)
    pairs = sections.pair_gloss(B.table(spark, sf, "conversations"), "conv_id", "turn", gloss)
    return pairs.select("conv_id", "block", "n", F.md5("source_line").alias("source_line"), F.md5("gloss_line").alias("gloss_line"))


@query(
    "filled_validate",
    sql(
        ["benchmark_sentences"],
        f"""SELECT key, md5(text) AS text FROM filled WHERE NOT contains(text, '/') AND NOT contains(text, '……') AND NOT contains(text, '___') AND key NOT IN
            (SELECT key FROM (SELECT key, unit, unnest({sql_words('text')}) AS tok FROM filled) f WHERE NOT EXISTS (SELECT 1 FROM taught t WHERE t.unit = f.unit AND t.tok = f.tok))""",
        f"filled AS (SELECT item_id || ':' || pos AS key, CAST(item_id % 2 AS INTEGER) AS unit, lower({sql_gapped('text')}) AS text FROM benchmark_sentences)",
        f"taught AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS unit, unnest({sql_words('text')}) AS tok FROM documents)",
    ),
)
def filled_validate(spark, sf):
    filled = B.benchmark_sentences(spark, sf).select(
        F.concat_ws(":", "item_id", "pos").alias("key"), (F.col("item_id") % 2).cast("int").alias("unit"), F.lower(B.gapped(F.col("text"))).alias("text")
    )
    unit_text = B.table(spark, sf, "documents").select(F.when(F.col("lang") == "en", 0).otherwise(1).alias("unit"), F.lower("text").alias("text"))
    return cloze.validate_filled(filled, unit_text, "key", C.LATIN).select("key", F.md5("text").alias("text"))


@query(
    "ocr_quality",
    sql(
        ["doc_lines"],
        """SELECT source, lang, count(*) AS n_lines, count(*) FILTER (contains(m, '[unclear]')) AS n_unclear, count(*) FILTER (contains(m, '[blank page]')) AS n_blank_page,
                  count(*) FILTER (contains(m, '[non-text page]')) AS n_non_text_page, count(*) FILTER (contains(m, '[illustration')) AS n_illustration
           FROM (SELECT source, lang, replace(replace(replace(line, ' the ', ' [unclear] '), ' de ', ' [illustration: left] '), 'und', '[blank page]') AS m FROM doc_lines) GROUP BY source, lang""",
    ),
)
def ocr_quality(spark, sf):
    line = F.replace("line", F.lit(" the "), F.lit(" [unclear] "))
    line = F.replace(F.replace(line, F.lit(" de "), F.lit(" [illustration: left] ")), F.lit("und"), F.lit("[blank page]"))
    return sections.quality_markers(B.doc_lines(spark, sf).withColumn("line", line), ["source", "lang"])
