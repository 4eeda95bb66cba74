"""Text and reading functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.catalog import bindings as B
from lexloom.catalog.bindings import sql, sql_spoken, sql_strip, sql_words
from lexloom.catalog.registry import query
from lexloom.functions import romanise as R
from lexloom.functions import scalars
from lexloom.functions import text as T
from lexloom.functions.rows import unnest
from lexloom.operators import grading
from lexloom.operators.sessions import question_types
from lexloom.plans import lexicon

_CLASSES = {
    "first": C.PUNCT_BANK_FIRST, "bank": C.PUNCT_BANK, "blocklist": C.PUNCT_BLOCKLIST,
    "romanise": C.PUNCT_ROMANISE, "answer": C.PUNCT_ANSWER,
}


def _re2_class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def _wide(text):
    return F.translate(text, ",.?!", "，。？！")


_NORMAL = ", ".join(
    f"""md5({sql_strip(f"regexp_replace(body, '{_re2_class(p)}', '', 'g')")}) AS {n}""" for n, p in _CLASSES.items()
)


@query(
    "normalize_punct",
    sql([], f"SELECT doc_id, {_NORMAL} FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE translate(text, ',.?!', '，。？！') END AS body FROM documents)"),
)
def normalize_punct(spark, sf):
    d = B.table(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(_wide("text"))
    docs = d.select("doc_id", body.alias("body"))
    return docs.select("doc_id", *[F.md5(T.normalize_punct(F.col("body"), p)).alias(n) for n, p in _CLASSES.items()])


@query(
    "normalize_width",
    sql([], r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, ' ', '', 'g'), '\t', '', 'g')) AS body FROM documents"""),
)
def normalize_width(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.normalize_width(F.translate("text", ",.?!:;", "，。？！：；"))).alias("body"))


@query("script_only", sql([], "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-zà-ÿ]', '', 'g')) AS body FROM documents"))
def script_only(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(T.script_only(F.lower("text"), C.LATIN)).alias("body"))


@query(
    "has_script",
    sql(["doc_lines"], "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '[a-zà-ÿ]')) AS n_script FROM doc_lines GROUP BY doc_id"),
)
def has_script(spark, sf):
    lines = B.doc_lines(spark, sf)
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(T.has_script(F.col("line"), C.LATIN)).alias("n_script")
    )


@query(
    "has_paren_hint",
    sql(
        ["doc_lines"],
        r"""SELECT doc_id, count(*) FILTER (regexp_matches(replace(replace(line, ' the ', '（The '), ', ', '）'), '[a-zà-ÿ]+[（(][A-Za-z][A-Za-z\s]*[）)]')) AS n_hints
            FROM doc_lines GROUP BY doc_id""",
    ),
)
def has_paren_hint(spark, sf):
    line = F.replace(F.replace("line", F.lit(" the "), F.lit("（The ")), F.lit(", "), F.lit("）"))
    flag = T.has_paren_hint(line, C.LATIN)
    return B.doc_lines(spark, sf).groupBy("doc_id").agg(F.count_if(flag).alias("n_hints"))


SQL_TEMPLATE = rf"""(regexp_matches(g, '[a-zà-ÿ]') AND length({sql_strip('g')}) >= 4
    AND NOT regexp_matches(g, '[a-zà-ÿ]+[（(][A-Za-z][A-Za-z\s]*[）)]')
    AND (contains(g, '___') OR contains(g, '……') OR regexp_matches(g, '[a-zà-ÿ](/|／)[a-zà-ÿ]')))"""


@query(
    "is_template",
    sql(
        ["doc_lines"],
        f"SELECT doc_id, count(*) FILTER ({SQL_TEMPLATE}) AS n_templates FROM (SELECT doc_id, {B.sql_gapped('line')} AS g FROM doc_lines) GROUP BY doc_id",
    ),
)
def is_template(spark, sf):
    flag = T.is_template(B.gapped(F.col("line")), C.LATIN)
    return B.doc_lines(spark, sf).groupBy("doc_id").agg(F.count_if(flag).alias("n_templates"))


@query("strip_bullet", sql(["doc_lines"], "SELECT doc_id, line_no, md5(regexp_replace(line, '^[\\s]+', '')) AS body FROM doc_lines"))
def strip_bullet(spark, sf):
    number = F.col("line_no").cast("string")
    bullet = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("（"), number, F.lit("） "))).otherwise(F.concat(number, F.lit("  ")))
    lines = B.doc_lines(spark, sf)
    return lines.select("doc_id", "line_no", F.md5(T.strip_bullet(F.concat(bullet, F.regexp_replace("line", r"^\s+", "")))).alias("body"))


_CLAUSES = r"""clauses AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS pos
    FROM (SELECT doc_id, regexp_extract_all(text, '[^.,\n]+[.,] ?') AS l FROM documents))"""


def clauses(spark, sf):
    """Pieces of documents up to a stop or comma, with a gloss that may break off too."""
    found = F.regexp_extract_all("text", F.lit(r"[^.,\n]++(?:[.,] ?)?"), F.lit(0))
    found = F.filter(found, lambda c: c.rlike("[.,] ?$"))
    rows = unnest(B.table(spark, sf, "documents"), found, ["doc_id"], "text", at="pos")
    return rows.withColumn("gloss", F.when(F.col("pos") % 5 == 0, F.lit("so, ")).when(F.col("pos") % 5 != 1, F.lit("so.")))


SQL_TRUNCATED = rf"(regexp_matches(text, '[，,]{B.SPACES}*$') OR pos % 5 = 0)"


@query(
    "is_truncated",
    sql([], f"SELECT doc_id, count(*) AS n, count(*) FILTER ({SQL_TRUNCATED}) AS n_truncated FROM clauses GROUP BY doc_id", _CLAUSES),
)
def is_truncated(spark, sf):
    flag = T.is_truncated(F.col("text"), F.col("gloss"))
    return clauses(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(flag).alias("n_truncated"))


# ------------------------------------------------------------ readings
_READ = f"readings AS (SELECT doc_id, w, {sql_spoken('w')} AS r FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents))"


def _reading_docs(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", B.words_of(F.col("text")).alias("w"))
    return d.withColumn("r", B.spoken(F.col("w")))


@query(
    "sandhi_space_tokens",
    sql(
        [],
        """SELECT doc_id, md5(array_to_string(list_transform(r, lambda t, i: CASE WHEN t = 'bu4'
             AND coalesce(regexp_matches(r[i + 1], '[a-zv]4$'), false) THEN 'bu2' ELSE t END), ' ')) AS reading FROM readings""",
        _READ,
    ),
)
def sandhi_space_tokens(spark, sf):
    reading = R.sandhi_space_tokens(F.array_join("r", "  "))
    return _reading_docs(spark, sf).select("doc_id", F.md5(reading).alias("reading"))


@query(
    "sandhi_word_tags",
    sql(
        [],
        r"""SELECT doc_id, md5(array_to_string(list_transform(w, lambda t, i:
              CASE WHEN t = 'the' THEN CASE WHEN regexp_extract(r[i + 1], '\d') = '4' THEN 'bu2' ELSE 'bu4' END
                   WHEN t = 'and' THEN CASE WHEN regexp_extract(r[i + 1], '\d') IN ('4', '5') THEN 'yi2'
                        WHEN regexp_extract(r[i + 1], '\d') IN ('1', '2', '3') THEN 'yi4' ELSE 'yi1' END
                   ELSE r[i] END), ' ')) AS reading FROM readings""",
        _READ,
    ),
)
def sandhi_word_tags(spark, sf):
    spoken = R.sandhi_word_tags(F.col("w"), F.col("r"), negation="the", one="and")
    return _reading_docs(spark, sf).select("doc_id", F.md5(F.array_join(spoken, " ")).alias("reading"))


_SYLLABLE = f"({C.SYLLABLE_INITIALS}|)({C.SYLLABLE_FINALS})([1-5]?)"


def sql_syllables(x: str) -> str:
    """Syllables with a tone digit on each."""
    return f"""list_transform(regexp_extract_all(lower({x}), '{_SYLLABLE}'),
        lambda s: CASE WHEN regexp_matches(s, '[1-5]$') THEN s ELSE s || '5' END)"""


def sql_sandhi(x: str) -> str:
    return f"""list_transform({x}, lambda s, i: CASE
        WHEN s = 'bu4' AND right({x}[i + 1], 1) = '4' THEN 'bu2'
        WHEN s = 'yi1' AND right({x}[i + 1], 1) = '4' THEN 'yi2'
        WHEN s = 'yi1' AND right({x}[i + 1], 1) IN ('1', '2', '3') THEN 'yi4'
        WHEN s <> 'yi1' AND right(s, 1) = '3' AND right({x}[i + 1], 1) = '3' THEN left(s, length(s) - 1) || '2'
        ELSE s END)"""


@query(
    "split_syllables",
    sql([], f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '')) AS syllables FROM (SELECT doc_id, {sql_syllables('''array_to_string(r, '')''')} AS s FROM readings)", _READ),
)
def split_syllables(spark, sf):
    docs = _reading_docs(spark, sf).select("doc_id", R.split_syllables(F.array_join("r", "")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n"), F.md5(R.render_syllables(F.col("s"))).alias("syllables"))


@query(
    "sandhi_syllables",
    sql([], f"SELECT doc_id, md5(array_to_string({sql_sandhi('syl')}, '')) AS syllables FROM (SELECT doc_id, {sql_syllables('''array_to_string(r, '')''')} AS syl FROM readings)", _READ),
)
def sandhi_syllables(spark, sf):
    docs = _reading_docs(spark, sf).select("doc_id", R.split_syllables(F.array_join("r", "")).alias("s"))
    return docs.select("doc_id", F.md5(R.render_syllables(R.sandhi_syllables(F.col("s")))).alias("syllables"))


_PAIRS = f"""pairs AS (SELECT doc_id, line_no, e, CASE line_no % 4 WHEN 0 THEN e WHEN 1 THEN regexp_replace(e, '[1-4]', '5', 'g')
      WHEN 2 THEN replace(e, '4', '2') ELSE e || 'ma' END AS a, CASE line_no % 4 WHEN 1 THEN e WHEN 2 THEN replace(e, '4', '5') ELSE e END AS b
    FROM (SELECT doc_id, line_no, array_to_string({sql_spoken('w')}, '') AS e FROM (SELECT doc_id, line_no, {sql_words('line')} AS w FROM doc_lines)))"""


@query(
    "tones_match",
    sql(
        ["doc_lines"],
        f"""SELECT doc_id, line_no, len(x) = len(y) AND len(list_filter(range(1, len(x) + 1), lambda i:
              left(x[i], length(x[i]) - 1) = left(y[i], length(y[i]) - 1) AND (right(y[i], 1) = '5' OR right(x[i], 1) = right(y[i], 1)))) = len(x) AS same
            FROM (SELECT doc_id, line_no, {sql_sandhi('x0')} AS x, {sql_sandhi('y0')} AS y FROM
              (SELECT doc_id, line_no, {sql_syllables('a')} AS x0, {sql_syllables('b')} AS y0 FROM pairs))""",
        _PAIRS,
    ),
)
def tones_match(spark, sf):
    e = F.array_join(B.spoken(B.words_of(F.col("line"))), "")
    rows = B.doc_lines(spark, sf).select("doc_id", "line_no", e.alias("e"))
    case = F.col("line_no") % 4
    given = (
        F.when(case == 0, F.col("e")).when(case == 1, F.regexp_replace("e", "[1-4]", "5"))
        .when(case == 2, F.translate("e", "4", "2")).otherwise(F.concat("e", F.lit("ma")))
    )
    expected = F.when(case == 2, F.translate("e", "4", "5")).otherwise(F.col("e"))
    pairs = rows.select("doc_id", "line_no", given.alias("a"), expected.alias("b"))
    return R.with_tones_match(pairs, F.col("a"), F.col("b"), "same").drop("a", "b")


SQL_ROMAN = r"""romanised AS (
    SELECT text, lower(coalesce(string_agg(coalesce(CASE WHEN c = 'z' THEN 'zei2' END, l.reading, c), '' ORDER BY i), '')) AS reading
    FROM (SELECT text, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM
      (SELECT text, string_split(bare, '') AS cs FROM
        (SELECT DISTINCT text, regexp_replace(text, '[。？！，、；："…\s\x{85}\x{a0}\x{3000}]', '', 'g') AS bare FROM wanted)))
    LEFT JOIN letters l ON l.char = c GROUP BY text)"""
OVERRIDES = {"z": "zei2"}


@query(
    "romanise",
    sql(["letters"], "SELECT text, md5(reading) AS reading FROM romanised", "wanted AS (SELECT text FROM conversations)", SQL_ROMAN),
)
def romanise(spark, sf):
    texts = B.table(spark, sf, "conversations")
    table = grading.readings_of(texts, B.letter_readings(spark, sf), OVERRIDES)
    return table.select("text", F.md5("reading").alias("reading"))


@query(
    "homophone_classes",
    sql(
        ["letters"],
        """SELECT e.sound, e.tones, e.n_texts, e.n_rows, e.first_text, CAST(sum(t.n_rows) AS BIGINT) AS n_accepted
           FROM forms e JOIN forms t ON t.sound = e.sound
             AND len(list_filter(range(1, length(e.tones) + 1), lambda i: e.tones[i] = '5' OR e.tones[i] = t.tones[i])) = length(e.tones)
           GROUP BY ALL""",
        """spoken_words AS (SELECT p_name AS text FROM part UNION ALL
             SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM conversations)""",
        "wanted AS (SELECT DISTINCT text FROM spoken_words)",
        SQL_ROMAN,
        f"""forms AS (SELECT array_to_string(list_transform(s, lambda x: left(x, length(x) - 1)), ' ') AS sound,
             array_to_string(list_transform(s, lambda x: right(x, 1)), '') AS tones,
             count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_rows, min(text) AS first_text
           FROM (SELECT text, {sql_sandhi('s0')} AS s FROM (SELECT text, {sql_syllables('reading')} AS s0 FROM romanised))
             JOIN (SELECT text, count(*) AS n FROM spoken_words GROUP BY text) USING (text) GROUP BY ALL)""",
    ),
)
def homophone_classes(spark, sf):
    names = B.table(spark, sf, "part").select(F.col("p_name").alias("text"))
    words = unnest(B.table(spark, sf, "conversations"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), [], "text")
    return grading.homophone_classes(names.unionByName(words), B.letter_readings(spark, sf), overrides=OVERRIDES)


_VOWELS = "aeiouvü" + C.TONE_MARKED


@query(
    "diacritic_to_numeric",
    sql(
        [],
        f"""SELECT word, CASE WHEN regexp_matches(word, '[1-5]') THEN word ELSE array_to_string(list_transform(
              regexp_extract_all(m, '[^{_VOWELS} ''-]*[{_VOWELS}]+r*(?:ng|n)?|[^{_VOWELS} ''-]+'),
              lambda s: translate(translate(s, 'NGRÜ', 'ngrü'), '{C.TONE_MARKED}ü', '{C.TONE_PLAIN}v') ||
                CASE WHEN regexp_extract(s, '[{C.TONE_MARKED}]') = '' THEN '5'
                     ELSE translate(regexp_extract(s, '[{C.TONE_MARKED}]'), '{C.TONE_MARKED}', '{C.TONE_DIGITS}') END), '') END AS numeric
            FROM marked""",
        r"words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ][a-zà-ÿ1-9''-]*')) AS word FROM documents)",
        # n, ng and r before a vowel open a syllable: they are set in capitals first.
        f"""marked AS (SELECT word, regexp_replace(regexp_replace(regexp_replace(word, 'ng([{_VOWELS}])', 'nG\\1', 'g'),
              'n([{_VOWELS}])', 'N\\1', 'g'), 'r([{_VOWELS}])', 'R\\1', 'g') AS m FROM words)""",
    ),
)
def diacritic_to_numeric(spark, sf):
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ][a-zà-ÿ1-9'-]*"), F.lit(0))
    words = unnest(B.table(spark, sf, "documents"), found, [], "word").distinct()
    return words.select("word", R.diacritic_to_numeric(F.col("word")).alias("numeric"))


@query(
    "classify_entry",
    sql([], """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'proper_noun' WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN 'grammar' ELSE 'vocab' END AS type FROM part"""),
)
def classify_entry(spark, sf):
    kind = F.col("p_type")
    pos = F.when(kind == "PROMO", "part.").when(kind == "SMALL", "  Aux. ").when(kind == "LARGE", "助词").when(kind == "ECONOMY", "n.")
    section = F.when(F.col("p_partkey") % 3 == 2, "proper_noun").otherwise("vocab")
    return B.table(spark, sf, "part").select("p_partkey", lexicon.classify(section, pos).alias("type"))


# ------------------------------------------------------------ cloze and answers
@query(
    "cloze_restore",
    sql(["doc_sentences"], f"""SELECT doc_id, pos, md5({sql_strip("CASE WHEN q LIKE '%(%' THEN regexp_replace(q, '[(][^(]*$', '') ELSE q END")}) AS restored
        FROM (SELECT doc_id, pos, text || CASE WHEN pos % 3 = 0 THEN ' (note) (' || lang || ')' ELSE '' END AS q FROM doc_sentences)"""),
)
def cloze_restore(spark, sf):
    note = F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" (note) ("), "lang", F.lit(")"))).otherwise("")
    question = F.concat(F.replace("text", F.lit("the"), F.lit("___")), note)
    rows = B.doc_sentences(spark, sf)
    return rows.select("doc_id", "pos", F.md5(T.cloze_restore(question, F.lit("the"))).alias("restored"))


@query(
    "clean_answer",
    sql(
        [],
        f"""SELECT conv_id, turn, md5({sql_strip(r"regexp_replace(regexp_replace(e, '\ban\b|\ba\b|\bthe\b', '', 'g'), '[\s\x{a0}\x{3000}]+', ' ', 'g')")}) AS answer
            FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '\\bim\\b', 'i am', 'g'), '\\byoure\\b', 'you are', 'g'),
                    '\\bhes\\b', 'he is', 'g'), '\\bshes\\b', 'she is', 'g') AS e
              FROM (SELECT conv_id, turn, regexp_replace(lower('I''m ' || replace(text, ' and ', ' she''s ')), '{_re2_class(C.PUNCT_ANSWER)}', '', 'g') AS p FROM conversations))""",
    ),
)
def clean_answer(spark, sf):
    text = F.concat(F.lit("I'm "), F.replace("text", F.lit(" and "), F.lit(" she's ")))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.clean_answer(text)).alias("answer"))


@query(
    "variant_match",
    sql([], """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN p_type = upper(split_part(p_name, ' ', 1)) ELSE false END AS matched FROM part"""),
)
def variant_match(spark, sf):
    name, kind, case = F.col("p_name"), F.col("p_type"), F.col("p_partkey") % 4
    given = (
        F.when(case == 0, F.concat(F.lit(" The "), F.upper(name), F.lit("!")))
        .when(case == 1, F.lower(kind)).when(case == 2, F.split_part(name, F.lit(" "), F.lit(1))).otherwise(F.lit(""))
    )
    matched = T.variant_match(given, F.concat(F.lit("a "), name, F.lit(", "), kind))
    return B.table(spark, sf, "part").select("p_partkey", matched.alias("matched"))


@query(
    "is_short_answer",
    sql(["doc_lines"], "SELECT doc_id, count(*) FILTER (length(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) <= 2) AS n_short FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS w FROM doc_lines) GROUP BY doc_id"),
)
def is_short_answer(spark, sf):
    words = unnest(B.doc_lines(spark, sf), F.split("line", " "), ["doc_id"], "w")
    return words.groupBy("doc_id").agg(F.count_if(T.is_short_answer(F.col("w"))).alias("n_short"))


@query(
    "hallucination_flag",
    sql([], f"""SELECT a.conv_id, a.turn, length(replace(a.text, ' ', '')) > 3 * length(replace({sql_strip('u.text')}, ' ', '')) AS flag
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'"""),
)
def hallucination_flag(spark, sf):
    c = B.table(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected"))
    return c.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", T.hallucination_flag(F.col("text"), F.col("expected")).alias("flag"))


@query("content_key", sql([], "SELECT p_partkey, md5(p_name || CASE WHEN p_size % 2 = 0 THEN '_slow' ELSE '' END) AS key FROM part"))
def content_key(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", scalars.content_key(F.col("p_name"), F.col("p_size") % 2 == 0).alias("key"))


@query("slug", sql(["bank"], "SELECT id, replace(question_type, ' ', '_') AS slug FROM bank"))
def slug(spark, sf):
    return B.bank(spark, sf).select("id", T.slug(F.col("question_type")).alias("slug"))


@query("clamp_unit", sql([], "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE greatest(p_size % 7, 3) END AS unit FROM part"))
def clamp_unit(spark, sf):
    unit = F.when(F.col("p_size") % 10 != 0, F.col("p_size") % 7)
    return B.table(spark, sf, "part").select("p_partkey", scalars.clamp_unit(unit).alias("unit"))


@query(
    "qtype_dim",
    sql(["types", "bank"], """SELECT question_type, tier, unlock, priority, speaking, sentence, source_type, count(*) AS n_questions
        FROM types JOIN bank USING (question_type) GROUP BY ALL"""),
)
def qtype_dim(spark, sf):
    counts = B.bank(spark, sf).groupBy("question_type").agg(F.count("*").alias("n_questions"))
    return counts.join(question_types(spark), "question_type").drop("slug")
