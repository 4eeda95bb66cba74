"""Joins: verbatim checks, vocabulary, blocklists, tags, segmentation, grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.catalog import bindings as B
from lexloom.catalog.bindings import LEARNER, sql, sql_strip, sql_words
from lexloom.catalog.registry import query
from lexloom.catalog.wording import OVERRIDES, SQL_ROMAN, sql_sandhi, sql_syllables
from lexloom.functions.rows import unnest
from lexloom.functions.scalars import content_key
from lexloom.functions.text import sentences_of
from lexloom.operators import containment as K
from lexloom.operators import grading
from lexloom.operators import segmentation as G
from lexloom.operators import sessions
from lexloom.operators.dedup import first_section

# ------------------------------------------------------------ verbatim
# Sentences are taken from the texts with line breaks turned to blanks, so some
# run over two lines; every fourth is put to the next document, where it is not.
SQL_CANDIDATES = rf"""candidates AS (SELECT CASE WHEN i % 4 = 3 THEN doc_id + 1 ELSE doc_id END AS doc_id, lang, source,
      doc_id || ':' || i AS key, {sql_strip('s')} AS text FROM
      (SELECT doc_id, lang, source, unnest(l) AS s, unnest(range(len(l))) AS i FROM
        (SELECT *, regexp_extract_all(replace(text, chr(10), ' '), '[^.!?。？！\n]+[.!?。？！]') AS l FROM documents)))"""
_VERBATIM = """verbatim AS (SELECT c.*, coalesce(EXISTS (SELECT 1 FROM bare_lines b WHERE b.doc_id = c.doc_id AND contains(b.line, replace(c.text, ' ', ''))), false) AS verbatim
    FROM candidates c)"""
_BARE = "bare_lines AS (SELECT doc_id, replace(line, ' ', '') AS line FROM doc_lines)"


def candidates(spark, sf):
    d = B.table(spark, sf, "documents")
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    rows = unnest(d, sentences_of(flat), ["doc_id", "lang", "source"], "text", at="i")
    moved = F.when(F.col("i") % 4 == 3, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    return rows.select(moved.alias("doc_id"), "lang", "source", F.concat_ws(":", "doc_id", "i").alias("key"), "text")


def documents(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("doc_text"))


@query("verbatim_filter", sql(["doc_lines"], "SELECT key, doc_id, verbatim FROM verbatim", SQL_CANDIDATES, _BARE, _VERBATIM))
def verbatim_filter(spark, sf):
    return K.flag_verbatim(candidates(spark, sf), documents(spark, sf), ["doc_id"]).select("key", "doc_id", "verbatim")


@query(
    "verbatim_cloze",
    sql(
        ["doc_lines"],
        r"""SELECT key, doc_id, coalesce(EXISTS (SELECT 1 FROM bare_lines b WHERE b.doc_id = c.doc_id AND regexp_matches(b.line,
              array_to_string(list_transform(string_split(replace(replace(c.text, ' ', ''), 'th', '___'), '___'), lambda p: regexp_escape(p)), '.*?'))), false) AS verbatim
            FROM candidates c WHERE contains(text, 'th')""",
        SQL_CANDIDATES, _BARE,
    ),
)
def verbatim_cloze(spark, sf):
    items = candidates(spark, sf).where(F.col("text").contains("th"))
    blanked = items.withColumn("question", F.replace("text", F.lit("th"), F.lit("___")))
    return K.flag_verbatim_cloze(blanked, documents(spark, sf), ["doc_id"]).select("key", "doc_id", "verbatim")


# ------------------------------------------------------------ known vocabulary
@query(
    "known_words",
    sql(["phrases"], """SELECT u.unit, count(*) AS n_known FROM (SELECT DISTINCT unit FROM phrases UNION SELECT DISTINCT 3 + p_size % 13 FROM part) u
        JOIN phrases p ON p.unit <= u.unit GROUP BY u.unit"""),
)
def known_words(spark, sf):
    return G.known_word_counts(B.phrase_lexicon(spark, sf), B.entries(spark, sf)).where("n_known > 0")


# The lexicon of the gate: part names teach letters unit by unit.
_CHARS = """chars AS (SELECT ch, min(unit) AS unit FROM (SELECT 3 + length(p_name) % 13 AS unit, unnest(string_split(regexp_replace(p_name, '[^a-zà-ÿ]', '', 'g'), '')) AS ch FROM part) GROUP BY ch)"""


def gate_lexicon(spark, sf):
    return B.table(spark, sf, "part").select(F.col("p_name").alias("word"), (3 + F.length("p_name") % 13).alias("unit"))


@query(
    "known_chars",
    sql([], "SELECT u.unit, coalesce(string_agg(ch, '' ORDER BY ch), '') AS known FROM (SELECT DISTINCT 3 + p_size % 13 AS unit FROM part) u LEFT JOIN chars c ON c.unit <= u.unit GROUP BY u.unit", _CHARS),
)
def known_chars(spark, sf):
    return G.known_chars(gate_lexicon(spark, sf), B.entries(spark, sf), C.LATIN)


SQL_GATED = """gated AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(regexp_replace(lower(s.text), '[^a-zà-ÿ]', '', 'g'), '')) AS ch) x
      LEFT JOIN chars c ON c.ch = x.ch WHERE x.ch <> '' AND (c.ch IS NULL OR c.unit > s.unit)) AS known FROM gate_rows s)"""


@query(
    "vocab_gate",
    sql(["doc_sentences"], "SELECT doc_id, pos, unit, known FROM gated", _CHARS, "gate_rows AS (SELECT doc_id, pos, CAST(3 + doc_id % 13 AS INTEGER) AS unit, text FROM doc_sentences)", SQL_GATED),
)
def vocab_gate(spark, sf):
    rows = B.doc_sentences(spark, sf).withColumn("unit", (3 + F.col("doc_id") % 13).cast("int"))
    return G.flag_vocab_gate(rows, gate_lexicon(spark, sf), C.LATIN, F.lower("text")).select("doc_id", "pos", "unit", "known")


# ------------------------------------------------------------ blocklists
def _bare(x: str, chars: str) -> str:
    return sql_strip(f"regexp_replace({x}, '[{chars}]', '', 'g')")


@query(
    "blocklist_filter",
    sql(["doc_sentences", "benchmark_sentences"], f"""SELECT doc_id, pos FROM doc_sentences WHERE {_bare('text', '''.?!,"\'\'''')} NOT IN (SELECT {_bare('text', '''.?!,"\'\'''')} FROM benchmark_sentences)"""),
)
def blocklist_filter(spark, sf):
    blocked = B.benchmark_sentences(spark, sf).select(F.col("text").alias("line"))
    return K.drop_blocked(B.doc_sentences(spark, sf), blocked, F.col("text")).select("doc_id", "pos")


_BANK2 = """asked AS (SELECT doc_id, pos, question_type, sentence, text AS question, CASE WHEN pos % 2 = 0 THEN text ELSE lang END AS answer
    FROM (SELECT *, row_number() OVER (ORDER BY priority DESC) - 1 AS n FROM types) t JOIN doc_sentences s ON pos % 10 = n)"""


_KEPT2 = f"""kept AS (SELECT * FROM asked WHERE NOT sentence OR NOT (
          {_bare('upper(question)', '.?!,')} IN (SELECT b FROM blocked) OR {_bare('answer', '.?!,')} IN (SELECT b FROM blocked)))"""
_BLOCKED2 = f"blocked AS (SELECT {_bare('text', '.?!,')} AS b FROM benchmark_sentences)"


def _asked(spark, sf):
    rows = B.doc_sentences(spark, sf)
    types = F.array(*[F.lit(t) for t in C.TYPE_NAMES])
    return rows.select(
        "doc_id", "pos", (3 + F.col("doc_id") % 5).alias("unit"), F.element_at(types, F.col("pos") % 10 + 1).alias("question_type"),
        F.upper("text").alias("question"), F.when(F.col("pos") % 2 == 0, F.col("text")).otherwise(F.col("lang")).alias("answer"),
    )


@query(
    "blocklist_apply",
    sql(["types", "doc_sentences", "benchmark_sentences"], "SELECT doc_id, pos, question_type FROM kept", _BANK2, _BLOCKED2, _KEPT2),
)
def blocklist_apply(spark, sf):
    blocked = B.benchmark_sentences(spark, sf).select(F.col("text").alias("line"))
    return K.apply_blocklist(_asked(spark, sf), blocked).select("doc_id", "pos", "question_type")


@query(
    "blocklist_removed",
    sql(
        ["types", "doc_sentences", "benchmark_sentences"],
        """SELECT unit, count(*) AS questions, CAST(sum(CASE WHEN k THEN 0 ELSE 1 END) AS BIGINT) AS removed FROM (
             SELECT 3 + doc_id % 5 AS unit, (doc_id, pos) IN (SELECT (doc_id, pos) FROM kept) AS k FROM asked) GROUP BY ROLLUP (unit)""",
        _BANK2, _BLOCKED2, _KEPT2,
    ),
)
def blocklist_removed(spark, sf):
    blocked = B.benchmark_sentences(spark, sf).select(F.col("text").alias("line"))
    asked = _asked(spark, sf)
    return K.removed_counts(asked, K.apply_blocklist(asked, blocked))


# ------------------------------------------------------------ tags
_DOC_WORDS = f"doc_words AS (SELECT DISTINCT unnest({sql_words('text')}) AS word FROM documents)"


@query(
    "tag_containment",
    sql(["benchmark_sentences"], """SELECT key, array_to_string(list(word ORDER BY length(word) DESC, word), ' ') || ' speaking_sentence unit_7' AS tags
        FROM (SELECT item_id || ':' || pos AS key, text FROM benchmark_sentences) s JOIN doc_words ON contains(text, word) GROUP BY key""", _DOC_WORDS),
)
def tag_containment(spark, sf):
    texts = B.benchmark_sentences(spark, sf).select(F.concat_ws(":", "item_id", "pos").alias("key"), "text")
    words = unnest(B.table(spark, sf, "documents"), F.array_distinct(B.words_of(F.col("text"))), [], "word")
    found = K.contained_words(texts, words, "key").groupBy("key").agg(F.collect_set("word").alias("w"))
    return found.select("key", F.array_join(K.question_tags(F.col("w"), F.lit("speaking sentence"), F.lit(7)), " ").alias("tags"))


@query(
    "dictionary_lookup",
    sql(
        ["entries", "letters"],
        """SELECT w.word, CASE WHEN d.word IS NULL THEN r.reading ELSE d.reading END AS reading, d.gloss FROM words w LEFT JOIN dict d ON d.word = w.word LEFT JOIN romanised r ON r.text = w.word""",
        "words AS (SELECT DISTINCT unnest(string_split(p_name, ' ') || [p_name]) AS word FROM part)",
        "dict AS (SELECT word, reading, gloss FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY section_rank, seq) AS n FROM entries) WHERE n = 1)",
        "wanted AS (SELECT word AS text FROM words)", SQL_ROMAN,
    ),
)
def dictionary_lookup(spark, sf):
    name = F.col("p_name")
    words = B.table(spark, sf, "part").select(F.explode(F.concat(F.split(name, " "), F.array(name))).alias("word")).distinct()
    return grading.lookup(words, first_section(B.entries(spark, sf)), B.letter_readings(spark, sf), overrides=OVERRIDES).select("word", "reading", "gloss")


# ------------------------------------------------------------ segmentation
SQL_SEGMENT = f"""toks AS (SELECT key, unit AS text_unit, {sql_words('text')} AS u FROM seg_rows),
  grams AS (SELECT key, text_unit, unnest(range(len(u))) AS idx, u FROM toks),
  runs AS (SELECT key, text_unit, idx, u[idx + 1] AS w FROM grams UNION ALL SELECT key, text_unit, idx, u[idx + 1] || ' ' || u[idx + 2] FROM grams WHERE idx + 2 <= len(u)),
  hits AS (SELECT key, idx, p.word, p.n, row_number() OVER (PARTITION BY key, idx ORDER BY length(p.word) DESC, p.seq) AS r FROM runs g
    JOIN phrases p ON p.word = g.w AND p.unit <= g.text_unit),
  best AS (SELECT key, idx, word, n FROM hits WHERE r = 1),
  walked AS (SELECT key, list_reduce(list({{'pos': idx, 'n': n, 'tags': [word]}} ORDER BY idx),
      lambda s, x: CASE WHEN x.pos = s.pos THEN {{'pos': x.pos + x.n, 'n': 0::BIGINT, 'tags': list_concat(s.tags, x.tags)}} ELSE s END,
      {{'pos': 0::BIGINT, 'n': 0::BIGINT, 'tags': []::VARCHAR[]}}) AS r FROM best GROUP BY key),
  segmented AS (SELECT t.key, CASE WHEN len(t.u) = 0 THEN []::VARCHAR[] WHEN w.r.pos = len(t.u) THEN w.r.tags END AS tags FROM toks t LEFT JOIN walked w ON w.key = t.key)"""
_SEG_ROWS = "seg_rows AS (SELECT doc_id || ':' || pos AS key, CAST(3 + doc_id % 13 AS INTEGER) AS unit, lower(text) AS text FROM doc_sentences)"


def seg_rows(spark, sf):
    return B.doc_sentences(spark, sf).select(
        F.concat_ws(":", "doc_id", "pos").alias("key"), (3 + F.col("doc_id") % 13).cast("int").alias("unit"), F.lower("text").alias("text")
    )


@query("segment_text", (sql(["doc_sentences", "phrases"], "SELECT key, array_to_string(tags, '|') AS tags FROM segmented", _SEG_ROWS, SQL_SEGMENT)))
def segment_text(spark, sf):
    return G.segment(seg_rows(spark, sf), B.phrase_lexicon(spark, sf), "key", C.LATIN).select("key", F.array_join("tags", "|").alias("tags"))


# Tags as given by the extractor: right, reversed, or none.
SQL_GIVEN = f"""given AS (SELECT key, unit, text, CASE length(key) % 3 WHEN 0 THEN {sql_words('text')} WHEN 1 THEN list_reverse({sql_words('text')}) ELSE []::VARCHAR[] END AS tags FROM seg_rows),
  judged AS (SELECT g.*, len(tags) > 0 AND array_to_string(tags, ' ') = array_to_string({sql_words('text')}, ' ')
      AND g.key NOT IN (SELECT key FROM (SELECT key, unit, unnest(tags) AS t FROM given) x LEFT JOIN phrases p ON p.word = x.t WHERE p.word IS NULL OR p.unit > x.unit) AS valid FROM given g)"""


def given_tags(spark, sf):
    words = B.words_of(F.col("text"))
    case = F.length("key") % 3
    none = F.array().cast("array<string>")
    return seg_rows(spark, sf).withColumn("tags", F.when(case == 0, words).when(case == 1, F.reverse(words)).otherwise(none))


@query("validate_tags", sql(["doc_sentences", "phrases"], "SELECT key, valid FROM judged", _SEG_ROWS, SQL_GIVEN))
def validate_tags(spark, sf):
    return G.validate_tags(given_tags(spark, sf), B.phrase_lexicon(spark, sf), "key", C.LATIN).select("key", "valid")


SQL_SPOKEN = r"""chosen AS (SELECT j.key, CASE WHEN valid THEN j.tags ELSE s.tags END AS tags FROM judged j JOIN segmented s ON s.key = j.key
      WHERE valid OR len(s.tags) > 0),
  placed AS (SELECT key, unnest(tags) AS tag, unnest(range(len(tags))) AS idx FROM chosen),
  read AS (SELECT key, idx, tag, reading, regexp_extract(lead(reading) OVER (PARTITION BY key ORDER BY idx), '\d') AS nxt FROM placed JOIN phrases ON word = tag),
  spoken AS (SELECT key, string_agg(tag, '|' ORDER BY idx) AS tags, string_agg(CASE WHEN tag = 'the' THEN CASE WHEN nxt = '4' THEN 'bu2' ELSE 'bu4' END
        WHEN tag = 'and' THEN CASE WHEN nxt IN ('4', '5') THEN 'yi2' WHEN nxt IN ('1', '2', '3') THEN 'yi4' ELSE 'yi1' END
        ELSE reading END, ' ' ORDER BY idx) AS romanised FROM read GROUP BY key)"""


@query("tag_and_romanise", (sql(["doc_sentences", "phrases"], "SELECT * FROM spoken", _SEG_ROWS, SQL_SEGMENT, SQL_GIVEN, SQL_SPOKEN)))
def tag_and_romanise(spark, sf):
    rows = G.tag_and_romanise(given_tags(spark, sf), B.phrase_lexicon(spark, sf), "key", C.LATIN, negation="the", one="and")
    return rows.select("key", F.array_join("tags", "|").alias("tags"), "romanised")


# ------------------------------------------------------------ answers
# Given answers: exact, noisy, alike in sound (b and p share a base), and wrong.
SQL_ATTEMPTS = """attempts AS (SELECT p_partkey AS id, question_type, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'The ' || upper(p_name) || '!'
      WHEN 2 THEN translate(p_name, 'abegim', 'bafhjn') ELSE p_type END AS given, p_name AS expected
      FROM part JOIN (SELECT *, row_number() OVER (ORDER BY priority DESC) - 1 AS n FROM types) ON n = p_size % 10)"""
SQL_SOUND = f"""sounds AS (SELECT id, expected, given, gr, er, len(x) = len(y) AND len(list_filter(range(1, len(x) + 1), lambda i: left(x[i], length(x[i]) - 1) = left(y[i], length(y[i]) - 1)
      AND (right(y[i], 1) = '5' OR right(x[i], 1) = right(y[i], 1)))) = len(x) AND given <> '' AND expected <> '' AS same_sound
    FROM (SELECT id, given, expected, gr, er, {sql_sandhi('x0')} AS x, {sql_sandhi('y0')} AS y FROM
      (SELECT id, given, expected, g.reading AS gr, e.reading AS er, {sql_syllables('g.reading')} AS x0, {sql_syllables('e.reading')} AS y0
       FROM attempts a JOIN romanised g ON g.text = a.given JOIN romanised e ON e.text = a.expected)))"""
_WANTED = "wanted AS (SELECT given AS text FROM attempts UNION ALL SELECT expected FROM attempts)"


def attempts(spark, sf):
    name, case = F.col("p_name"), F.col("p_partkey") % 4
    given = (
        F.when(case == 0, name).when(case == 1, F.concat(F.lit("The "), F.upper(name), F.lit("!")))
        .when(case == 2, F.translate(name, "abegim", "bafhjn")).otherwise(F.col("p_type"))
    )
    kind = F.element_at(F.array(*[F.lit(t) for t in C.TYPE_NAMES]), F.col("p_size") % 10 + 1)
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), kind.alias("question_type"), given.alias("given"), name.alias("expected"))


@query("homophone_match", sql(["types", "letters"], "SELECT id, gr AS given_reading, er AS expected_reading, same_sound FROM sounds", SQL_ATTEMPTS, _WANTED, SQL_ROMAN, SQL_SOUND))
def homophone_match(spark, sf):
    rows = grading.homophone_match(attempts(spark, sf), B.letter_readings(spark, sf), overrides=OVERRIDES)
    return rows.select("id", "given_reading", "expected_reading", "same_sound")


def _cleaned(x: str) -> str:
    bare = "translate(lower(%s), '%s', '')" % (x, C.PUNCT_ANSWER.replace("'", "''"))
    for short, full in (("im", "i am"), ("youre", "you are"), ("hes", "he is"), ("shes", "she is"), ("(an|a|the)", "")):
        bare = f"regexp_replace({bare}, '\\b{short}\\b', '{full}', 'g')"
    return sql_strip(f"regexp_replace({bare}, '\\s+', ' ', 'g')")


@query(
    "grade_answers",
    sql(["types", "letters"], f"""SELECT a.id, CASE WHEN list_contains(list_transform(string_split(a.expected, ','), lambda v: {_cleaned('v')}), {_cleaned('a.given')}) THEN 'exact'
        WHEN a.question_type = 'listening sentence' AND same_sound THEN 'homophone' ELSE 'wrong' END AS verdict FROM attempts a JOIN sounds s ON s.id = a.id""",
        SQL_ATTEMPTS, _WANTED, SQL_ROMAN, SQL_SOUND),
)
def grade_answers(spark, sf):
    return grading.grade_answers(attempts(spark, sf), B.letter_readings(spark, sf), overrides=OVERRIDES).select("id", "verdict")


@query(
    "grade_speech_text",
    sql(["types", "letters"], """SELECT s.id, given AS transcript, length(replace(given, ' ', '')) > 3 * length(replace(expected, ' ', '')) OR given = '' AS hallucination,
          CASE WHEN length(replace(given, ' ', '')) > 3 * length(replace(expected, ' ', '')) OR given = '' THEN '' ELSE gr END AS transcript_reading, er AS expected_reading,
          same_sound AND NOT (length(replace(given, ' ', '')) > 3 * length(replace(expected, ' ', '')) OR given = '') AS is_correct FROM sounds s""",
        SQL_ATTEMPTS.replace("ELSE p_type END", "ELSE CASE WHEN p_size % 2 = 0 THEN '' ELSE repeat(p_name, 4) END END"), _WANTED, SQL_ROMAN, SQL_SOUND),
)
def grade_speech_text(spark, sf):
    p = B.table(spark, sf, "part")
    odd = F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.repeat("p_name", F.lit(4)))
    rows = attempts(spark, sf).join(p.select(F.col("p_partkey").alias("id"), odd.alias("odd")), "id")
    heard = F.when(F.col("id") % 4 == 3, F.col("odd")).otherwise(F.col("given"))
    graded = grading.grade_speech(rows.select("id", heard.alias("transcript"), "expected"), B.letter_readings(spark, sf), C.LATIN, overrides=OVERRIDES)
    return graded.select("id", "transcript", "hallucination", "transcript_reading", "expected_reading", "is_correct")


@query(
    "audio_worklist",
    sql([], """SELECT DISTINCT text, slow, md5(text || CASE WHEN slow THEN '_slow' ELSE '' END) AS key FROM
        (SELECT p_name AS text, p_size % 2 = 0 AS slow FROM part UNION ALL SELECT p_type, p_size % 3 = 0 FROM part) r
        WHERE NOT EXISTS (SELECT 1 FROM part d WHERE d.p_name = r.text AND r.slow AND d.p_brand = 'Brand#1')"""),
)
def audio_worklist(spark, sf):
    p = B.table(spark, sf, "part")
    asked = p.select(F.col("p_name").alias("text"), (F.col("p_size") % 2 == 0).alias("slow")).unionByName(
        p.select(F.col("p_type").alias("text"), (F.col("p_size") % 3 == 0).alias("slow"))
    )
    done = p.where("p_brand = 'Brand#1'").select(content_key(F.col("p_name"), F.lit(True)).alias("key")).distinct()
    return grading.audio_worklist(asked, done)


# ------------------------------------------------------------ units and types
@query(
    "candidate_types",
    sql([*LEARNER, "types"], "SELECT user_id, tag, question_type, tier, priority FROM strength JOIN types ON unlock <= correct_count"),
)
def candidate_types(spark, sf):
    rows = unnest(B.strength(spark, sf), sessions.unlocked_types(F.col("correct_count")), ["user_id", "tag"], "t")
    return rows.select("user_id", "tag", "t.question_type", "t.tier", "t.priority")


@query("units_all", sql(["entries", "bank"], "SELECT unit FROM entries UNION SELECT unit FROM bank UNION SELECT p_size FROM part"))
def units_all(spark, sf):
    e, b, p = B.entries(spark, sf), B.bank(spark, sf), B.table(spark, sf, "part")
    return e.select("unit").unionByName(b.select("unit")).unionByName(p.select(F.col("p_size").alias("unit"))).distinct()


