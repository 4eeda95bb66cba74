"""The roles the test tables play, as DataFrames and as SQL for the oracle.

The tables hold no Chinese, so alphabet letters stand in for the taught script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.rows import unnest
from lexloom.functions.text import sentences_of
from lexloom.operators import questions as Q
from lexloom.operators import strength as S
from lexloom.sources import store

SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def use_utc(spark: SparkSession) -> None:
    """Zone-less times of the tables are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; its zone-less times are read as UTC."""
    use_utc(spark)
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    times = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    df = df.withColumns(times) if times else df
    return store.deal_out(df) if name in ("documents", "conversations", "pages") else df


# ------------------------------------------------------------ learner log
def answers(spark: SparkSession, sf: str) -> DataFrame:
    """One answer per event; the tag is taken from the event's properties."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("seq"),
        "user_id",
        "ts",
        F.concat(F.lit("tag_"), k % 10).alias("tag"),
        (3 + (k % 10) % 5).alias("unit"),
        (F.col("value") >= 30).alias("is_correct"),
        k.alias("question_id"),
        F.to_date("ts").alias("day"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "events").select("user_id").distinct()
    current = (3 + F.col("user_id") % 5).cast("int")
    done = F.filter(F.sequence(F.lit(3), current), lambda u: u < current)
    return ids.select("user_id", current.alias("current_unit"), done.alias("graduated_units"))


def _type_at(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in C.TYPE_NAMES]), (i + 1).cast("int"))


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """A question bank over the tags of the learner log; some questions hold a second word, of the unit before."""
    p = table(spark, sf, "part")
    slot = F.col("p_partkey") % 10
    rows = p.select(
        F.col("p_partkey").alias("seq"),
        F.concat(F.lit("q"), F.col("p_partkey")).alias("id"),
        F.concat(F.lit("tag_"), slot).alias("word"),
        F.when((slot % 5 > 0) & (F.floor(F.col("p_partkey") / 10) % 2 == 0), F.concat(F.lit("tag_"), (slot + 4) % 10)).alias("second"),
        (3 + slot % 5).cast("int").alias("unit"),
        _type_at(F.col("p_size") % 10).alias("question_type"),
        F.col("p_name").alias("question"),
        F.col("p_type").alias("answer"),
    )
    tags = F.array("word", "second", F.replace("question_type", F.lit(" "), F.lit("_")), F.concat(F.lit("unit_"), "unit"))
    return rows.withColumn("tags", F.array_compact(tags)).drop("word", "second")


def tagged_bank(spark: SparkSession, sf: str) -> DataFrame:
    return Q.question_tags(bank(spark, sf))


def tag_units(spark: SparkSession, sf: str) -> DataFrame:
    return Q.first_unit_of_tag(tagged_bank(spark, sf))


def unit_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tagged_bank(spark, sf).select("unit", "tag").distinct()


def now(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "events").agg(F.max("ts")).scalar()


def no_strength(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "user_id long, tag string, correct_count int, stability double, last_practice timestamp"
    )


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """A fresh row for every user and tag."""
    return S.seed_missing(no_strength(spark), users(spark, sf), tag_units(spark, sf), now(spark, sf))


def strength(spark: SparkSession, sf: str) -> DataFrame:
    """The stored table: a row for every user and tag."""
    return S.apply_answers(answers(spark, sf), seeds(spark, sf))


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """Strength of the tags that were answered, which is all that most jobs need."""
    return S.answered_strength(answers(spark, sf), users(spark, sf), tag_units(spark, sf), now(spark, sf))


def stored_answered(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stored table, for jobs that read it more than once."""
    return store.materialise(answered(spark, sf), "strength")


# ------------------------------------------------------------ content
def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Lexicon entries: a word occurs many times, in several units and sections."""
    p = table(spark, sf, "part")
    rank = (F.col("p_partkey") % 3).cast("int")
    kinds = F.array(*[F.lit(kind) for _, kind in C.SECTIONS])
    return p.select(
        F.col("p_partkey").alias("seq"),
        F.col("p_name").alias("word"),
        F.col("p_brand").alias("reading"),
        F.col("p_type").alias("gloss"),
        (3 + F.col("p_size") % 13).alias("unit"),
        F.element_at(kinds, rank + 1).alias("type"),
        rank.alias("section_rank"),
    )


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return unnest(d, F.split("text", "\n"), ["doc_id", "lang", "source"], "line", at="line_no")


def doc_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return unnest(d, sentences_of(F.col("text")), ["doc_id", "lang", "source"], "text", at="pos")


def benchmark_sentences(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return unnest(b, sentences_of(F.col("text")), ["item_id"], "text", at="pos")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(C.LATIN.unit), F.lit(0))


def phrase_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words and two-word phrases of the benchmark texts, taught unit by unit."""
    b = table(spark, sf, "benchmark").select("item_id", words_of(F.col("text")).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(0))), lambda x, y: F.concat_ws(" ", x, F.when(y.isNotNull(), y)))
    singles = unnest(b, "w", ["item_id", F.lit(0).alias("n")], "word", at="at")
    doubles = unnest(b, pairs, ["item_id", F.lit(1).alias("n")], "word", at="at").where(F.col("word").contains(" "))
    seen = singles.unionByName(doubles)
    place = F.min(F.shiftleft(F.col("item_id").cast("long"), 32) + F.col("at") * 2 + F.col("n"))
    rows = seen.groupBy("word").agg(place.alias("seq"), F.min("item_id").alias("first"))
    letters = F.regexp_replace("word", "[^a-z]", "")
    return rows.select(
        "word",
        F.concat(letters, (F.length("word") % 5 + 1)).alias("reading"),
        (3 + F.col("first") % 13).cast("int").alias("unit"),
        "seq",
    )


def letter_readings(spark: SparkSession, sf: str) -> DataFrame:
    """A reading per letter; neighbours share a base, so there are homophones."""
    n = table(spark, sf, "nation")
    initials = "bpmfdtnlgkhjqxrzcsyw"
    base = F.substring(F.lit(initials), F.floor(F.col("n_nationkey") / 2).cast("int") + 1, F.lit(1))
    return n.select(
        F.char(F.lit(97) + F.col("n_nationkey")).alias("char"),
        F.concat(base, F.lit("a"), F.col("n_regionkey") + 1).alias("reading"),
    )


def spoken(words: Column) -> Column:
    """Stand-in readings of words: letters and a tone digit from the length."""
    return F.transform(
        words,
        lambda w: F.when(w.isin("the", "de", "der"), F.lit("bu4"))
        .when(w.isin("and", "la", "und"), F.lit("yi1"))
        .otherwise(F.concat(w, (F.length(w) % 5 + 1).cast("string"))),
    )


def gapped(text: Column) -> Column:
    """Course text with gaps: common words become blanks, ellipses and slashes."""
    out = F.replace(text, F.lit(" the "), F.lit(" ____ "))
    out = F.replace(out, F.lit(" de "), F.lit("……"))
    return F.replace(out, F.lit(" und "), F.lit("/"))


# ------------------------------------------------------------ SQL roles
def _values(rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_UNLOCK = {1: 0, 2: 2, 3: 4}
_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in C.TYPE_NAMES) + "]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def sql_spoken(words: str) -> str:
    return (
        f"list_transform({words}, lambda w: CASE WHEN w IN ('the','de','der') THEN 'bu4' "
        "WHEN w IN ('and','la','und') THEN 'yi1' ELSE w || (length(w) % 5 + 1) END)"
    )


def sql_gapped(x: str) -> str:
    return f"replace(replace(replace({x}, ' the ', ' ____ '), ' de ', '……'), ' und ', '/')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zà-ÿ]+')"


_SENTENCES = r"regexp_extract_all(text, '[^.!?。？！\n]+[.!?。？！]')"

ROLES = {
    "types": "types(question_type, tier, unlock, priority, speaking, sentence, source_type) AS (VALUES "
    + _values([(t[0], t[1], _UNLOCK[t[1]], 10 - i, t[2], t[3], t[4]) for i, t in enumerate(C.QUESTION_TYPES)])
    + ")",
    "answers": r"""answers AS (
        SELECT event_id AS seq, user_id, ts, 'tag_' || (k % 10) AS tag, 3 + (k % 10) % 5 AS unit,
               value >= 30 AS is_correct, k AS question_id, CAST(ts AS DATE) AS day
        FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events))""",
    "users": """users AS (
        SELECT DISTINCT user_id, CAST(3 + user_id % 5 AS INTEGER) AS current_unit,
               range(3, 3 + user_id % 5) AS graduated_units FROM events)""",
    "bank": f"""bank AS (
        SELECT p_partkey AS seq, 'q' || p_partkey AS id, 'tag_' || (p_partkey % 10) AS tag,
               CAST(3 + (p_partkey % 10) % 5 AS INTEGER) AS unit,
               ({_TYPE_LIST})[p_size % 10 + 1] AS question_type, p_name AS question, p_type AS answer
        FROM part)""",
    "tagged": """tagged AS (
        SELECT * FROM bank UNION ALL
        SELECT seq, id, 'tag_' || ((seq % 10 + 4) % 10), unit, question_type, question, answer
        FROM bank WHERE seq % 10 % 5 > 0 AND seq // 10 % 2 = 0)""",
    "tag_units": "tag_units AS (SELECT tag, min(unit) AS unit FROM tagged GROUP BY tag)",
    "unit_tags": "unit_tags AS (SELECT DISTINCT unit, tag FROM tagged)",
    "now": "clock AS (SELECT max(ts) AS now FROM events)",
    "folded": """folded AS (
        SELECT user_id, tag, count(*) FILTER (is_correct) AS gained, max(ts) AS last_ts,
               list_reduce(list(CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, seq),
                   lambda s, x: CASE WHEN x = 1 THEN least(s * 2, 365) ELSE greatest(s * 0.5, 1) END,
                   1.0::DOUBLE) AS stability
        FROM answers GROUP BY user_id, tag)""",
    "strength": """strength AS (
        SELECT u.user_id, t.tag, CAST(coalesce(f.gained, 0) AS INTEGER) AS correct_count,
               coalesce(f.stability, 1.0) AS stability,
               coalesce(f.last_ts, (SELECT now FROM clock) - INTERVAL 365 DAY) AS last_practice
        FROM users u CROSS JOIN tag_units t LEFT JOIN folded f ON f.user_id = u.user_id AND f.tag = t.tag)""",
    "entries": """entries AS (
        SELECT p_partkey AS seq, p_name AS word, p_brand AS reading, p_type AS gloss,
               3 + p_size % 13 AS unit, (['vocab','grammar','proper_noun'])[p_partkey % 3 + 1] AS type,
               CAST(p_partkey % 3 AS INTEGER) AS section_rank FROM part)""",
    "doc_lines": """doc_lines AS (
        SELECT doc_id, lang, source, unnest(l) AS line, CAST(unnest(range(len(l))) AS INTEGER) AS line_no
        FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))""",
    "doc_sentences": f"""doc_sentences AS (
        SELECT doc_id, lang, source, {sql_strip('s')} AS text, pos FROM (
          SELECT doc_id, lang, source, unnest(l) AS s, CAST(unnest(range(len(l))) AS INTEGER) AS pos
          FROM (SELECT *, {_SENTENCES} AS l FROM documents)))""",
    "benchmark_sentences": f"""benchmark_sentences AS (
        SELECT item_id, {sql_strip('s')} AS text, pos FROM (
          SELECT item_id, unnest(l) AS s, CAST(unnest(range(len(l))) AS INTEGER) AS pos
          FROM (SELECT *, {_SENTENCES} AS l FROM benchmark)))""",
    "phrases": f"""tokens AS (
        SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS idx FROM (SELECT item_id, {sql_words('text')} AS w FROM benchmark)),
      seen AS (
        SELECT item_id, word, idx * 2 AS place FROM tokens
        UNION ALL
        SELECT a.item_id, a.word || ' ' || b.word, a.idx * 2 + 1 FROM tokens a JOIN tokens b
          ON a.item_id = b.item_id AND b.idx = a.idx + 1),
      phrases AS (
        SELECT word, regexp_replace(word, '[^a-z]', '', 'g') || (length(word) % 5 + 1) AS reading,
               CAST(3 + min(item_id) % 13 AS INTEGER) AS unit, min(item_id * 4294967296 + place) AS seq,
               len(string_split(word, ' ')) AS n
        FROM seen GROUP BY word)""",
    "letters": """letters AS (
        SELECT chr(97 + n_nationkey) AS char,
               substr('bpmfdtnlgkhjqxrzcsyw', n_nationkey // 2 + 1, 1) || 'a' || (n_regionkey + 1) AS reading
        FROM nation)""",
}
LEARNER = ["answers", "users", "bank", "tagged", "tag_units", "unit_tags", "now", "folded", "strength"]


def sql(roles: list[str], body: str, *more: str) -> str:
    """A statement over roles and further named sub-queries."""
    parts = [ROLES[r] for r in roles] + list(more)
    return (("WITH " + ",\n".join(parts) + "\n") if parts else "") + body
