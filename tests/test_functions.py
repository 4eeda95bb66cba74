"""Literal rows for the rules that are easy to get wrong."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions import romanise as R
from lexloom.functions import scalars
from lexloom.functions import text as T


def value(spark, column, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column).first()[0]


def test_strip_takes_every_white_space(spark):
    assert value(spark, T.strip(F.col("x")), x="　 \ta b　\n") == "a b"


@pytest.mark.parametrize(
    "punct, want",
    [(C.PUNCT_BANK, "a…b"), (C.PUNCT_BANK_FIRST, "ab"), (C.PUNCT_BLOCKLIST, "a'b"), (C.PUNCT_ROMANISE, "a'b.!?,")],
)
def test_punctuation_classes_differ(spark, punct, want):
    got = value(spark, T.normalize_punct(F.col("x"), punct), x="a…'b.!?,。")
    assert got == want


def test_width(spark):
    assert value(spark, T.normalize_width(F.col("x")), x="你　好，\t（吗）？\n是 “a”") == '你好,(吗)?\n是"a"'


def test_script(spark):
    assert value(spark, T.script_only(F.col("x")), x="我a是，b人") == "我是人"
    assert value(spark, T.has_paren_hint(F.col("x")), x="他是乔布斯(Steve Jobs)，") is True


@pytest.mark.parametrize(
    "line, want",
    [("他是___人。", True), ("他/她是", True), ("abc ___", False), ("他…", False), ("他……了吗", True),
     ("他是乔丹（Michael）___人", False), ("同学／朋友", True)],
)
def test_template(spark, line, want):
    assert value(spark, T.is_template(F.col("x")), x=line) is want


@pytest.mark.parametrize("text, gloss, want", [("我是，", "", True), ("我是, ", None, True), ("我。", "I, ", True), ("我。", "I.", False), (None, None, False)])
def test_truncated(spark, text, gloss, want):
    assert value(spark, T.is_truncated(F.col("t").cast("string"), F.col("g").cast("string")), t=text, g=gloss) is want


def test_cloze_restore_cuts_at_the_last_bracket(spark):
    got = value(spark, T.cloze_restore(F.col("q"), F.col("a")), q="我(你)___人。 (I (am))", a="是")
    assert got == "我(你)是人。 (I"
    assert value(spark, T.cloze_restore(F.col("q"), F.col("a")), q=" 我___人 ", a="是") == "我是人"


def test_cloze_questions(spark):
    col = T.cloze_questions(F.col("b"), F.split("a", ","), F.col("g"))
    got = value(spark, col, b="我___是___人", a="不,好", g=" I ")
    assert [tuple(q) for q in got] == [("我___是好人 (I)", "不"), ("我不是___人 (I)", "好")]
    assert value(spark, col, b="我___人", a="不,好", g="") == []


def test_clean_answer(spark):
    got = value(spark, T.clean_answer(F.col("x")), x="The I'm  你 好, SHE'S an éa!")
    assert got == "i am 你好 she is é"
    assert value(spark, T.variant_match(F.col("g"), F.col("e")), g="a Teacher.", e="tutor, the teacher") is True


def test_json_block(spark):
    block = T.json_block(F.col("x"))
    assert value(spark, block, x='see ```json\n{"a": [1]}\n``` [2]') == '{"a": [1]}'
    assert value(spark, block, x='out {"a": [1, [2]]} then [3]') == "[1, [2]]"
    assert value(spark, block, x='[ open {"a": {"b": 1}} end }') == '{"a": {"b": 1}}'
    assert value(spark, block, x="  none ") == "none"


def test_hallucination(spark):
    flag = T.hallucination_flag(F.col("t"), F.col("e"))
    assert value(spark, flag, t="", e="我") is True
    assert value(spark, flag, t="我 我 我 我", e="我") is True
    assert value(spark, flag, t="我我我", e="我") is False
    assert value(spark, flag, t="我我我", e="") is False


@pytest.mark.parametrize(
    "reading, want",
    [("bu4", "bu4"), ("péngyou", "peng2you5"), ("Zhōngguó", "Zhong1guo2"), ("nǚ'ér", "nv3er2"), ("Xī’ān", "Xi1an1"),
     ("míngzi", "ming2zi5"), ("jīntiān", "jin1tian1"), ("fànguǎn", "fan4guan3"), ("lǜ sè", "lv4se4"), ("nǎr", "nar3"), ("", "")],
)
def test_diacritics(spark, reading, want):
    assert value(spark, R.diacritic_to_numeric(F.col("x")), x=reading) == want


def test_space_sandhi(spark):
    got = value(spark, R.sandhi_space_tokens(F.col("x")), x="wo3 bu4  shi4 bu4 hao3 bu4 shi4?")
    assert got == "wo3 bu2 shi4 bu4 hao3 bu4 shi4?"


def test_word_sandhi(spark):
    tags, reads = F.split("t", ","), F.split("r", ",")
    got = value(spark, R.sandhi_word_tags(tags, reads), t="不,是,一,个,一,本,一,不", r="bu4,shi4,yi1,ge4,yi1,ben3,yi1,bu4")
    assert got == ["bu2", "shi4", "yi2", "ge4", "yi4", "ben3", "yi2", "bu4"]


def test_syllables_and_tones(spark):
    def split(x):
        return [tuple(s) for s in value(spark, R.split_syllables(F.col("x")), x=x)]

    assert split("Zhong1guo2, ren") == [("zhong", "1"), ("guo", "2"), ("ren", "5")]

    def bent(x):
        return value(spark, R.render_syllables(R.sandhi_syllables(R.split_syllables(F.col("x")))), x=x)

    assert bent("ni3hao3hao3") == "ni2hao2hao3"
    assert bent("bu4shi4yi1ge4yi1ben3") == "bu2shi4yi2ge4yi4ben3"

    def match(g, e):
        row = spark.createDataFrame([(g, e)], "g string, e string")
        return R.with_tones_match(row, F.col("g"), F.col("e"), "m").first()["m"]

    assert match("ta1shi4", "ta1shi5") is True
    assert match("ta1shi5", "ta1shi4") is False
    assert match("ta1", "ta1ta1") is False
    assert match("ni3hao3", "ni2hao3") is True


def test_scalars(spark):
    assert value(spark, scalars.csv_to_units(F.col("x")), x="3,,5,3,") == [3, 5]
    assert value(spark, scalars.clamp_unit(F.col("x")), x=1) == 3
    assert value(spark, scalars.clamp_unit(F.col("x").cast("int")), x=None) is None
    assert value(spark, F.bround(F.lit(12.5))) == 12.0


def test_long_line_without_stops_is_linear(spark):
    text = F.concat(F.repeat(F.col("x"), F.lit(40_000)), F.lit("\nEnd."))
    assert value(spark, T.sentences_of(text), x="word ") == ["End."]


def test_syllables_are_those_of_the_written_out_pattern(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("iuaoevngrhzcsbx14 ü") for _ in range(draw.randint(0, 14))) for _ in range(3000)] + ["zhuang1ngnang", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", R.split_syllables(F.col("text")).alias("s"))
    plain = re.compile(f"((?:{C.SYLLABLE_INITIALS}|)(?:{C.SYLLABLE_FINALS}))([1-5]?)")
    for r in rows.collect():
        assert [tuple(x) for x in r.s] == [(base, tone or "5") for base, tone in plain.findall(r.text)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp") == 1 and "rlike" not in plan.lower()


def test_readings_of_different_lengths_are_not_spoken_out(spark):
    rows = [("ni3hao3", "ni3hao3"), ("ni2hao3", "ni3hao3"), ("ni3", "ni3hao3"), ("", ""), (None, None), (None, "ni3"), ("ni3hao3", "ni5hao5"), ("a1", "a2")]
    df = spark.createDataFrame(rows, "a string, b string")
    found = R.with_tones_match(df, F.col("a"), F.col("b"), "same")
    assert [r.same for r in found.collect()] == [True, True, False, True, None, None, True, False]
    assert "_as_long" in found._jdf.queryExecution().analyzed().toString()
