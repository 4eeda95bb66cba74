"""The whole content build on literal course text: from index rows to the nested documents of a unit."""

from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.plans import content, lexicon, sentence_bank

INDEX = [  # word, reading, pos, gloss, unit, section; the second 中国 and the unclear row must go
    ("我", "wǒ", "pron.", "I", "3", "vocab"), ("是", "shì", "v.", "to be", "3", "vocab"), ("中国", "zhōngguó", "n.", "China", "3", "vocab"),
    ("人", "rén", "n.", "person", "3", "vocab"), ("中国", "zhōngguó", "", "China (name)", "4", "proper_noun"), ("吗", "ma", "part.", "?", "3", "vocab"),
    ("你", "nǐ", "pron.", "you", "3", "vocab"), ("[unclear]", "x", "n.", "", "3", "vocab"), ("好", "hǎo", "adj.", "good", "9", "vocab"),
]
LINES = ["我是中国人。", "你是中国人吗？", "你好。", "你___中国人___？"]


def build(spark):
    rows = [(*r, i) for i, r in enumerate(INDEX)]
    raw = spark.createDataFrame(rows, "word string, reading string, pos string, gloss string, unit string, section string, seq long")
    words = lexicon.build(raw)
    docs = spark.createDataFrame([(1, "\n".join(LINES))], "doc long, doc_text string")
    found = [
        (1, "a", 3, "textbook", "我是中国人。", "I am Chinese.", 0), (1, "b", 3, "workbook", "我是中国人", "the same", 1),
        (1, "c", 3, "textbook", "你是中国人吗？", "Are you Chinese?", 2), (1, "d", 3, "textbook", "你好。", "Hello.", 3),
        (1, "e", 3, "textbook", "我是人。", "not in the text", 4),
    ]
    sentences = spark.createDataFrame(found, "doc long, key string, unit int, source string, text string, gloss string, seq long")
    sentences = sentences.withColumn("source_rank", F.when(F.col("source") == "textbook", 0).otherwise(1))
    exercises = [
        (1, "x", 3, "textbook", "你___中国人___？", ["是", "吗"], "你是中国人吗？", "are you?", 9), (1, "y", 3, "workbook", "你___好？", ["很"], "你很好？", "", 10),
        (1, "z", 3, "workbook", "___好。", ["你"], "你好。", "", 11),
    ]
    solved = spark.createDataFrame(
        exercises, "doc long, key string, unit int, source string, blanked string, answers array<string>, full string, gloss string, seq long"
    ).withColumn("source_rank", F.lit(0))
    flagged = sentence_bank.flag_stages(sentences, docs, words, ["doc"], "key")
    return words, flagged, content.flag_cloze(solved, docs, words, ["doc"])


def test_bank_and_documents(spark):
    words, sentences, cloze = build(spark)
    blocklist = spark.createDataFrame([("没有",)], "line string")
    bank = content.build(words, sentences, cloze, blocklist)
    got = bank.collect()
    assert all(r.question_type in C.TYPE_NAMES and r.unit in (3, 9) and isinstance(r.tags, list) for r in got)
    assert len({r.id for r in got}) == len(got)
    heard = {(r.question, r.answer) for r in got if r.question_type == "speaking sentence"}
    assert heard == {("我是中国人。", "wo3 shi4 zhong1guo2 ren2"), ("你是中国人吗？", "ni3 shi4 zhong1guo2 ren2 ma5")}
    blanks = [(r.id, r.question, r.answer) for r in got if r.question_type == "fill in the blank"]
    assert sorted(blanks) == [
        ("u3_fill_in_the_blank_1", "你___中国人吗？ (are you?)", "是"), ("u3_fill_in_the_blank_2", "你是中国人___？ (are you?)", "吗"),
    ]
    (tags,) = [r.tags for r in got if r.id == "u3_fill_in_the_blank_1"]
    assert tags == ["中国", "人", "你", "吗", "是", "fill_in_the_blank", "unit_3"]
    assert {r.unit for r in got if r.question == "中国"} == {3}
    docs = content.documents(bank, block_size=10).collect()
    assert sorted((d.unit, d.block) for d in docs if d.unit == 9) == [(9, 0)]
    ids = [r.id for d in sorted(docs, key=lambda d: d.block) if d.unit == 3 for r in d.records]
    assert sorted(ids) == sorted(r.id for r in got if r.unit == 3)


def test_counts(spark):
    _, sentences, cloze = build(spark)
    got = {(r.source, r.unit): r for r in content.counts(sentences, cloze).collect()}
    book, work, merged = got["textbook", 3], got["workbook", 3], got[None, 3]
    assert (book.extracted, book.dropped_verbatim, book.dropped_known, book.dropped_tagged, book.final) == (4, 1, 1, 0, 2)
    assert (book.cloze_solved, book.cloze_dropped_verbatim, book.cloze_dropped_known, book.cloze_final) == (1, 0, 0, 2)
    assert (work.final, work.cloze_solved, work.cloze_dropped_verbatim, work.cloze_dropped_known, work.cloze_final) == (1, 2, 1, 1, None)
    assert (merged.final, merged.cloze_final) == (2, 2)
