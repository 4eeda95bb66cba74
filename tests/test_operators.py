"""Content operators on literal course text, and skewed keys against brute force."""

import random
from hashlib import md5

from pyspark.sql import functions as F

from lexloom import config as C
from lexloom.functions.scalars import round_tenth
from lexloom.operators import cloze, containment, dedup, grading, progress, sections, segmentation, sessions, strength
from lexloom.operators import questions as Q
from lexloom.operators.ordering import next_within, number_within
from lexloom.plans import lexicon, question_bank, sentence_bank
from lexloom.sources import json_docs, store, text_files

LEX = [("我", "wo3", 3, 0), ("是", "shi4", 3, 1), ("不", "bu4", 3, 2), ("中国", "Zhong1guo2", 3, 3), ("中国人", "Zhong1guo2ren2", 4, 4),
       ("人", "ren2", 3, 5), ("学生", "xue2sheng5", 3, 6), ("...", "x", 3, 7), ("生", "sheng1", 9, 8)]


def lex(spark):
    return spark.createDataFrame(LEX, "word string, reading string, unit int, seq long")


def test_segmentation(spark):
    rows = spark.createDataFrame(
        [("a", 3, "我是中国人。"), ("b", 4, "我是中国人。"), ("c", 3, "我是老师"), ("d", 3, "!?"), ("e", 4, "中国学")], "key string, unit int, text string"
    )
    got = {r.key: r.tags for r in segmentation.segment(rows, lex(spark), "key").collect()}
    assert got == {"a": ["我", "是", "中国", "人"], "b": ["我", "是", "中国人"], "c": None, "d": [], "e": None}


def test_tag_and_romanise(spark):
    rows = spark.createDataFrame(
        [("a", 4, "我不是中国人。", ["我", "不", "是", "中国", "人"]), ("b", 4, "我不是。", ["我", "是"]), ("c", 3, "老师", ["老师"]), ("d", 3, "...", [])],
        "key string, unit int, text string, tags array<string>",
    )
    got = {r.key: (r.tags, r.romanised) for r in segmentation.tag_and_romanise(rows, lex(spark), "key").collect()}
    assert got == {
        "a": (["我", "不", "是", "中国", "人"], "wo3 bu2 shi4 Zhong1guo2 ren2"),
        "b": (["我", "不", "是"], "wo3 bu2 shi4"),
    }


def test_gate(spark):
    rows = spark.createDataFrame([(1, 3, "我是生？"), (2, 9, "我是生？"), (3, 3, "abc"), (4, 2, "我")], "k int, unit int, text string")
    got = {r.k: r.known for r in segmentation.flag_vocab_gate(rows, lex(spark)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_verbatim(spark):
    docs = spark.createDataFrame([("t", 3, "A：你 是 老师吗？\n我不\n是")], "source string, unit int, doc_text string")
    rows = spark.createDataFrame([("t", 3, "你是老师吗?"), ("t", 3, "我不是"), ("t", 4, "你"), ("t", 3, "我不\n是")], "source string, unit int, text string")
    got = [r.verbatim for r in containment.flag_verbatim(rows, docs, ["source", "unit"]).orderBy("unit", "text").collect()]
    assert sorted(got) == [False, False, False, True]
    items = spark.createDataFrame([("t", 3, "你___老师___"), ("t", 3, "我___是"), ("t", 3, "___"), ("t", 3, "老师___你")], "source string, unit int, question string")
    flags = {r.question: r.verbatim for r in containment.flag_verbatim_cloze(items, docs, ["source", "unit"]).collect()}
    assert flags == {"你___老师___": True, "我___是": False, "___": True, "老师___你": False}


def test_templates_and_sections(spark):
    text = "他是___人。\n练习 Exercises\n1 他是___人。\n（2） 她/他是老师\nwo3 ___\n他是乔丹(Michael)，___人\n他是___人。\n拼音 练习\n你……了"
    docs = spark.createDataFrame([(1, text), (2, "你……了\nabc")], "doc int, text string")
    got = [(r.doc, r.seq, r.template) for r in sections.extract_templates(docs).orderBy("doc", "seq").collect()]
    assert got == [(1, 0, "他是___人。"), (1, 1, "她/他是老师"), (2, 0, "你……了")]
    book = spark.createDataFrame([(1, "intro\n## 听力 Listening\na\n## Reading\nb\n## 汉字 Characters\nc")], "doc int, text string")
    assert sections.drop_sections(book).first()["kept"] == ["intro", "## Reading", "b"]


def test_index_table(spark):
    text = ("## 词语表 Vocabulary\n| Word | Pinyin | POS | English | Unit |\n|---|---|---|---|---|\n| A | | | | |\n| 爱 | ài | v. | to love | 8 |\n"
            "| 个 | gè | m. | general | 5 (notes) |\n\n## 专有名词 Proper Nouns\n| Word | Pinyin | English | Unit |\n|---|---|---|---|\n| 中国 | Zhōngguó | China | 3 |")
    docs = spark.createDataFrame([(1, text)], "doc int, text string")
    got = [tuple(r)[2:] for r in sections.table_rows(docs).orderBy("line_no").collect()]
    assert got == [("爱", "ài", "v.", "verb", "to love", 8, "vocab"), ("个", "gè", "m.", "measure_word", "general", 5, "grammar"),
                   ("中国", "Zhōngguó", "", None, "China", 3, "proper_noun")]


def test_cloze(spark):
    docs = spark.createDataFrame([(1, "我____人。你（　）吗？\n好。")], "doc int, text string")
    assert [r.blanked for r in sections.find_cloze(docs).orderBy("seq").collect()] == ["我___人。", "你___吗？"]
    sentences = spark.createDataFrame([("a", 3, "我不是不人", "I")], "key string, unit int, text string, gloss string")
    markers = spark.createDataFrame([(3, "不"), (3, "了"), (4, "是")], "unit int, word string")
    assert [tuple(r) for r in cloze.generate(sentences, markers, "key").collect()] == [("a", 3, "我___是不人(I)", "不")]


def test_build_lexicon(spark):
    raw = spark.createDataFrame(
        [(0, " 吗 ", "ma", "part.", "q", "5", "vocab"), (1, "吗", "ma", "part.", "q2", " 3 ", "vocab"), (2, "中国", "Zhōngguó", "", "China", "3", "proper_noun"),
         (3, "[unclear]", "x", "n.", "", "3", "vocab"), (4, "好", "hǎo", None, None, "x", "vocab"), (5, None, "a", "n.", "", "3", "vocab"), (6, "中国", "z", "n.", "", "3", "vocab")],
        "seq long, word string, reading string, pos string, gloss string, unit string, section string",
    )
    got = {r.word: (r.reading, r.gloss, r.unit, r.type, r.first_seq) for r in lexicon.build(raw).collect()}
    assert got == {"吗": ("ma5", "q2", 3, "grammar", 0), "中国": ("Zhong1guo2", "China", 3, "proper_noun", 2)}


def bank_inputs(spark):
    words = spark.createDataFrame(
        [("老师", "lao3shi1", "teacher", 3, "vocab", 0), ("中国", "Zhong1guo2", "China", 3, "proper_noun", 1), ("了", "le5", "particle", 3, "grammar", 2)],
        "word string, reading string, gloss string, unit int, type string, seq long",
    )
    sentences = spark.createDataFrame([(3, 0, "我喜欢老师。", "wo3", "I"), (3, 1, "我喜欢老师。", "x", "I"), (3, 2, "走了！", "z", "go")], "unit int, seq long, text string, reading string, gloss string")
    blanks = spark.createDataFrame([(3, 0, "我___老师。", "喜欢"), (3, 1, "走___ (go)", "了")], "unit int, seq long, question string, answer string")
    return words, sentences, blanks, spark.createDataFrame([("走了",)], "line string")


def test_question_bank(spark):
    rows = question_bank.build(*bank_inputs(spark)).collect()
    by_id = {r.id: r for r in rows}
    assert len(rows) == 5 + 3 + 3 + 4 + 1
    assert {r.question_type for r in rows} <= set(C.TYPE_NAMES)
    assert by_id["u3_listening_vocab_1"].question == "老师" and by_id["u3_listening_vocab_2"].question == "了"
    assert by_id["u3_fill_in_the_blank_1"].tags == ["老师", "fill_in_the_blank", "unit_3"]
    assert by_id["u3_translate_english_sentence_to_chinese_1"].answer == "我喜欢老师。"


def test_sentence_bank(spark):
    docs = spark.createDataFrame([("t", 4, "我是学生。\n我不是中国人。\n老师好。")], "source string, unit int, doc_text string")
    rows = spark.createDataFrame(
        [("1", "t", 4, 0, "我是学生。"), ("2", "t", 4, 1, "我是人。"), ("3", "t", 4, 2, "老师好。"), ("4", "t", 4, 3, "我不是中国人。")],
        "key string, source string, unit int, seq int, text string",
    )
    flagged = sentence_bank.flag_stages(rows, docs, lex(spark), ["source", "unit"], "key")
    assert {r.key: (r.verbatim, r.known, r.tagged) for r in flagged.collect()} == {
        "1": (True, True, True), "2": (False, True, False), "3": (True, False, False), "4": (True, True, True)}
    built = sentence_bank.build(flagged.withColumn("source_rank", dedup.source_rank(F.col("source"))))
    assert {r.content: r.romanised for r in built.collect()} == {"我是学生": "wo3 shi4 xue2sheng5", "我不是中国人": "wo3 bu2 shi4 Zhong1guo2ren2"}


def test_grading(spark):
    readings = spark.createDataFrame([("他", "ta1"), ("她", "ta1"), ("是", "shi4"), ("好", "hao3")], "char string, reading string")
    tries = spark.createDataFrame(
        [(1, "listening sentence", "他是。", "她是"), (2, "speaking sentence", "他是", "她是"), (3, "listening sentence", "", "她"), (4, "listening sentence", "她是", "她，是, 他好")],
        "id int, question_type string, given string, expected string",
    )
    assert {r.id: r.verdict for r in grading.grade_answers(tries, readings).collect()} == {1: "homophone", 2: "wrong", 3: "wrong", 4: "exact"}
    words = spark.createDataFrame([("谁",), ("他 好",), ("x",)], "text string")
    assert {r.text: r.reading for r in grading.readings_of(words, readings).collect()} == {"谁": "shei2", "他 好": "ta1hao3", "x": "x"}


def test_numbering_and_next_value_on_a_hot_key(spark):
    rng = random.Random(5)
    values = rng.sample(range(10_000), 1500)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", v) for v in values]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {(r.k, r.v): r.n for r in number_within(df, ["k"], ["v"], F.floor(F.col("v") / 64)).collect()}
    nexts = {(r.k, r.v): r.nx for r in next_within(df, ["k"], "v", 64, "nx").collect()}
    for key in {k for k, _ in rows}:
        ordered = sorted(v for k, v in rows if k == key)
        assert [got[key, v] for v in ordered] == list(range(1, len(ordered) + 1))
        assert [nexts[key, v] for v in ordered] == ordered[1:] + [None]


def test_learning_session_with_shared_questions(spark):
    """A question with two tags is used once: the same greedy walk in plain Python."""
    users = spark.createDataFrame([(1, 3, [])], "user_id long, current_unit int, graduated_units array<int>")
    types = ["listening vocab", "speaking vocab"]
    rows = [(i, f"q{i}", tag, 3, types[i % 2]) for i in range(6) for tag in (("a", "b") if i < 4 else ("c",))]
    bank = spark.createDataFrame(rows, "seq long, id string, tag string, unit int, question_type string")
    counts = {"a": 0, "b": 0, "c": 1}
    strength = spark.createDataFrame([(1, "c", 1)], "user_id long, tag string, correct_count int")
    got = sessions.learning_session(users, bank.select("unit", "tag").distinct(), strength, sessions.question_pool(bank, "s"), "s").collect()
    digest = lambda *x: md5(":".join(map(str, ("s", *x))).encode()).hexdigest()
    used, want = [], []
    order = sorted(((counts[t], 0 if q == "speaking vocab" else 1, t, q) for t in counts for q in types))
    for _, _, tag, qtype in order:
        all_ids = sorted((r[1] for r in rows if r[2] == tag and r[4] == qtype), key=lambda i: (digest(i), i))
        start = int(digest(1, tag, qtype)[:8], 16) % len(all_ids)
        free = [i for i in all_ids[start:] + all_ids[:start] if i not in used]
        if free and sum(t == tag for t, _ in want) < 2:
            used.append(free[0])
            want.append((tag, free[0]))
    assert sorted((r.tag, r.id) for r in got) == sorted(want)
    assert sorted(r.pos for r in got) == list(range(len(want)))


def test_learning_session_looks_up_what_it_may_ask(spark, monkeypatch):
    """Types with many questions, with few and with shared ones: the greedy walk in plain Python, and not ten places for each of ten."""
    users = spark.createDataFrame([(u, 3, []) for u in range(1, 6)], "user_id long, current_unit int, graduated_units array<int>")
    types, rows = ["listening vocab", "speaking vocab"], []
    for t, tag in enumerate("abcdefgh"):
        for q, qtype in enumerate(types):
            ids = [f"{tag}{q}{i}" for i in range(30)] if t > 2 else ["s0", "s1"] if t else ["s0"]
            rows += [(0, i, tag, 3, qtype) for i in ids]
    bank = spark.createDataFrame(rows, "seq long, id string, tag string, unit int, question_type string")
    none = spark.createDataFrame([], "user_id long, tag string, correct_count int")
    walk, looked_up = sessions._greedy, []

    def counted(drawn, *how):
        places = F.size("ids") if "ids" in drawn.columns else F.lit(1)
        looked_up.extend(r.n for r in drawn.groupBy("user_id").agg(F.sum(places).alias("n")).collect())
        return walk(drawn, *how)

    monkeypatch.setattr(sessions, "_greedy", counted)
    got = sessions.learning_session(users, bank.select("unit", "tag").distinct(), none, sessions.question_pool(bank, "s"), "s").collect()
    digest = lambda *x: md5(":".join(map(str, ("s", *x))).encode()).hexdigest()
    for user in range(1, 6):
        used, want = [], []
        for _, tag, qtype in sorted((0 if q == "speaking vocab" else 1, t, q) for t in "abcdefgh" for q in types):
            ids = sorted((r[1] for r in rows if r[2] == tag and r[4] == qtype), key=lambda i: (digest(i), i))
            start = int(digest(user, tag, qtype)[:8], 16) % len(ids)
            free = [i for i in ids[start:] + ids[:start] if i not in used]
            if free and len(want) < 10 and sum(t == tag for t, _ in want) < 2:
                used.append(free[0])
                want.append((tag, free[0]))
        assert sorted((r.tag, r.id) for r in got if r.user_id == user) == sorted(want)
    assert max(looked_up) <= 100


def test_every_question_can_be_asked(spark):
    users = spark.range(2000).select(F.col("id").alias("user_id"), F.lit(3).alias("current_unit"), F.array(F.lit(2)).alias("graduated_units"))
    rows = [(i, f"q{i}", "a", 3, "speaking vocab") for i in range(100)] + [(i, f"r{i}", "b", 3, "speaking vocab") for i in range(19)]
    bank = spark.createDataFrame(rows, "seq long, id string, tag string, unit int, question_type string")
    none = spark.createDataFrame([], "user_id long, tag string, correct_count int")
    pool = sessions.question_pool(bank, "s")
    got = sessions.learning_session(users, bank.select("unit", "tag").distinct(), none, pool, "s")
    assert got.groupBy("user_id").count().where("count <> 2").isEmpty()
    assert {r.id for r in got.select("id").distinct().collect()} == {r[1] for r in rows}
    takers = users.select("user_id", F.lit(3).alias("unit"))
    tests = sessions.unit_tests(takers, sessions.unit_pool(bank, "s"), "s")
    each = tests.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
    assert [tuple(r) for r in each.select("n", "d").distinct().collect()] == [(20, 20)]
    assert tests.select("id").distinct().count() == 119


def test_review_falls_back_to_all_tags(spark):
    """Tags without questions come first; the session is still filled from the ones behind them."""
    users = spark.createDataFrame([(1, 5, [3, 4])], "user_id long, current_unit int, graduated_units array<int>")
    tag_units = spark.createDataFrame([(f"t{i:03d}", 3 + i % 2) for i in range(60)], "tag string, unit int")
    rows = [(i, f"q{i}", f"t{i:03d}", u, "speaking vocab") for i in range(40, 60) for u in (3, 4, 9)]
    bank = spark.createDataFrame(rows, "seq long, id string, tag string, unit int, question_type string")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    strength = spark.createDataFrame([(1, "t041", 5, 200.0)], "user_id long, tag string, correct_count int, stability double")
    strength = strength.withColumn("last_practice", now)
    got = sessions.review_session(strength, users, tag_units, sessions.question_pool(bank, "s"), sessions.question_types(spark), now, "s").collect()
    assert sorted(r.tag for r in got) == [f"t{i:03d}" for i in (40, *range(42, 51))]
    assert {r.unit for r in got} <= {3, 4}


def test_weak_count_holds_tags_never_answered(spark):
    users = spark.createDataFrame([(1, 5, [3, 4]), (2, 3, [])], "user_id long, current_unit int, graduated_units array<int>")
    tag_units = spark.createDataFrame([("a", 3), ("b", 3), ("c", 4), ("d", 5)], "tag string, unit int")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    answered = spark.createDataFrame([(1, "a", 4, 100.0), (1, "d", 4, 100.0)], "user_id long, tag string, correct_count int, stability double").withColumn("last_practice", now)
    assert {r.user_id: r.n_weak for r in strength.count_weak(answered, users, tag_units, now).collect()} == {1: 2, 2: 0}
    never = strength.default_scores(answered, users, tag_units, F.lit(99)).collect()
    assert sorted((r.user_id, r.tag) for r in never) == [(1, "b"), (1, "c")]


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (None, 5)], "k long, v long")
    got = {(r.k, r.v): r.n for r in number_within(df, ["k"], ["v"], F.floor(F.col("v") / 2)).collect()}
    nexts = {(r.k, r.v): r.nx for r in next_within(df, ["k"], "v", 2, "nx").collect()}
    assert got == {(None, 1): 1, (None, 5): 2, (1, 2): 1}
    assert nexts == {(None, 1): 5, (None, 5): None, (1, 2): None}


def test_averages_are_rounded_as_python_does(spark):
    pairs = [(s, t) for t in (1, 3, 4, 7, 8, 20, 40, 60) for s in range(0, 130)]
    df = spark.createDataFrame(pairs, "s long, t long").select("s", "t", round_tenth(F.col("s") / F.col("t")).alias("r"))
    assert {(r.s, r.t): r.r for r in df.collect()} == {(s, t): round(s / t, 1) for s, t in pairs}


def test_sources(spark, tmp_path):
    (tmp_path / "bank.json").write_text('{"3": [{"id": "a", "tags": ["你"]}, {"id": "b"}], "12": []}', encoding="utf-8")
    rows = json_docs.unit_map(json_docs.read_documents(spark, str(tmp_path / "bank.json"))).collect()
    assert [(r.unit, r.seq, r.id, r.tags) for r in rows] == [(3, 0, "a", ["你"]), (3, 1, "b", None)]
    (tmp_path / "textbook_unit3.md").write_text("你好\n\n　再见 ", encoding="utf-8")
    text = text_files.read_course_text(spark, str(tmp_path / "textbook_unit3.md"))
    assert [tuple(r) for r in text_files.lines(text).collect()] == [("textbook", 3, 0, "你好"), ("textbook", 3, 2, "再见")]
    out = str(tmp_path / "units")
    store.write_units(spark.createDataFrame([(3, "一"), (4, "二")], "unit int, word string"), out)
    store.write_units(spark.createDataFrame([(4, "三")], "unit int, word string"), out)
    assert sorted((r.unit, r.word) for r in spark.read.schema("word string, unit int").json(out).collect()) == [(3, "一"), (4, "三")]


def test_page_ranges(spark):
    starts = spark.createDataFrame([("t", 3, 34), ("t", 4, 42), ("w", 4, 15)], "source string, unit int, start_page int")
    ranges = text_files.page_ranges(starts, F.lit(139))
    assert {(r.source, r.unit): r.end_page for r in ranges.collect()} == {("t", 3): 41, ("t", 4): 139, ("w", 4): 139}
    pages = spark.createDataFrame([("t", 33), ("t", 41), ("t", 139), ("w", 15)], "source string, page int")
    got = sorted((r.source, r.page, r.unit) for r in text_files.pages_to_units(pages, ranges).collect())
    assert got == [("t", 41, 3), ("t", 139, 4), ("w", 15, 4)]


def test_replace_cycle(spark):
    rows = spark.createDataFrame([(3, i, "ab", "listening sentence") for i in range(4)] + [(3, 9, "ab", "listening vocab")], "unit int, seq long, question string, question_type string")
    splits = spark.createDataFrame([("ab", ["a", "b", "c"])], "combined string, parts array<string>")
    got = Q.replace_cycle(rows, splits).orderBy("seq").collect()
    assert [r.question for r in got] == ["a", "b", "c", "a", "ab"]


def test_readiness_and_moves(spark):
    users = spark.createDataFrame([(1, 3, []), (2, 9, [3])], "user_id long, current_unit int, graduated_units array<int>")
    unit_tags = spark.createDataFrame([(3, "a"), (3, "b")], "unit int, tag string")
    strength = spark.createDataFrame([(1, "a", 5)], "user_id long, tag string, correct_count int")
    got = {r.user_id: (r.unit_tags, r.ready) for r in progress.unit_ready(users, unit_tags, strength).collect()}
    assert got == {1: (2, False), 2: (0, True)}
    report = progress.unit_progress(users, unit_tags, strength).where("user_id = 1").first()
    assert (report.total_tags, report.graduated_tags, report.progress_pct, report.avg_correct_count) == (2, 1, 50, 2.5)
    moved = progress.graduate(users, users.where("user_id = 2"))
    assert {r.user_id: (r.current_unit, r.graduated_units) for r in moved.collect()} == {1: (3, ""), 2: (10, "3,9")}
    changed = progress.set_unit(users, spark.createDataFrame([(1, 7)], "user_id long, new_unit int"))
    assert {r.user_id: r.current_unit for r in changed.collect()} == {1: 7, 2: 9}


def test_gloss_is_paired_by_block(spark):
    lines = ["a", "b", "A", "B", "c", "d", "e", "C", "f", "F"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc int, at int, text string")
    got = sections.pair_gloss(df, "doc", "at", F.upper("text") == F.col("text"))
    assert sorted((r.source_line, r.gloss_line) for r in got.collect()) == [("a", "A"), ("b", "B"), ("c", "C"), ("f", "F")]


def test_long_texts_are_walked_in_one_pass(spark):
    words = spark.createDataFrame([("a b", "x", 3, 0), ("a", "y", 3, 1), ("b", "z", 3, 2)], "word string, reading string, unit int, seq long")
    texts = spark.createDataFrame([("k", 3, "a b a " * 2000), ("d", 3, "a b q")], "key string, unit int, text string")
    got = {r.key: r.tags for r in segmentation.segment(texts, words, "key", C.LATIN).collect()}
    assert got == {"k": ["a b", "a"] * 2000, "d": None}
