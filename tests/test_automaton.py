"""Words found by the automaton against plain search, and against the joins that larger lexicons use."""

import random
import re

import pyarrow as pa
import pytest

from lexloom import config as C
from lexloom.catalog import structure
from lexloom.operators import automaton as A
from lexloom.operators import containment, segmentation

NONE = A.Limit(words=0)


def corpus(n=300, seed=4):
    draw = random.Random(seed)
    words = sorted({"".join(draw.choice("我是中国人学生") for _ in range(draw.randint(1, 4))) for _ in range(60)})
    texts = ["".join(draw.choice("我是中国人学生，!x ") for _ in range(draw.randint(0, 25))) for _ in range(n)]
    return words, [*texts, "", None, "中" * 5000, "\U00020000我是", "!!"]


def test_finds_every_match():
    words, texts = corpus()
    machine = A.Automaton.of(words)
    for text in [t for t in texts if t][:200]:
        symbols = machine.numbers(list(text))
        at, length, word = machine.find(symbols, A.np.full(len(text), len(text)))
        got = sorted(zip(at.tolist(), length.tolist(), word.tolist()))
        assert got == sorted((i, len(w), k) for k, w in enumerate(words) for i in range(len(text)) if text.startswith(w, i))
    assert A.Automaton.of([]).find(A.np.array([-1, -1]), A.np.array([2, 2]))[0].size == 0


def test_contained_equals_search_and_join(spark):
    words, texts = corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, text string").repartition(3)
    lexicon = spark.createDataFrame([(w,) for w in [*words, "", *words]], "word string")
    want = {i: sorted(w for w in words if w in (t or "")) for i, t in enumerate(texts)}
    for limit in (A.LIMIT, NONE):
        got = {r.key: sorted(r.words) for r in containment.with_contained(rows, lexicon, "key", limit=limit).collect()}
        assert got == want
    pairs = {(r.key, r.word) for r in containment.contained_words(rows, lexicon, "key").collect()}
    assert pairs == {(i, w) for i, ws in want.items() for w in ws}


def greedy(text, entries, unit):
    units, out = re.findall("[一-鿿]", text), []
    while units:
        known = [e for e in entries if units[:len(e[0])] == list(e[0]) and unit is not None and e[1] <= unit]
        if not known:
            return None
        word = min(known, key=lambda e: (-len(e[0]), e[2]))
        out.append((word[0], word[3]))
        units = units[len(word[0]):]
    return out


@pytest.mark.parametrize("limit", [A.LIMIT, NONE])
def test_segmentation_equals_a_plain_walk(spark, limit):
    words, texts = corpus(120, seed=9)
    draw = random.Random(1)
    entries = [(w, draw.randint(3, 6), k, f"r{k}") for k, w in enumerate(words)] + [(c, 3, 500 + i, c) for i, c in enumerate("我是中国人学")]
    rows = [(i, t, draw.choice([2, 4, 6, None])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key int, text string, unit int")
    lexicon = spark.createDataFrame(entries, "word string, unit int, seq int, reading string")
    got = {r.key: None if r.tags is None else list(zip(r.tags, r.readings)) for r in segmentation.segment(df, lexicon, "key", limit=limit).collect()}
    want = {i: None if t is None else greedy(t, entries, u) for i, t, u in rows}
    assert got == want


def test_only_matches_leave_a_task(spark):
    words, texts = corpus(20)
    df = spark.createDataFrame([(i, t, 4) for i, t in enumerate(texts)], "key int, text string, unit int")
    lexicon = spark.createDataFrame([(w, 3, k) for k, w in enumerate(words)], "word string, unit int, seq int")
    for found in (segmentation.segment(df, lexicon, "key"), containment.with_contained(df, lexicon, "key")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan


def test_word_units(spark):
    words = ["中国", "中国人", "我", "x中"]
    texts = ["我是中国人!", "x中国 a1,学", "", None, "!!", "是"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, text string")
    split = rows.withColumn("u", segmentation.word_units(rows.text, words))
    got = {r.key: None if r.u is None else [x.unit for x in r.u] for r in split.collect()}
    pattern = "|".join(sorted(words, key=lambda w: (-len(w), w))) + "|[一-鿿]|[^一-鿿]+"
    assert got == {i: None if t is None else re.findall(pattern, t) for i, t in enumerate(texts)}
    tags = {r.key: [x.unit for x in r.u or [] if x.tag] for r in split.collect()}
    assert tags[0] == ["我", "中国人"]
    lexicon = spark.createDataFrame([("中国",), ("abc",), ("中国",), (None,)], "tag string")
    assert segmentation.usable_words(lexicon) == ["中国"]
    with pytest.raises(ValueError):
        segmentation.usable_words(lexicon, C.CJK, NONE)


def test_word_units_of_a_large_lexicon(spark):
    texts = ["我是中国人!", "x中国 a1,学", "", None, "!!", "是", "我是中国人!", "😀中国人x中"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, text string")
    tags = spark.createDataFrame([("中国",), ("中国人",), ("我",), ("x中",), ("中国",), ("abc",), (None,)], "tag string")
    got = [{r.key: r.u for r in segmentation.with_word_units(rows, tags, "text", "u", limit=n).collect()} for n in (A.LIMIT, NONE)]
    assert got[0] == got[1] and [x.unit for x in got[1][1]] == ["x中", "国", " a1,", "学"]


def test_word_units_of_documents_without_letters(spark, tmp_path):
    spark.createDataFrame([(1, "12 3. 4!", "en", "s"), (2, "a cat.", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "cat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tags, r.covered) for r in structure.word_units(spark, str(tmp_path)).collect()}
    assert got == {1: (0, None), 2: (1, 0.75)}


def test_long_texts_go_through_in_parts():
    sizes = A.np.array([5, 5, 50, 1, 1])
    assert list(A.parts(sizes, 10)) == [(0, 2), (2, 3), (3, 5)]
    got = A.lists(A.np.array([0, 0, 2]), 3, pa.array([1, 2, 3]), A.np.array([True, False, True])).to_pylist()
    assert got == [[1, 2], None, [3]]


def test_sizes_of_lists_are_read_from_their_offsets():
    runs = pa.array([["a", "b"], None, [], ["c"]], pa.list_(pa.string()))
    assert A._lengths(runs).tolist() == [2, 0, 0, 1] and A._lengths(runs.slice(2)).tolist() == [0, 1]
