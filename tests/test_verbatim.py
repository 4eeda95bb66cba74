"""Verbatim checks against plain search, on documents of many blocks and parts."""

import random
import re

from lexloom.operators import containment as K
from lexloom.operators import verbatim as V

DOC = "doc int, doc_text string"


def corpus(seed=8):
    draw = random.Random(seed)
    line = lambda: "".join(draw.choice("ab c。！") for _ in range(draw.randint(0, 14)))
    docs = {d: "\n".join(line() for _ in range(draw.choice([0, 1, 3, 40]))) for d in range(6)}
    return draw, docs, line


def norm(s):
    return re.sub("[ \t]+", "", s.translate(str.maketrans("，。？！：；（）“”‘’　", ",.?!:;()\"\"'' ")))


def test_blocks_are_cut_at_ends_of_lines():
    text = "ab\ncd\n\nefghijkl\nm"
    for size in range(1, 25):
        blocks = V.cut_blocks(text, size)
        assert "\n".join(blocks) == text
        assert all(len(b) <= size or "\n" not in b for b in blocks)


def test_sentences(spark):
    draw, docs, line = corpus()
    rows = [(i, draw.randrange(7), draw.choice([line(), line()[:3], docs[draw.randrange(6)][5:9]])) for i in range(400)]
    rows += [(1000, 0, None), (1001, 3, ""), (1002, 99, ""), (1003, None, "a")]
    book = spark.createDataFrame([*docs.items(), (7, None)], DOC)
    df = spark.createDataFrame(rows, "key int, doc int, text string").withColumn("verbatim", V.F.lit(1))
    want = {i: t is not None and d in docs and any(norm(t) in x for x in norm(docs[d]).split("\n")) for i, d, t in rows}
    for sizes in ({}, {"long": 3, "block": 16, "part": 3}):
        got = K.flag_verbatim(df, book, ["doc"], **sizes)
        assert {r.key: r.verbatim for r in got.collect()} == want
    assert True in want.values() and False in want.values()


def test_cloze(spark):
    draw, docs, line = corpus(9)
    items = [(i, draw.randrange(7), "___".join(line()[:draw.randint(0, 3)] for _ in range(draw.randint(1, 4)))) for i in range(400)]
    items += [(1000, 0, None), (1001, 3, "___"), (1002, 99, "___"), (1003, 3, "a\nb")]

    def stands(d, q):
        if q is None or d not in docs:
            return False
        parts = [p for p in map(norm, q.split("___")) if p]
        if any("\n" in p for p in parts):
            return False
        return any(re.search(".*?".join(map(re.escape, parts)), x) for x in norm(docs[d]).split("\n"))

    book = spark.createDataFrame(list(docs.items()), DOC)
    df = spark.createDataFrame(items, "key int, doc int, question string")
    want = {i: stands(d, q) for i, d, q in items}
    for sizes in ({}, {"long": 3, "block": 16, "part": 3}):
        got = K.flag_verbatim_cloze(df, book, ["doc"], **sizes)
        assert {r.key: r.verbatim for r in got.collect()} == want
    assert sum(want.values()) > 20


def test_a_document_of_a_million_sentences(spark):
    n = 1_000_000  # one document, some 40 MB
    text = "concat('sentence ', id, ' of the one long document.')"
    book = spark.range(n).selectExpr("1 AS doc", f"{text} AS s", "id DIV 1000 AS b").groupBy("doc", "b").agg(V.F.array_join(V.F.collect_list("s"), "\n").alias("t"))
    book = book.groupBy("doc").agg(V.F.array_join(V.F.collect_list("t"), "\n").alias("doc_text"))
    rows = spark.range(n).selectExpr("1 AS doc", f"if(id % 10 = 0, concat({text}, '!'), {text}) AS text")
    got = K.flag_verbatim(rows, book, ["doc"])
    assert got.where("verbatim").count() == n - n // 10


def test_many_strings_are_looked_up_at_once():
    draw = random.Random(3)
    text = "".join(draw.choice("abc ") for _ in range(3000))
    some = [text[i:i + draw.randint(1, 30)] for i in range(0, 2900, 7)] + ["".join(draw.choice("abc ") for _ in range(9)) for _ in range(300)]
    strings = V.Strings(some)
    assert strings.tables and strings.single
    assert strings.inside(text) == {s for s in some if s in text}
