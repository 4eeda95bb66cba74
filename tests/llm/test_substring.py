"""Removed words against a plain version."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from lexloom.llm import substring as S


def plain(texts: dict[int, str | None], width: int) -> dict[int, tuple[int, str]]:
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    seen = Counter(tuple(w[k:k + width]) for w in words.values() for k in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone.update(range(k, k + width))
        out[i] = (len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def corpus() -> dict[int, str | None]:
    draw = random.Random(3)
    word = lambda: f"w{draw.randint(0, 400)}"
    passage = [word() for _ in range(60)]
    texts: dict[int, str | None] = {}
    for i in range(120):
        w = [word() for _ in range(draw.randint(0, 150))]
        if i % 3 == 0:
            a = draw.randint(0, 20)
            w[len(w) // 2:len(w) // 2] = passage[a:a + draw.randint(20, 40)]
        texts[i] = " ".join(w)
    texts[200], texts[201] = None, ""
    texts[202] = "a " * 500
    texts[203] = "a b c " * 40
    texts[204] = texts[1]
    texts[205] = texts[1] + "\n  tail\t"
    return texts


@pytest.mark.parametrize("heavy", [4096, 3])
@pytest.mark.parametrize("width", [35, 12])
def test_against_plain_version(spark, heavy, width):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    how = S.Repeats(width=width, heavy=heavy, docs_per_group=16)
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in S.without_repeats(docs, how=how).collect()}
    assert got == plain(texts, width)


def test_subtree_nodes_are_prefixes():
    ids = S.np.array([5, 6, 5, 6, 7, 5, 6, 5])
    nodes = S.subtree(ids, S.np.arange(8, 0, -1), 3)
    assert nodes[0] == nodes[5] and len(set(nodes[:6].tolist())) == 5 and nodes[6:].tolist() == [-1, -1]


def test_stage_keeps_columns_and_whole_texts(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(1, f"{text}  one\ttail", "p", 9), (1, text, "q", 9), (None, "  odd   spaces ", "r", 9), (4, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, n_chars long")
    got = {r.kept_text: r for r in S.cut_repeats(docs).collect()}
    assert S.cut_repeats(docs).columns == docs.columns
    assert got["p"].text == "one tail" and got["p"].n_chars == 8
    assert got["q"].text == "" and got["r"].text == "  odd   spaces " and got["r"].n_chars == 9
    assert (got["s"].text or "") == ""


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, g long")
    assert S.cut_repeats(docs).count() == 0


def test_stage_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 3)], ["doc_id", "text", "kept_text", "own_kept_text", "a.b"])
    assert [tuple(r) for r in S.cut_repeats(docs).collect()] == [(1, "a b", "x", "y", 3)]
    assert S.cut_repeats(docs).columns == docs.columns


def test_rows_may_come_in_another_order_each_time(spark):
    """Parts of a shuffle arrive in any order on a cluster, so the two visits to a group may see its rows in different ones."""
    texts = corpus()

    def stir(tables):
        rows = [r for t in tables for r in t.to_pylist()]
        random.shuffle(rows)
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).mapInArrow(stir, "doc_id long, text string")
    old = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.doc_id: (r.n_removed, r.kept_text) for r in S.without_repeats(docs, how=S.Repeats(docs_per_group=64)).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)
    assert got == plain(texts, 35)
