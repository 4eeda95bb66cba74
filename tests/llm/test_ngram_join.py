"""Components against all pairs."""

import random

import pytest
from lexloom.llm import ngram_join as N


def plain(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def corpus() -> dict[int, str | None]:
    draw = random.Random(11)
    texts: dict[int, str | None] = {}
    line = " ".join(f"common{i}" for i in range(30))
    for group in range(12):
        base = [f"w{draw.randint(0, 300)}" for _ in range(draw.randint(3, 120))]
        for _ in range(draw.randint(1, 14)):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                w[draw.randrange(len(w))] = f"z{draw.randint(0, 99)}"
            text = " ".join(w)
            texts[len(texts) * 7 % 1000] = f"{line} {text}" if group % 2 else text.upper()
    texts |= {2001: None, 2002: "", 2003: "one two", 2004: "One TWO", 2005: " \n ", 2006: "É a b c d", 2007: "é a b c d"}
    return texts


@pytest.mark.parametrize("tile", [1024, 3])
def test_against_all_pairs(spark, tile):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = N.near_copies(docs, how=N.Join(tile=tile, docs_per_group=8)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(texts)


def test_prefix_length():
    assert [N.prefix_length(n, 75) for n in (0, 1, 4, 5, 100)] == [0, 1, 2, 2, 26]


def test_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(5, text, "a"), (3, text + " y", "b"), (3, text + " y", "c"), (None, text, "d"), (9, None, "e"), (8, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string").selectExpr("*", "1 AS _kept", "2 AS id", "3 AS g")
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(r.cls for r in kept.collect())
    assert got in (["b", "d", "e", "f"], ["c", "d", "e", "f"])


A, B = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")


def test_ids_that_repeat(spark):
    """Rows that share an id are texts of their own: no link and no text is lost."""
    docs = spark.createDataFrame([(5, A), (5, B), (7, A + " x"), (9, B + " y")], "doc_id long, text string")
    got = sorted(tuple(r) for r in N.near_copies(docs).select("doc_id", "component_id", "n_links").collect())
    assert got == [(5, 5, 1), (5, 5, 1), (7, 5, 1), (9, 5, 1)]


@pytest.mark.parametrize("rows, kept", [
    ([(3, A), (5, A + " q"), (5, B)], [(3, A), (5, B)]),
    ([(4, A), (3, A + " q"), (3, A + " q")], [(3, A + " q")]),
    ([(5, A), (5, B), (7, A + " x"), (9, B + " y")], [(5, A), (5, B)]),
    ([(5, ""), (5, None), (5, A), (6, A.upper()), (None, A), (None, A)], [(5, A), (5, None), (None, A), (None, A)]),
    ([(2, A), (2, A + " z"), (1, B), (1, B)], [(1, B), (2, A)]),
])
def test_one_row_of_each_component(spark, rows, kept):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text or None) for r in N.keep_first(docs).collect()]
    other = [(i, (t + " z") if (i, t) == (2, A) else t) for i, t in kept]
    assert sorted(got, key=repr) in (sorted(kept, key=repr), sorted(other, key=repr))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, id long")
    assert N.near_copies(docs).count() == 0


def links_of(texts: dict[int, str | None]) -> dict[int, int]:
    """The number of other texts that link with each, by all pairs."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    return {i: sum(j != i and bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}


@pytest.mark.parametrize("tile", [1024, 3])
def test_every_link_counts(spark, tile):
    draw = random.Random(3)
    base = [f"v{k}" for k in range(200)]
    texts = corpus() | {3000 + k: " ".join(base[:k * 3] + [f"own{k}"] + base[k * 3:]) for k in range(20)}
    texts |= {3100 + k: texts[3000 + draw.randrange(20)] for k in range(10)}
    docs = spark.createDataFrame([*texts.items(), (None, texts[3000])], "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in N.near_copies(docs, how=N.Join(tile=tile, docs_per_group=8)).collect()}
    want = links_of(texts)
    assert got == want | {None: 0} and min(want[3000 + k] for k in range(20)) == 29
