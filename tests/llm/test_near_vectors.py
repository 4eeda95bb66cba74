"""Links and components of vectors against all cosines."""

import numpy as np
import pytest
from lexloom.llm import near_vectors as V
from lexloom.llm.components import components


def corpus():
    draw = np.random.default_rng(6)
    rows, i = [], 0
    for _ in range(25):
        centre = draw.standard_normal(24)
        for _ in range(draw.integers(1, 12)):
            rows.append((int(i * 37 % 997), (centre + draw.standard_normal(24) * draw.choice([0, 0.02, 0.15, 0.3])).astype(np.float32).tolist()))
            i += 1
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [float("inf")] + [1.0] * 23, [1.0] * 5, [2.0] * 5, [-0.0] + [1.0] * 23, [0.0] + [1.0] * 23]
    return rows + [(2000 + k, v) for k, v in enumerate(odd)]


def plain(rows):
    def unit(v):
        v = np.array([np.nan if x is None else x for x in v or []], float)
        return v / np.linalg.norm(v) if len(v) and np.isfinite(v).all() and v.any() else None

    units = {i: unit(v) for i, v in rows}
    links = {i: {j for j, b in units.items() if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95} for i, a in units.items()}
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            fresh = links[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("tile", [2048, 3])
def test_against_all_cosines(spark, tile):
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = V.near_vectors(df, how=V.Hashing(tile=tile)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == plain(rows)


def test_repeated_rows_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (None, [1.0, 0.0], 3)], "vec_id long, embedding array<float>, n_links int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_vectors(df).collect()), key=str)
    assert got == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (None, 0, None, True)]
    assert V.near_vectors(df.where("false")).count() == 0


def test_recall_at_the_threshold():
    """Pairs at a cosine of just 0.95 are met in some table with a chance above 0.99."""
    draw, how = np.random.default_rng(1), V.Hashing()
    a, b = (draw.standard_normal((3000, 64)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    signs = [(x @ V.planes(how, 64).T > 0).reshape(-1, how.tables, how.bits) for x in (a, b)]
    assert (signs[0] == signs[1]).all(axis=2).any(axis=1).mean() > 0.99


def test_hashing_grows_with_the_table():
    assert V.Hashing.for_rows(500) == V.Hashing.for_rows(60_000) == V.Hashing()
    large = V.Hashing.for_rows(10**9)
    assert large.bits == 26 and 100 < large.tables < 150


def test_components_of_long_chains(spark):
    n = 300
    pairs = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 80)] + [(5000, 5000), (7, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.component_id for r in components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(80)}
    assert components(df.where("false")).count() == 0


def test_ids_that_repeat(spark):
    """Rows that share an id are vectors of their own."""
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 0.01]), (9, [0.01, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in V.near_vectors(df).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 1, 5, False)]
