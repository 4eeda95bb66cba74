"""Quotas against all quotients in order, and the mix against its targets."""

import random
import re

import duckdb
from lexloom.llm import mixing as M


def test_quotas_are_the_highest_quotients(spark):
    draw, rows, want = random.Random(5), [], {}
    for g in range(25):
        votes = [draw.choice([0, 1, 1, 3, 7, 40, 900]) * draw.random() for _ in range(draw.randint(1, 9))]
        most = [draw.randint(1, 60) for _ in votes]
        seats = draw.randint(0, sum(m for m, v in zip(most, votes) if v))
        order = sorted((-v / (2 * k + 1), k, p) for p, v in enumerate(votes) if v for k in range(most[p]))
        for p, v in enumerate(votes):
            want[g, p] = sum(q == p for _, _, q in order[:seats])
            if seats <= 0.9 * sum(v and m for m, v in zip(most, votes)):
                rows.append((g, p, float(v), seats, most[p]))
    df = spark.createDataFrame(rows, "g int, p int, votes double, seats long, most long")
    got = {(r.g, r.p): r.quota for r in M.sainte_lague(df, ["g"], "p", "votes", "seats", "most").collect()}
    loose = {g for g, *_ in rows if all(want[g, r[1]] < r[4] for r in rows if r[0] == g)}
    assert loose and {k: v for k, v in got.items() if k[0] in loose} == {k: want[k] for k in got if k[0] in loose}
    assert all(got[r[0], r[1]] <= r[4] for r in rows)


def docs(spark):
    draw = random.Random(1)
    rows = [(i, "w " * draw.randint(0, 300), "en", draw.choice(["a", "b", "a", "c", None]), 1) for i in range(400)]
    rows += [(900, None, "en", "a", 0), (901, "", "en", "b", 0), (902, "x y z", "en", "tiny", 5), (903, "w " * 50_000, "en", "a", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def sized(spark):
    return docs(spark).selectExpr("doc_id", "source", "CAST(regexp_count(coalesce(text, ''), 'w|x|y|z') AS long) AS size")


def test_mix_equals_sql_and_meets_targets(spark):
    got = M.mix(sized(spark)).drop("spans").toPandas().sort_values("doc_id")
    con = duckdb.connect()
    documents = docs(spark).toPandas()  # noqa: F841
    want = con.execute(re.sub(r"\bdocuments\b", "documents", M._SQL)).df().sort_values("doc_id")
    assert got["taken"].tolist() == want["taken"].tolist()
    assert abs(got["target"].to_numpy() - want["target"].to_numpy()).max() < 1e-6
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.fillna({"source": "null"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 1).all()


def test_texts_hold_the_words_taken(spark):
    out = M.mixed_texts(docs(spark))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = out.selectExpr("sum(regexp_count(text, 'w|x|y|z')) AS n").first().n
    assert words == M.mix(sized(spark)).selectExpr("sum(taken) AS n").first().n


def test_repeated_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", 4, "k")] * 3 + [(None, "a", 5, None), (2, None, None, "k")], "doc_id long, source string, size long, key string")
    got = M.mix(rows).collect()
    assert len(got) == 5 and {r.key for r in got} == {"k", None}
    assert sum(r.taken for r in got) == 26 or sum(r.taken for r in got) == 25  # a block is a word here


def test_empty_table(spark):
    assert M.mixed_texts(docs(spark).where("false")).count() == 0


def test_texts_keep_columns_of_any_name(spark):
    own = docs(spark).selectExpr("*", "doc_id AS size", "'t' AS target", "'p' AS pass", "'o' AS own", "'s' AS spans", "doc_id AS salt")
    out = M.mixed_texts(own)
    assert out.columns == own.columns
    rows = out.collect()
    assert rows and all(r.size == r.salt == r.doc_id and (r.target, r["pass"], r.own, r.spans) == ("t", "p", "o", "s") for r in rows)


def test_many_short_documents_meet_their_targets(spark):
    parts = {"a": (100_000, 10), "b": (40_000, 4), "c": (30_000, 3)}
    rows = spark.createDataFrame([(s, n, w) for s, (n, w) in parts.items()], "source string, n long, size long")
    rows = rows.selectExpr("explode(sequence(1L, n)) AS i", "source", "size").selectExpr("concat(source, i) AS doc_id", "source", "size")
    got = M.mix(rows).selectExpr("*", "aggregate(spans, 0L, (n, s) -> n + s.length * s.times) AS spanned").cache()
    by = got.groupBy("source").agg({"taken": "sum", "target": "max"}).toPandas()
    assert len(by) == 3 and (abs(by["sum(taken)"] - by["max(target)"]) <= 0.01 * by["max(target)"]).all()
    assert got.where("taken <> spanned OR taken > 2 * size OR exists(spans, s -> s.first < 0 OR s.first + s.length > size)").isEmpty()
    apart = "size(spans) < 2 OR forall(sequence(1, size(spans) - 1), i -> spans[i].first >= spans[i - 1].first + spans[i - 1].length)"
    assert got.count() == 170_000 and got.where(f"NOT ({apart})").isEmpty()


def test_sources_with_equal_limits_by_weight(spark):
    """Totals in proportion to the weights: all limits are met at one level."""
    rows = [(i, "w " * 120, "en", s, 1) for i, s in enumerate("aaabc")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = M.mix(documents.selectExpr("doc_id", "source", "120L AS size")).toPandas().sort_values("doc_id")
    by = dict(zip(got.source, got.target.round(6)))
    assert by == {"a": 495, "b": 165, "c": 240}
    documents = documents.toPandas()
    want = duckdb.connect().execute(M._SQL).df().sort_values("doc_id")
    assert got.taken.tolist() == want.taken.tolist() and abs(got.target.to_numpy() - want.target.to_numpy()).max() < 1e-6
