"""The identity, the training and the held-out accuracy of the machine."""

import numpy as np
import pytest
from lexloom.llm import fm_quality as Q

SF = "/root/testdata/sf0.01"
HOW = Q.Machine(buckets=64, rank=3, epochs=30)


def test_sum_of_squares_identity():
    draw = np.random.default_rng(0)
    x = Q.inputs([b"a b c a", b"", None, b"X ! y\nx"], HOW)
    n = Q.n_inputs(HOW)
    w = Q.Weights(0.3, draw.standard_normal(n), draw.standard_normal((n, 3)))
    got, _ = Q.raw_scores(x, w)
    for k, (a, b) in enumerate(zip(x.starts[:-1], x.starts[1:])):
        i, v = x.index[a:b], x.value[a:b].astype(float)
        pairs = sum(w.factors[i[p]] @ w.factors[i[q]] * v[p] * v[q] for p in range(len(i)) for q in range(p))
        assert got[k] == pytest.approx(0.3 + w.linear[i] @ v + pairs, rel=1e-4, abs=1e-4)


def test_learns_an_interaction():
    texts = [b"red big"] * 20 + [b"blue small"] * 20 + [b"red small"] * 20 + [b"blue big"] * 20
    label = np.array([1.0] * 40 + [0.0] * 40)
    how = Q.Machine(buckets=64, rank=4, epochs=200, batch=8)
    x = Q.inputs(texts, how)
    score, _ = Q.raw_scores(x, Q.train(x, label, how))
    assert ((score > 0) == (label > 0.5)).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_odd_rows_and_missing_labels(spark):
    docs = frame(spark, [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "q" * 100_000, "y"), (4, "", "z")])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    score = Q.scorer(Q.fit(docs, labels, HOW), HOW)
    assert [r.s for r in docs.select(score("text").alias("s")).collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 1)], "doc_id long, quality int")
    got = [r.s for r in docs.select(Q.scorer(Q.fit(docs, one, HOW), HOW)("text").alias("s")).collect()]
    assert all(0.9 < s <= 1 for s in got)
    assert docs.where("false").select(score("text")).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = Q.fit(docs, labels, HOW)
    b = Q.fit(docs, labels.withColumn("quality", Q.F.when(Q.held_out(), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality"))), HOW)
    assert (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_held_out_accuracy(spark):
    got = Q.op10(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = got[got.quality == 0], got[got.quality == 1]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.6
    above = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()
    assert above > 0.97
