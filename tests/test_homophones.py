"""Classes of texts that sound alike, against all pairs."""

import random

from lexloom.operators import grading as G

READINGS = [("马", "ma3"), ("妈", "ma1"), ("吗", "ma5"), ("不", "bu4"), ("是", "shi4"), ("十", "shi2"), ("一", "yi1"), ("好", "hao3")]


def classes(spark, texts, **kw):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    readings = spark.createDataFrame(READINGS, "char string, reading string")
    return {r.first_text: r for r in G.homophone_classes(rows, readings, overrides={}).collect()}


def plain(spark, texts):
    """n_accepted of every text, by comparing each with all as the pairwise grader does."""
    texts = [t for t in texts if t.strip()]
    pairs = spark.createDataFrame([(g, e) for g in texts for e in set(texts)], "given string, expected string")
    readings = spark.createDataFrame(READINGS, "char string, reading string")
    same = G.homophone_match(pairs, readings, overrides={}).where("same_sound").groupBy("expected").count()
    return {r.expected: r["count"] for r in same.collect()}


def test_against_all_pairs(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice([c for c, _ in READINGS]) for _ in range(draw.randint(1, 3))) for _ in range(90)]
    texts += ["", " ", "abc", "xyz", "!", None, "好马", "好马"]
    got, want = classes(spark, texts), plain(spark, [t for t in texts if t])
    assert sum(r.n_rows for r in got.values()) == sum(bool(t and t.strip()) for t in texts)
    assert {t: r.n_accepted for t, r in got.items()} == {t: want[t] for t in got}


def test_sandhi_and_open_tones(spark):
    got = classes(spark, ["不是", "马马", "妈马", "吗", "马", "妈", "马"])
    assert got["不是"].tones == "24" and got["马马"].tones == "23"
    assert got["吗"].n_accepted == 4 and got["妈"].n_accepted == 1 and got["马"].n_accepted == 2


def test_a_hot_sound_becomes_a_few_forms(spark):
    texts = ["马" + "!" * (i % 50) for i in range(4000)] + ["吗"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    readings = spark.createDataFrame(READINGS, "char string, reading string")
    assert G.sound_forms(rows, readings, overrides={}).count() == 2
    assert classes(spark, texts)["吗"].n_accepted == 4001


def test_no_text_travels_with_characters(spark):
    rows = spark.createDataFrame([("好马",)], "text string")
    readings = spark.createDataFrame(READINGS, "char string, reading string")
    plan = G.readings_of(rows, readings)._jdf.queryExecution().optimizedPlan().toString()
    generated = plan[plan.index("Generate"):].split("\n")[0]
    assert "_id" in generated or "char" in generated
    above = plan[:plan.index("Generate")].split("\n")
    assert not any("char#" in line and " text#" in line for line in above if "Aggregate" in line)
