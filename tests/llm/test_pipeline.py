"""Every stage on what the stage before kept, against plain versions; queries with SQL against it."""

import re
from pathlib import Path

import pytest
from check import oracle_tables, rows_of

import __spark_entry__ as entry
import corpus_pipeline as C
from lexloom import llm
from test_ngram_join import plain as plain_components
from test_substring import plain as plain_repeats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        docs = _written(spark, stage(spark, docs, SF), name)
        seen[name] = docs.toPandas()
        assert name == "packing" or docs.columns == columns
    raw = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    good = seen["quality_rules"]
    assert set(good.doc_id) < set(raw.doc_id) and len(good) > 0.7 * len(raw)
    groups = plain_components(dict(zip(good.doc_id, good.text)))
    joined = seen["ngram_join"]
    assert sorted(joined.doc_id) == sorted({c for _, c in groups.values()})
    cut = seen["substring_dedup"].set_index("doc_id")
    want = plain_repeats(dict(zip(joined.doc_id, joined.text)), 35)
    before = joined.set_index("doc_id").text
    assert all(cut.text[i] == (kept if n else before[i]) for i, (n, kept) in want.items())
    mixed = seen["mixing"]
    total = sum(map(count, cut.text))
    assert abs(sum(map(count, mixed.text)) - 1.5 * total) < 0.02 * total
    assert mixed.groupby("doc_id").size().max() <= 2
    packed = seen["packing"]
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()


def _written(spark, df, name):
    path = C.shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_run_is_registered(spark):
    assert entry.queries()["pipeline"].__wrapped__ is C.run
    assert C.run(spark, SF).columns[:2] == ["doc_id", "start"]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = oracle_tables(SF)
    got = llm.queries()[name](spark, SF).toArrow()
    want = con.execute(llm.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_stages_on_repeated_ids_and_on_nothing(spark):
    base = [" ".join(f"w{d}x{i} of" for i in range(60)) for d in range(6)]
    rows = [(5, base[0], "en", "a", 1), (5, base[1], "en", "a", 1), (7, f"{base[0]} more", "en", None, 1), (9, base[2], "en", "b", 1), (9, base[2], "en", "b", 1),
            (None, base[3], "en", "a", 1), (11, None, "en", "a", None), (12, "", "en", "c", 0), (13, base[4], None, "c", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    seen = {}
    docs = spark.createDataFrame(rows, schema)
    for name, stage in C.STAGES:
        docs = _written(spark, stage(spark, docs, SF), name)
        seen[name] = docs.collect()
    texts = lambda name: sorted((str(r.doc_id), r.text) for r in seen[name])
    want = sorted([("5", base[0]), ("5", base[1]), ("9", base[2]), ("None", base[3]), ("13", base[4])])
    assert texts("ngram_join") == texts("substring_dedup") == want
    assert abs(sum(count(r.text) for r in seen["mixing"]) - 900) <= 3
    assert seen["packing"]
    docs = spark.createDataFrame([], schema)
    for name, stage in C.STAGES:
        docs = _written(spark, stage(spark, docs, SF), name)
        assert docs.count() == 0
