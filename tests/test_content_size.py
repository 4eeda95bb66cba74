"""The content build on its own rows: how much disk it takes, and untagged items against tagged questions."""

import os
import random
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_content import build as built

from lexloom import catalog
from lexloom import config as C
from lexloom.operators import automaton, dedup
from lexloom.plans import content


def course(folder: Path) -> None:
    """Course text whose sentences nearly all pass and differ, over a vocabulary that the benchmark texts teach."""
    import pyarrow.parquet as pq

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)}) + ["the"]
    taught = [" ".join([*words, "."])] * 13
    pq.write_table(pa.table({"item_id": pa.array(range(13), pa.int64()), "text": taught}), folder / "benchmark.parquet")
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(6, 14)) + ["the"] + rng.choices(words, k=3)) + "." for _ in range(20)) for _ in range(500)]
    kinds = {"doc_id": pa.array(range(500), pa.int64()), "text": texts, "lang": ["en"] * 500, "source": ["src0"] * 500, "n_chars": [len(t) for t in texts]}
    pq.write_table(pa.table(kinds), folder / "documents.parquet")


def on_disk(spark) -> int:
    local = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    tops = [*local, spark.conf.get("spark.checkpoint.dir")]
    return sum(os.lstat(f"{d}/{x}").st_size for top in tops for d, _, names in os.walk(top) for x in names if os.path.exists(f"{d}/{x}"))


def test_disk_of_the_build(spark, tmp_path):
    course(tmp_path)
    spark._jvm.System.gc()
    time.sleep(2)
    before = on_disk(spark)
    assert catalog.queries()["build_content"](spark, str(tmp_path)).agg(F.sum("questions")).first()[0] > 10_000
    taken = (on_disk(spark) - before) / (tmp_path / "documents.parquet").stat().st_size
    assert taken < 25, taken


@pytest.mark.parametrize("limit", [automaton.LIMIT, automaton.Limit(0, 0)])
def test_untagged_items_give_the_same_documents(spark, limit):
    words, sentences, cloze = built(spark)
    blocklist = spark.createDataFrame([("没有",)], "line string")

    def rows(docs):
        return sorted((d.unit, d.block, [r.asDict() for r in d.records]) for d in docs.collect())

    want = rows(content.documents(content.build(words, sentences, cloze, blocklist), 7))
    got = rows(content.documents(content.build(words, sentences, cloze, blocklist, tagged=False), 7, words, limit))
    assert len(want) > 3 and got == want


def test_words_contained_in_each_text_of_an_array(spark):
    words = ["ab", "b", "bc", "中国"]
    given = [["abc", None, "中国b"], [], ["", "abc", "abc"], ["x"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "k int, texts array<string>").coalesce(1)
    got = {r.k: [sorted(x) for x in r.found] for r in df.withColumn("found", automaton.contained_in_each(F.col("texts"), words)).collect()}
    assert got == {i: [sorted(w for w in words if w in (t or "")) for t in x] for i, x in enumerate(given)}


def test_merge_keeps_what_is_asked_for(spark):
    rows = spark.createDataFrame(
        [(3, "Ab c.", 1, 5, "x"), (3, "ab, c", 0, 9, "y"), (None, "abc", 0, 1, "z"), (None, "abc", 0, 0, "w"), (3, "?!", 0, 0, "v"), (4, None, 0, 0, "u")],
        "unit int, text string, source_rank int, seq long, key string",
    )
    whole = dedup.merge_sentences(rows, C.LATIN, F.lower("text"))
    assert {(r.unit, r.content, r.key) for r in whole.collect()} == {(3, "abc", "y"), (None, "abc", "w")}
    some = dedup.merge_sentences(rows, C.LATIN, F.lower("text"), ["unit", "key"])
    assert some.columns == ["unit", "key"] and {tuple(r) for r in some.collect()} == {(3, "y"), (None, "w")}
