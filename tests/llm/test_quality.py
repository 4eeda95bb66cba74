"""Measures against a plain version, and the estimate on planted faults."""

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from lexloom.llm import quality as Q

CLEAN = " ".join(f"word{i} stands here." for i in range(30))


def plain(text: str | None) -> dict[str, int]:
    text = text or ""
    w = regex.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(regex.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(hit),
        "n_distinct": len(set(w)), "n_marks": text.count("!"),
    }


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|!Q\x85", max_size=60)), max_size=5))
def test_measures(texts):
    got = Q.measure_texts([t.encode() if t is not None else None for t in texts])
    for i, t in enumerate(texts):
        want = plain(t)
        assert {m: int(got[m][i]) for m in want} == want


def test_estimate_finds_the_fault_without_labels():
    patterns = np.array([[2, 2, 2], [1, 2, 2], [2, 1, 1], [0, 2, 2]])
    found = Q.estimate(patterns, np.array([900.0, 3, 80, 17]))
    assert found.prior > 0.85
    assert min(found.right_on_good) >= 0.99
    assert found.right_on_bad[1] > 0.5 > found.right_on_bad[0]


def rows(spark):
    return spark.createDataFrame(
        [(1, CLEAN, "m"), (1, CLEAN, "m"), (2, None, None), (3, "", "m"), (4, "x " * 50, "m"), (5, "q" * 200_000, "m"),
         (None, CLEAN + "\n" + CLEAN.upper(), "m"), (7, "### " * 3 + CLEAN, "m")],
        "doc_id long, text string, m string",
    )


def test_defined_for_odd_rows(spark):
    docs, rules = rows(spark), Q.default_rules()
    measured = Q.measured_by_id(docs)
    got = Q.judge(measured, Q.fit(measured, rules), rules).collect()
    assert len(got) == 8
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].kept and not by_id[1].base_failed
    assert all(by_id[i].base_failed and not by_id[i].kept for i in (2, 3, 4, 5))
    assert all(r.kept is not None and 0 <= r.p_good <= 1 for r in got)


def test_stage_keeps_columns_and_repeated_rows(spark):
    kept = Q.keep_good(rows(spark))
    assert kept.columns == ["doc_id", "text", "m"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 1, 7]


def test_empty_table(spark):
    assert Q.keep_good(rows(spark).where("false")).count() == 0


def test_stage_takes_columns_of_any_name(spark):
    docs = rows(spark).withColumn("a.b", Q.F.lit(1))
    assert Q.keep_good(docs).columns == docs.columns
