"""The permutation is one, and shards give back the row of ids."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexloom.llm import materialise as M
from lexloom.llm.tokens import encoder
from lexloom.session import shared_dir


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_and_its_inverse(n, key):
    order = M.Permutation(n, key)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert order.numbers(slots).tolist() == list(range(n))


def test_order_depends_on_the_key():
    a, b = (M.Permutation(1000, k).slots(np.arange(1000)) for k in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


@pytest.mark.parametrize("parts", [1, 3])
def test_round_trip(spark, parts):
    texts = ["one two", None, "", "x " * 900, "né"] * 9
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, ids long").coalesce(parts)
    how, root = M.Layout(length=64, per_shard=7, per_block=3, held_bytes=2000), shared_dir(spark, "training")
    cut = M.materialise(M.sequences(docs, how), "sequences")
    dealt, total = M.deal(cut, how)
    rows = M.read_back(M.write_shards(dealt, root, how), root, total, how).toPandas().sort_values("sequence")
    assert rows.sequence.tolist() == list(range(total)) and sorted(rows.slot) == list(range(total))
    assert (rows.byte_offset == rows.slot % 7 * how.stride).all() and (rows.shard == rows.slot // 7).all()
    by_slot = dict(M.read_slots(root, how, 0, total))
    tokens, starts = encoder().encode(texts)
    want = np.insert(tokens, starts[1:], 0)
    got = np.concatenate([by_slot[s] for s in rows.slot])
    assert len(got) == len(want) and (parts > 1 or (got == want).all())
    resumed = dict(M.read_slots(root, how, total // 2, total))
    assert all((resumed[s] == by_slot[s]).all() for s in range(total // 2, total))


def test_damage_is_seen(spark):
    how, root = M.Layout(length=8, per_shard=4), shared_dir(spark, "training")
    dealt, _ = M.deal(M.materialise(M.sequences(spark.createDataFrame([("a b c",)], "text string"), how), "sequences"), how)
    M.write_shards(dealt, root, how).count()
    system, base = M.files.store(root)
    with system.open_output_stream(f"{base}/{M.shard_name(0)}", compression=None) as out:
        out.write(b"\x01" * how.stride)
    with pytest.raises(ValueError):
        list(M.read_slots(root, how, 0, 1))


def test_empty_table(spark):
    how, root = M.Layout(), shared_dir(spark, "training")
    cut = M.materialise(M.sequences(spark.createDataFrame([], "text string"), how), "sequences")
    dealt, total = M.deal(cut, how)
    assert total == 0 and M.read_back(M.write_shards(dealt, root, how), root, total, how).count() == 0


def test_reading_back_is_spread_and_wide_ids_are_refused(spark):
    how, root = M.Layout(length=8, per_shard=2, per_block=4), shared_dir(spark, "training")
    docs = spark.range(300).selectExpr("concat('some words ', id, ' and more of them') AS text")
    dealt, total = M.deal(M.materialise(M.sequences(docs, how), "sequences"), how)
    found = M.read_back(M.write_shards(dealt, root, how), root, total, how)
    assert total > 200 and found.rdd.getNumPartitions() >= total // 2 // M.SHARDS_READ
    with pytest.raises(Exception, match="does not fit"):
        M.sequences(docs, M.Layout(id_type="<u1")).count()
