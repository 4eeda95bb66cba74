"""Cuts against the least cost over all ways, and pieces against the row of ids."""

import random
import zlib

import numpy as np
from lexloom.llm import packing as P
from lexloom.llm.tokens import encoder


def cost(places, penalty, cuts, how):
    fine = dict(zip(places, penalty))
    total = 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        n = b - a
        assert 0 < n <= how.length
        power = n & (n - 1) == 0 and n >= how.least_power
        total += (0 if power else how.length - n) + fine[b] + how.fee
    return total


def test_cuts_are_the_cheapest():
    draw = random.Random(4)
    how = P.Packing(length=16, least_power=4, fee=1, inside_document=2, inside_sentence=3)
    for _ in range(200):
        steps = [draw.randint(1, 16) for _ in range(draw.randint(1, 9))]
        places = np.cumsum([0, *steps])
        penalty = np.array([0, *[draw.choice([0, 2, 3]) for _ in steps]])
        best = {0: 0}
        for j, b in enumerate(places[1:].tolist(), 1):
            best[b] = min(
                best[a] + cost(places.tolist(), penalty.tolist(), [a, b], how) for a in places[:j].tolist() if b - a <= 16
            )
        got = P.choose_cuts(places, penalty, how)
        assert got[0] == 0 and got[-1] == places[-1]
        assert cost(places.tolist(), penalty.tolist(), got, how) == best[int(places[-1])]


def test_pieces_cover_every_id_once(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["alpha", "b.", "gamma!", "né\n", "x"]) for _ in range(draw.randint(0, 700))) for _ in range(60)]
    texts += [None, "", "q" * 30_000, "a  b\t\n\n c"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").coalesce(2)
    got = P.pack(docs, with_ids=True).toPandas()
    for i, text in enumerate(texts):
        own = got[got.doc_id == i].sort_values("start")
        ids = np.append(encoder().encode([text])[0], np.uint32(0)).astype("<u4")
        assert (own.doc_tokens == len(ids)).all() and b"".join(own.ids) == ids.tobytes()
        assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist()
        assert own.ids_crc32.tolist() == [zlib.crc32(b) for b in own.ids]
    held = padded = 0
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        n = int(one.length.sum())
        assert n <= 1024 and one.offset.tolist() == np.cumsum([0, *one.length[:-1]]).tolist()
        held += n
        padded += 0 if n & (n - 1) == 0 else 1024 - n
    assert padded < 0.05 * held


def test_repeated_and_nameless_rows(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(None, "c")], "doc_id long, text string").coalesce(1)
    got = P.pack(docs).collect()
    assert [r.doc_id for r in got] == [1, 1, 1, None] and [r.offset for r in got] == [0, 3, 6, 9]


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
