"""Lattices against all ways to cut a word, learning against plain expectation-maximisation, scores against plain sums."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import lattice as L

NAMES = [" ", "a", "b", "ab", " a", " ab", "aba", "bb", "é", " aé"]
PIECES = L.Pieces.of(NAMES)


def cuts(chars):
    """All ways to cut characters into pieces, as lists of numbers; lone characters go by their bytes."""
    if not chars:
        return [[]]
    out = []
    for n in range(1, len(chars) + 1):
        if chars[:n] in NAMES:
            out += [[NAMES.index(chars[:n]), *rest] for rest in cuts(chars[n:])]
    if chars[0] not in NAMES:
        out += [[*(len(NAMES) + b for b in chars[0].encode()), *rest] for rest in cuts(chars[1:])]
    return out


def some_logp(seed=1):
    p = np.random.default_rng(seed).random(PIECES.size) + 0.01
    return np.log(p / p.sum())


def plain_marginal(word, logp):
    return math.log(sum(math.exp(sum(logp[i] for i in way)) for way in cuts(" " + word)))


def plain_learn(counts, n_texts, rounds):
    logp = PIECES.start()
    for _ in range(rounds):
        uses = np.full(PIECES.size, L.SMOOTH)
        for word, c in counts.items():
            ways = cuts(" " + word)
            p = np.array([math.exp(sum(logp[i] for i in way)) for way in ways])
            for way, share in zip(ways, p / p.sum()):
                for i in way:
                    uses[i] += share * c
        uses[PIECES.end] += n_texts
        logp = np.log(uses / uses.sum())
    return logp


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abéx漢", min_size=1, max_size=7), min_size=1, max_size=9), st.integers(0, 99))
def test_marginals_and_uses(words, seed):
    logp = some_logp(seed)
    assert np.allclose(L.marginals(words, PIECES, logp), [plain_marginal(w, logp) for w in words])
    counts = np.arange(1, len(words) + 1)
    lattice = L.Lattice.of(words, PIECES)
    want = np.zeros(PIECES.size)
    for word, c in zip(words, counts):
        ways = cuts(" " + word)
        p = np.array([math.exp(sum(logp[i] for i in way)) for way in ways])
        for way, share in zip(ways, p / p.sum()):
            np.add.at(want, way, share * c)
    assert np.allclose(lattice.expected(PIECES, logp, counts), want)


def test_whole_text_is_the_sum_of_its_words():
    logp = some_logp()
    ways = cuts(" ab aba")
    whole = math.log(sum(math.exp(sum(logp[i] for i in way)) for way in ways))
    assert math.isclose(whole, sum(L.marginals(["ab", "aba"], PIECES, logp)))


def test_probabilities_of_all_words_sum_to_one_at_most():
    logp = some_logp()
    words = [w for n in range(1, 7) for w in map("".join, __import__("itertools").product("ab", repeat=n))]
    assert np.exp(L.marginals(words, PIECES, logp)).sum() < 1


def test_long_word():
    got = L.marginals(["a" * 50_000, "a"], L.read_pieces(), L.read_pieces().start())
    assert np.isfinite(got).all() and got[0] < 1000 * got[1]


def test_vocabulary_has_every_text():
    pieces = L.read_pieces()
    assert 20_000 < pieces.n < 32_000
    assert np.isfinite(L.marginals(["hello", "▁x", "漢字", "\U0001f600", "\x00"], pieces, pieces.start())).all()


TEXTS = ["ab aba  b", "Ab\tAB x", "", None, "aé aé bb", "ab ab ab ab", "new words here", "b" * 30, "aba a b"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(L.UPPER, L.LOWER)))


def plain_scores(rows, train, rounds):
    counts = Counter(w for (i, t), on in zip(rows, train) if on for w in words(t))
    texts = sum(train)
    logp = plain_learn(counts, texts, rounds)
    n, v = sum(counts.values()) + texts, len(counts) + (texts > 0)
    out = []
    for (i, t), on in zip(rows, train):
        mine = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine) + math.log10((texts + 1) / (n + v + 1))
        score = (sum(plain_marginal(w, logp) for w in mine) + logp[PIECES.end]) / math.log(10)
        out.append((i, on, len(mine) + 1, sum(counts[w] > 0 for w in mine) + (texts > 0), n, base, score))
    return out


def close(got, want):
    key = lambda r: tuple(map(repr, r[:5])) + (round(r[6], 6),)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=1e-9)


@pytest.mark.parametrize("heavy", [4, 1 << 20])
def test_scores(spark, monkeypatch, heavy):
    monkeypatch.setattr(L, "read_pieces", lambda path=None: PIECES)
    rows = [*enumerate(TEXTS), (3, "ab"), (3, "ab"), (None, "ab q")]
    train = [i is None or i % 3 != 1 for i, _ in rows]
    df = spark.createDataFrame([(i, t, on, "x", 1) for (i, t), on in zip(rows, train)], "doc_id int, text string, on boolean, word string, n int")
    from pyspark.sql import functions as F
    close(L.score(df, F.col("on"), heavy=heavy).collect(), plain_scores(rows, train, L.ROUNDS))


def test_nothing_to_learn_from(spark, monkeypatch):
    monkeypatch.setattr(L, "read_pieces", lambda path=None: PIECES)
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    none = L.score(df, F.lit(False)).collect()
    assert {tuple(r[:5]) for r in none} == {(1, False, 2, 0, 0), (2, False, 1, 0, 0)}
    assert all(r.base_score == 0 and r.score < 0 for r in none)
    assert L.score(df.where("false"), F.lit(True)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in L.op12(spark, sf).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in [*words(t), ""])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    for i, t in docs:
        mine = [*words(t), ""]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(mine), sum(counts[w] > 0 for w in mine), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine), rel_tol=1e-9)
        assert r.score < 0


def test_learning_helps_on_held_out_texts(spark, monkeypatch):
    """Held-out words become likelier with learning."""
    sf = "/root/testdata/sf0.001"
    mean = {}
    for rounds in (0, 3):
        monkeypatch.setattr(L.score, "__defaults__", ("doc_id", "text", None, rounds, L.HEAVY))
        rows = [r for r in L.op12(spark, sf).collect() if r.held_out]
        mean[rounds] = sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert mean[0] < mean[3]
