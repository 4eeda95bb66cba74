"""A quality score by a factorisation machine.

Inputs of a text are its hashed words (counts, scaled to length one), the bins of its structure (length, repeats, symbols, capitals, lines
...) and of its make-up in bytes. The score is a logistic of a bias, one weight for each input, and the interactions
of all pairs of inputs through vectors of rank ``rank``, which the sum-of-squares identity gives in linear time:
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``.

The weights are learned on a sample of at most ``sample`` labelled rows (those with the least hash of their id), which bounds what the driver
holds; scoring reads every text whole. The model has a fixed size. Labels, language, source and ids are no inputs. Null
and empty texts are scored from their structure. Without labels of both kinds the score is the share of good labels,
or 0.5.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.quality import measure_texts
from lexloom.llm.registry import query, table
from lexloom.llm.words import chunks, number_words, utf8

RATIO = (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
BINS = 24


@dataclass(frozen=True)
class Machine:
    """Size of the machine, and how it is trained."""

    buckets: int = 1 << 16
    rank: int = 8
    sample: int = 10_000
    epochs: int = 8
    least_steps: int = 2000
    batch: int = 64
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 3


@dataclass
class Weights:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


@dataclass
class Inputs:
    """Rows of inputs one after the other: ``starts`` where each begins, with the total at the end."""

    index: np.ndarray
    value: np.ndarray
    starts: np.ndarray


def _structure(texts: Sequence[bytes | None]) -> np.ndarray:
    """The bin of each property of each text."""
    m = measure_texts(texts)
    n = np.maximum(m["n_words"], 1)
    size = np.array([len(t or b"") for t in texts])
    wide = np.array([len(t) - len(t.decode()) if t else 0 for t in texts])
    share = lambda x, y: np.digitize(x / np.maximum(y, 1), RATIO)
    columns = [
        np.minimum(np.log2(m["n_words"] + 1).astype(np.int64), BINS - 1),
        np.digitize(m["word_chars"] / n, (2, 3, 4, 5, 6, 7, 8, 10, 14)),
        share(m["n_symbols"], n), share(m["n_dup_lines"], m["n_lines"]), share(m["n_repeat_words"], n),
        share(m["n_upper_words"], n), share(m["n_marks"], n),
        np.digitize(m["n_distinct"] / n, (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)),
        np.digitize(m["n_words"] / np.maximum(m["n_lines"], 1), (2, 4, 8, 16, 32, 64, 128)),
        share(wide, size),
    ]
    return np.stack(columns, axis=1).astype(np.int64)


def inputs(texts: Sequence[bytes | None], how: Machine) -> Inputs:
    """Inputs of whole texts; structure comes first in the numbering, words after it."""
    bins = _structure(texts)
    bins += np.arange(bins.shape[1]) * BINS
    first = bins.shape[1] * BINS
    words = number_words([t.lower() if t else t for t in texts])
    bucket = (words.hashes() % np.uint64(how.buckets)).astype(np.int64)
    key, count = np.unique(words.text_of * how.buckets + bucket, return_counts=True)
    text = key // how.buckets
    norm = np.sqrt(np.bincount(text, count.astype(float) ** 2, len(texts)))
    value = count / norm[text] if len(text) else np.zeros(0)
    who = np.concatenate([np.repeat(np.arange(len(texts)), bins.shape[1]), text])
    order = np.argsort(who, kind="stable")
    index = np.concatenate([bins.ravel(), key % how.buckets + first])[order]
    starts = np.searchsorted(who[order], np.arange(len(texts) + 1))
    return Inputs(index, np.concatenate([np.ones(bins.size), value])[order].astype(np.float32), starts)


def n_inputs(how: Machine) -> int:
    return _structure([]).shape[1] * BINS + how.buckets


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over the rows; every row has inputs."""
    return np.add.reduceat(x, starts[:-1], axis=0)


def raw_scores(x: Inputs, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The scores before the logistic, and the sums of vectors."""
    if len(x.starts) == 1:
        return np.zeros(0), np.zeros((0, w.factors.shape[1]))
    vx = w.factors[x.index] * x.value[:, None]
    total = _sums(vx, x.starts)
    pairs = 0.5 * ((total * total).sum(axis=1) - _sums((vx * vx).sum(axis=1), x.starts))
    return w.bias + _sums(w.linear[x.index] * x.value, x.starts) + pairs, total


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def rows_of(x: Inputs, rows: np.ndarray) -> Inputs:
    sizes = np.diff(x.starts)[rows]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(x.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
    return Inputs(x.index[at], x.value[at], starts)


def train(x: Inputs, label: np.ndarray, how: Machine) -> Weights:
    """Log loss by small batches, with a step for each weight that shrinks with its gradients so far.

    Both labels weigh the same as a whole, so a rare one is learned too. Small samples are gone through more often.
    """
    draw = np.random.Generator(np.random.PCG64(how.seed))
    n = n_inputs(how)
    share = float(label.mean()) if len(label) else 0.5
    w = Weights(0.0, np.zeros(n), draw.normal(0, 0.02, (n, how.rank)))
    if share in (0.0, 1.0) or not len(label):
        w.bias = 30.0 * (2 * share - 1) if len(label) else 0.0
        w.factors[:] = 0
        return w
    weight = np.where(label > 0.5, 0.5 / share, 0.5 / (1 - share))
    seen_linear, seen_factors = np.full(n, 1e-2), np.full((n, how.rank), 1e-2)
    for _ in range(max(how.epochs, -(-how.least_steps * how.batch // len(label)))):
        order = draw.permutation(len(label))
        for k in range(0, len(order), how.batch):
            rows = order[k:k + how.batch]
            part = rows_of(x, rows)
            z, total = raw_scores(part, w)
            error = weight[rows] * (_logistic(z) - label[rows]) / len(rows)
            w.bias -= how.rate * 0.1 * float(error.sum())
            each = np.repeat(error, np.diff(part.starts)) * part.value
            held, back = np.unique(part.index, return_inverse=True)
            g = np.bincount(back, each, len(held)) + how.decay * w.linear[held]
            seen_linear[held] += g * g
            w.linear[held] -= how.rate * g / np.sqrt(seen_linear[held])
            slope = each[:, None] * (np.repeat(total, np.diff(part.starts), axis=0) - w.factors[part.index] * part.value[:, None])
            gv = np.stack([np.bincount(back, slope[:, f], len(held)) for f in range(how.rank)], axis=1)
            gv += how.decay * w.factors[held]
            seen_factors[held] += gv * gv
            w.factors[held] -= how.rate * 0.5 * gv / np.sqrt(seen_factors[held])
    return w


def held_out() -> Column:
    """Rows that are never learned from: a fifth, by the check sum of the id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, how: Machine) -> Weights:
    """Learn from a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows

    @F.arrow_udf(T.StructType([T.StructField("index", T.BinaryType()), T.StructField("value", T.BinaryType())]))
    def packed(text: pa.Array) -> pa.Array:
        held, out = utf8(text), []
        for i, j in chunks(held):
            x = inputs(held[i:j], how)
            for a, b in zip(x.starts[:-1], x.starts[1:], strict=True):
                out.append((x.index[a:b].astype("<u4").tobytes(), x.value[a:b].astype("<f4").tobytes()))
        return pa.StructArray.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], ["index", "value"])

    sample = texts.select("doc_id", "quality", packed("text").alias("x")).select("doc_id", "quality", "x.*").toArrow()
    sample = sample.sort_by("doc_id")
    index = [np.frombuffer(b, "<u4").astype(np.int64) for b in sample["index"].to_pylist()]
    value = [np.frombuffer(b, "<f4") for b in sample["value"].to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(np.int64)
    x = Inputs(np.concatenate([np.zeros(0, np.int64), *index]), np.concatenate([np.zeros(0, np.float32), *value]), starts)
    return train(x, sample["quality"].to_numpy().astype(float), how)


def scorer(w: Weights, how: Machine):
    """A column function for the score of a text."""
    small = Weights(w.bias, w.linear.astype(np.float32), w.factors.astype(np.float32))

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        held = utf8(text)
        parts = [_logistic(raw_scores(inputs(held[i:j], how), small)[0].astype(float)) for i, j in chunks(held)]
        return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return score


@query("op10_fm_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    how, docs = Machine(), table(spark, sf_dir, "documents")
    score = scorer(fit(docs, table(spark, sf_dir, "labels"), how), how)
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
