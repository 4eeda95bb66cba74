"""Quality by weak supervision.

Rules on simple measures of a text vote good, bad or abstain. No rule rejects a text by itself: how often
each rule is right among good and among bad texts is estimated from all votes by expectation-maximisation
(no labels), and a text is kept if the posterior probability of being good reaches a threshold.

The estimate needs only how often each pattern of votes occurs. With ``r`` rules there are at most ``3 ** r``
patterns, whatever the number of texts, so the counts are a bounded table and the driver iterates over them.

Null and empty texts have no words: measures 0, rejected by the base rule. Repeated rows are judged alike;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.registry import query, table
from lexloom.llm.words import chunks, covered, gram_hashes, mix, number_words, utf8
from lexloom.sources.store import materialise

SYMBOLS = b"#*$%&|<>"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
REPEAT_WINDOW = 5
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_marks",
    "n_distinct",
]
GOOD, BAD, ABSTAIN = 2, 1, 0


def measure_texts(texts: Sequence[bytes | None]) -> dict[str, np.ndarray]:
    """The measures of whole texts, one array for each."""
    n = len(texts)
    whole = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    ends = np.cumsum([len(t or b"") for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]) if n else ends

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[begins]

    def among(chars: bytes) -> np.ndarray:
        has = np.zeros(256, bool)
        has[list(chars)] = True
        return has[whole]

    words = number_words(texts)
    per_text = words.text_of
    tally = lambda flags: np.bincount(per_text[flags], minlength=n).astype(np.int64)
    at = words.windows(REPEAT_WINDOW)
    key = mix(gram_hashes(words.hashes(), at, REPEAT_WINDOW) + per_text[at].astype(np.uint64))
    _, back, often = np.unique(key, return_inverse=True, return_counts=True)
    repeated = covered(at[often[back] > 1], REPEAT_WINDOW, len(words.ids))
    upper = np.fromiter((len(w) > 1 and w.isupper() for w in words.vocab), bool, len(words.vocab))
    lines = [[x for x in (t or b"").split(b"\n") if x.strip()] for t in texts]
    distinct = np.unique(per_text * max(1, len(words.vocab)) + words.ids) // max(1, len(words.vocab))
    return {
        "n_words": np.diff(words.starts),
        "word_chars": count((whole & 0xC0) != 0x80) - count(among(SPACE_BYTES)),
        "n_symbols": count(among(SYMBOLS)),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": tally(repeated),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_upper_words": tally(upper[words.ids] if len(upper) else np.zeros(0, bool)),
        "n_marks": count(among(b"!")),
        "n_distinct": np.bincount(distinct.astype(np.int64), minlength=n).astype(np.int64),
    }


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(text: pa.Array) -> pa.Array:
    """Counts of a whole text; null counts as empty."""
    texts = utf8(text)
    parts = [measure_texts(texts[i:j]) for i, j in chunks(texts)] or [measure_texts([])]
    columns = [pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64)) for m in MEASURES]
    return pa.StructArray.from_arrays(columns, MEASURES)


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        say = F.when(self.bad, BAD).when(self.good, GOOD).otherwise(ABSTAIN)
        return F.coalesce(say, F.lit(ABSTAIN))


def default_rules() -> list[Rule]:
    c, n = F.col, F.col("n_words")
    share = lambda x, y: F.try_divide(c(x), c(y) if isinstance(y, str) else y)
    return [
        Rule("length", n >= 30, n < 10),
        Rule("word_size", share("word_chars", n).between(3, 10), ~share("word_chars", n).between(2.2, 14)),
        Rule("symbols", share("n_symbols", n) <= 0.02, share("n_symbols", n) > 0.1),
        Rule("lines", share("n_dup_lines", "n_lines") <= 0.05, share("n_dup_lines", "n_lines") > 0.3),
        Rule("repeats", share("n_repeat_words", n) <= 0.05, share("n_repeat_words", n) > 0.2),
        Rule("capitals", share("n_upper_words", n) <= 0.05, share("n_upper_words", n) > 0.2),
        Rule("marks", share("n_marks", n) <= 0.02, share("n_marks", n) > 0.1),
        Rule("variety", (n >= 20) & (share("n_distinct", n) >= 0.3), (n >= 50) & (share("n_distinct", n) < 0.1)),
    ]


@dataclass(frozen=True)
class Estimate:
    """Share of good texts, and for each rule how often it is right on good and on bad texts."""

    prior: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]
    rounds: int

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a text with these votes is good."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for vote, g, b in zip(votes, self.right_on_good, self.right_on_bad, strict=True):
            odds = odds + F.when(vote == GOOD, float(np.log(g / (1 - b)))).when(
                vote == BAD, float(np.log((1 - g) / b))
            ).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(
    patterns: np.ndarray, counts: np.ndarray, prior: float = 0.85, rounds: int = 200, tolerance: float = 1e-9,
    least_on_good: float = 0.99,
) -> Estimate:
    """Expectation-maximisation over vote patterns (rows) and how many texts have each.

    A rule starts as right on most good texts and on some bad ones, which fixes which class is the good one.
    Counts are smoothed by a weak belief, so that no rule becomes certain. Rules are written to spare good texts:
    one is taken to be right on at least ``least_on_good`` of them, so that a fault which only one rule sees
    is not mistaken for a habit of good texts.
    """
    r = patterns.shape[1]
    good, bad = np.full(r, least_on_good), np.full(r, 0.4)
    says_good, says_bad = patterns == GOOD, patterns == BAD
    done = 0
    for done in range(1, rounds + 1):
        odds = np.log(prior / (1 - prior)) + says_good @ np.log(good / (1 - bad)) + says_bad @ np.log((1 - good) / bad)
        p = 1 / (1 + np.exp(-odds))
        w, v = counts * p, counts * (1 - p)
        new_good = np.maximum((w @ says_good + 9.5) / (w @ (says_good | says_bad) + 10), least_on_good)
        new_bad = (v @ says_bad + 4) / (v @ (says_good | says_bad) + 10)
        new_prior = float((w.sum() + 8.5) / (counts.sum() + 10))
        moved = max(np.abs(new_good - good).max(), np.abs(new_bad - bad).max(), abs(new_prior - prior))
        good, bad, prior = new_good, new_bad, new_prior
        if moved < tolerance:
            break
    return Estimate(prior, tuple(map(float, good)), tuple(map(float, bad)), done)


def fit(measured: DataFrame, rules: list[Rule]) -> Estimate:
    """Estimate from the votes on all rows that pass the base; the patterns number at most ``3 ** len(rules)``.

    The estimate is only asked about those rows, and others would make their faults the only ones looked for.
    """
    votes = [rule.vote().alias(rule.name) for rule in rules]
    rows = measured.where(~base_failed()).select(*votes).groupBy(*[rule.name for rule in rules]).count().collect()
    rows = sorted(tuple(row) for row in rows)
    seen = np.array(rows, np.int64).reshape(len(rows), len(rules) + 1)
    return estimate(seen[:, :-1], seen[:, -1].astype(float))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(measured: DataFrame, found: Estimate, rules: list[Rule], threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``p_good`` and ``kept`` to rows with measures."""
    return (
        measured.withColumn("base_failed", base_failed())
        .withColumn("p_good", found.posterior([rule.vote() for rule in rules]))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )


def measured_by_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, measures("text").alias("m")).select(key, "m.*")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with the columns they came with.

    Texts are measured twice (once for the estimate, once to judge) and never shuffled.
    """
    rules = default_rules()
    found = fit(docs.select(measures("text").alias("m")).select("m.*"), rules)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), measures("text").alias("m"))
    return judge(held.select("row", "m.*"), found, rules, threshold).where("kept").select("row.*")


@query("op5_quality_votes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = default_rules()
    measured = materialise(measured_by_id(table(spark, sf_dir, "documents")), "measures")
    judged = judge(measured, fit(measured, rules), rules)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, "p_good")
