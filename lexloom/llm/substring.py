"""Exact substring deduplication with suffix trees partitioned by prefixes.

Every start of a window (``width`` words of one document) is a suffix, of which the tree needs no more than the window. A
suffix goes to a partition by a prefix of it, whose length differs: it ends with the ``anchor`` words whose hash is
the least in the window. Equal windows have equal prefixes, neighbouring windows mostly share their anchor, so a run of suffixes
travels as one piece of text and not as a copy for each suffix.

1. Every group of documents asks how often each anchor occurs in the corpus. A suffix whose anchor occurs once is a
   leaf right below it and goes nowhere.
2. The other suffixes go to the partition of their anchor, as text. There the subtree is built level by level (ranks of
   prefixes of 1, 2, 4, ... words, doubled up to the window): a rank at the depth of the window is a node, and a node with two
   leaves or more is a repeat; leaves in a row make the maximal repeats.
3. An anchor with more than ``heavy`` occurrences would make a partition too large for memory. Its suffixes get a longer
   prefix, the whole window, sent once for a group as a 128-bit fingerprint.
4. The answers mark the windows, and the words they cover are removed.

All occurrences are removed, also the first. Windows are judged on the input. Null and empty texts, and those of fewer
words than a window, lose nothing. Repeated rows are occurrences of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import exchange as X
from lexloom.llm.registry import query, table
from lexloom.llm.words import Words, covered, gram_hashes, mix, number_words, utf8


@dataclass(frozen=True)
class Repeats:
    """Words in a window and in an anchor, occurrences from which an anchor's suffixes are split further."""

    width: int = 35
    anchor: int = 8
    heavy: int = 4096
    docs_per_group: int = X.DOCS_PER_GROUP


@dataclass
class Suffixes:
    """The suffixes of a group: ``at`` the words where windows start, ``anchor`` where the anchor of each is."""

    words: Words
    hashes: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    anchor_hash: np.ndarray


def suffixes(texts: list[bytes | None], how: Repeats) -> Suffixes:
    words = number_words(texts)
    hashes = words.hashes()
    keys = np.full(len(hashes) + how.width, np.iinfo(np.uint64).max, np.uint64)
    places = words.windows(how.anchor)
    keys[places] = gram_hashes(hashes, places, how.anchor)
    best = np.arange(len(hashes))
    span, reach = 1, how.width - how.anchor + 1

    def least(step: int) -> np.ndarray:
        right = best[np.minimum(np.arange(len(best)) + step, len(best) - 1)] if len(best) else best
        return np.where(keys[best] <= keys[right], best, right)

    while 2 * span <= reach:
        best = least(span)
        span *= 2
    if span < reach:
        best = least(reach - span)
    at = words.windows(how.width)
    return Suffixes(words, hashes, at, best[at], keys[best[at]])


def _count(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


@dataclass
class Asked:
    """What a group sends to a bucket: pieces as (first, last) window numbers, and windows that are sent as fingerprints."""

    pieces: np.ndarray
    prints: np.ndarray
    often: np.ndarray
    of_print: list[np.ndarray]


def to_ask(s: Suffixes, how: Repeats, counts: X.Counts, loads: dict[int, bytes]) -> dict[int, Asked]:
    """By bucket, the suffixes whose anchor occurs again."""
    keys, back = np.unique(s.anchor_hash, return_inverse=True)
    often = counts.read(keys, loads)[back]
    top = lambda h: (mix(h) >> np.uint64(64 - counts.bits)).astype(np.int64)
    light = np.flatnonzero((often > 1) & (often <= how.heavy))
    begins = light[np.diff(s.anchor[light], prepend=-1) != 0]
    ends = light[np.diff(s.anchor[light], append=-1) != 0]
    out: dict[int, Asked] = {}

    def slot(bucket: int) -> Asked:
        empty = np.zeros((0, 2), np.int64)
        return out.setdefault(bucket, Asked(empty, np.zeros((0, 2), np.uint64), np.zeros(0, bool), []))

    where = top(s.anchor_hash[begins])
    order = np.argsort(where, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        if len(part):
            slot(int(where[part[0]])).pieces = np.stack([begins[part], ends[part]], axis=1)

    heavy = np.flatnonzero(often > how.heavy)
    if len(heavy):
        one = gram_hashes(s.hashes, s.at[heavy], how.width)
        two = gram_hashes(mix(s.hashes), s.at[heavy], how.width)
        order = np.lexsort((two, one))
        one, two, heavy = one[order], two[order], heavy[order]
        first = np.flatnonzero(np.diff(one, prepend=~one[:1]) | np.diff(two, prepend=~two[:1]))
        members = np.split(heavy, first[1:])
        for bucket, part in X.by_range(one[first], counts.bits):
            held = slot(bucket)
            held.prints = np.stack([one[first][part], two[first][part]], axis=1)
            held.of_print = members[part]
            held.often = np.array([len(m) > 1 for m in held.of_print])
    return out


def pack_letter(s: Suffixes, asked: Asked, how: Repeats) -> bytes:
    begin = s.at[asked.pieces[:, 0]]
    sizes = s.at[asked.pieces[:, 1]] + how.width - begin
    vocab, ids = s.words.vocab, s.words.ids
    text = b" ".join(b" ".join([vocab[i] for i in ids[b:b + n].tolist()]) for b, n in zip(begin, sizes, strict=True))
    head = np.array([len(sizes), len(asked.prints)], "<u4").tobytes()
    return b"".join([
        head, sizes.astype("<u4").tobytes(), asked.prints.astype("<u8").tobytes(),
        np.packbits(asked.often).tobytes(), text,
    ])


def _open(load: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    n, m = np.frombuffer(load, "<u4", 2).tolist()
    a = 8 + 4 * n
    b = a + 16 * m
    c = b + -(-m // 8)
    often = np.unpackbits(np.frombuffer(load[b:c], np.uint8), count=m).astype(bool)
    return np.frombuffer(load, "<u4", n, 8).astype(np.int64), np.frombuffer(load[a:b], "<u8").reshape(m, 2), often, load[c:].split()


def subtree(ids: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` of each suffix, where ``room`` (words left in its piece) allows; else -1.

    Ranks of prefixes are doubled: the rank of ``2 d`` words is that of the pair of ranks of ``d`` words here and ``d``
    words on. Ranks rise with the order of the words' numbers, so they are the tree's nodes at that depth, from left to right.
    """
    rank, d = ids.astype(np.int64), 1

    def deeper(step: int) -> np.ndarray:
        held = np.flatnonzero(room >= d + step)
        out = np.full(len(rank), -1, np.int64)
        if len(held):
            both = rank[held] * (rank.max() + 1) + rank[held + step]
            out[held] = np.unique(both, return_inverse=True)[1]
        return out

    while 2 * d <= depth:
        rank = deeper(d)
        d *= 2
    return deeper(depth - d) if d < depth else rank


def answer_repeats(loads: list[bytes], how: Repeats) -> list[bytes]:
    """For every letter, a bit for each suffix of its pieces and for each fingerprint: whether it occurs again."""
    letters = [_open(x) for x in loads]
    sizes = np.concatenate([x for x, _, _, _ in letters])
    text = number_words([b" ".join(w) for _, _, _, w in letters])
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text.ids))
    nodes = subtree(text.ids, room, how.width)
    leaf = np.flatnonzero(nodes >= 0)
    again = np.zeros(len(nodes), bool)
    again[leaf] = np.bincount(nodes[leaf])[nodes[leaf]] > 1
    prints = np.concatenate([p for _, p, _, _ in letters])
    _, back = np.unique(prints, axis=0, return_inverse=True)
    weight = np.concatenate([np.where(o, 2, 1) for _, _, o, _ in letters])
    many = (np.bincount(back.ravel(), weight) > 1)[back.ravel()] if len(prints) else np.zeros(0, bool)
    out, at = [], 0
    for k, (_, p, _, _) in enumerate(letters):
        mine = leaf[(leaf >= text.starts[k]) & (leaf < text.starts[k + 1])]
        out.append(np.packbits(np.concatenate([again[mine], many[at:at + len(p)]])).tobytes())
        at += len(p)
    return out


def repeated_words(s: Suffixes, asked: dict[int, Asked], loads: dict[int, bytes], how: Repeats) -> np.ndarray:
    """Which words a repeated window covers."""
    hit = np.zeros(len(s.at), bool)
    for bucket, what in asked.items():
        windows = [np.arange(a, b + 1) for a, b in what.pieces.tolist()]
        sent = np.concatenate([np.zeros(0, np.int64), *windows])
        bits = np.unpackbits(np.frombuffer(loads[bucket], np.uint8), count=len(sent) + len(what.prints)).astype(bool)
        hit[sent] = bits[:len(sent)]
        for member, yes in zip(what.of_print, bits[len(sent):].tolist(), strict=True):
            hit[member] = yes
    return covered(s.at[hit], how.width, len(s.words.ids))


def in_fixed_order(texts: list[bytes | None]) -> tuple[list[bytes | None], np.ndarray]:
    """The texts sorted, and where each row stands among them.

    The parts of a shuffle arrive in any order, so a group may have its rows in another one at its next visit. Answers go by
    the numbers of windows, which are then those of other windows; sorted texts have the same numbers each time.
    """
    order = np.array(sorted(range(len(texts)), key=lambda i: texts[i] or b""), np.int64)
    return [texts[i] for i in order.tolist()], np.argsort(order)


def without_repeats(
    docs: DataFrame, key: str = "doc_id", how: Repeats = Repeats(), leave_whole: bool = False  # noqa: B008
) -> DataFrame:
    """All columns of ``docs``, and ``kept_text`` (the words that stay, joined by blanks), ``n_words``, ``n_removed``.

    With ``leave_whole`` a text that loses nothing is returned as it came.
    """
    others = [c for c in docs.columns if c not in (key, "text")]
    rows = docs.select(
        F.col(key).alias("id"), F.col("text").cast("string").alias("text"),
        *[F.col(f"`{c}`").alias(f"other{i}") for i, c in enumerate(others)],
    )
    rows, groups = X.in_groups(rows, "id", "text", per_group=how.docs_per_group)
    counts = X.Counts(X.range_bits(groups))
    far = 1 << counts.bits  # the second answers have their buckets above the first

    def about_anchors(group: pa.Table) -> list[tuple[int, bytes]]:
        s = suffixes(in_fixed_order(utf8(group["text"]))[0], how)
        _, first = np.unique(s.anchor, return_index=True)
        return counts.ask(*_count(s.anchor_hash[first]))

    def about_suffixes(group: pa.Table, loads: dict[int, bytes]) -> pa.Table:
        s = suffixes(in_fixed_order(utf8(group["text"]))[0], how)
        asked = to_ask(s, how, counts, loads)
        letters = [pack_letter(s, x, how) for x in asked.values()]
        g = group["g"][0].as_py() if len(group) else 0
        return pa.table({
            "bucket": pa.array(list(asked), pa.int32()), "g": pa.array([g] * len(asked), pa.int64()),
            "load": pa.array(letters, pa.binary()),
        })

    def reply(bucket: pa.Table) -> pa.Table:
        loads = pa.array(answer_repeats(bucket["load"].to_pylist(), how), pa.binary())
        return pa.table({"bucket": pa.array([b + far for b in bucket["bucket"].to_pylist()], pa.int32()), "g": bucket["g"], "load": loads})

    def result(group: pa.Table, loads: dict[int, bytes]) -> pa.Table:
        texts, place = in_fixed_order(utf8(group["text"]))
        s = suffixes(texts, how)
        asked = to_ask(s, how, counts, loads)
        gone = repeated_words(s, asked, {b - far: x for b, x in loads.items() if b >= far}, how)
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[s.words.starts[1:]] - sums[s.words.starts[:-1]]
        vocab, ids = s.words.vocab, s.words.ids
        kept = []
        for k, (a, b) in enumerate(zip(s.words.starts[:-1].tolist(), s.words.starts[1:].tolist(), strict=True)):
            left = ids[a:b][~gone[a:b]].tolist()
            kept.append(texts[k] if leave_whole and not removed[k] else b" ".join([vocab[i] for i in left]))
        out = group.drop_columns(["g", "text"])
        out = out.append_column("kept_text", pa.array([kept[i] for i in place.tolist()], pa.binary()).cast(pa.string()))
        out = out.append_column("n_words", pa.array(np.diff(s.words.starts)[place], pa.int64()))
        return out.append_column("n_removed", pa.array(removed[place], pa.int64()))

    first = X.ask(rows, about_anchors, counts.answer)
    letter = "bucket int, g bigint, load binary"
    sent = X.with_answers(rows, first, about_suffixes, letter)
    second = sent.groupBy("bucket").applyInArrow(reply, letter)
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.drop("g", "text").schema)
    found = X.with_answers(rows, first.unionByName(second), result, schema + "kept_text string, n_words bigint, n_removed bigint")
    return found.select(
        F.col("id").alias(key), *[F.col(f"other{i}").alias(c) for i, c in enumerate(others)], "kept_text", "n_words", "n_removed"
    )


def cut_repeats(docs: DataFrame, key: str = "doc_id", how: Repeats = Repeats()) -> DataFrame:  # noqa: B008
    """The documents with repeated passages taken out of their texts; texts without one stay as they are."""
    names = {c: f"column{i}" for i, c in enumerate(docs.columns) if c not in (key, "text")}
    own = docs.select(F.col(f"`{key}`"), "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = without_repeats(own, key, how, leave_whole=True)
    new = {key: F.col(f"`{key}`"), "text": F.col("kept_text")} | {c: F.col(n) for c, n in names.items()}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(new["n_chars"])
    return found.select(*[new[c].alias(c) for c in docs.columns])


_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM d),
win AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM d WHERE len(w) >= 35),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (
  SELECT word.r, word.i, word.word,
         count(again.i) OVER (PARTITION BY word.r ORDER BY word.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS out
  FROM word LEFT JOIN again ON again.r = word.r AND again.i = word.i),
kept AS (SELECT r, count(*) FILTER (out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT out) AS text FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""


@query("op3_substring_repeats", _SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
