"""Packing documents into sequences in their order, with the cuts chosen by dynamic programming.

The ids of the documents stand in one row, each document closed by an end id. A sequence is a run of at most
``length`` ids; cuts may stand at ends of documents or sentences, and inside a sentence only where it is long.
Cost of a sequence: its padding (none at ``length`` or at a smaller power of two), a small fee, and a penalty if it ends
inside a document or inside a sentence. With ``cost(j) = min over i (cost(i) + place(i)) + length - place(j)`` over
all cuts ``i`` at most ``length`` back, the minimum is kept in a monotone queue, so every cut enters and leaves it once;
exact powers of two are looked up.

Each task packs the documents it reads, ``block_bytes`` of text at a time, without any shuffle; the order is that of the
table. A task that is run again reads the same rows in the same order, as long as ``docs`` is read from files; write other
tables first. Null text is empty: its only id is the end id. Repeated rows are packed as often as they come. Other
columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.registry import query, table
from lexloom.llm.tokens import encoder
from lexloom.llm.words import chunks


@dataclass(frozen=True)
class Packing:
    """Sizes in ids; penalties in ids of padding."""

    length: int = 1024
    end_id: int = 0
    least_power: int = 64
    fee: int = 8
    inside_document: int = 2
    inside_sentence: int = 8
    longest_gap: int = 32
    block_bytes: int = 2 << 20
    path: str | None = None


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end, from 0 on, and the penalty of each."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    says = ends[ids]
    says[:-1] &= ~says[1:]  # of several marks in a row the last ends the sentence
    penalty[1:][says] = how.inside_document
    penalty[doc_ends] = 0
    penalty[0] = 0
    places = np.flatnonzero(penalty >= 0)
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > how.longest_gap)
    if len(wide):
        step = how.longest_gap
        extra = np.concatenate([np.arange(places[w] + step, places[w + 1], step) for w in wide])
        penalty[extra] = how.inside_sentence
        places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def choose_cuts(places: np.ndarray, penalty: np.ndarray, how: Packing) -> list[int]:
    """The cheapest rising list of places from the first to the last, at most ``length`` apart."""
    n = len(places)
    spot = np.full(int(places[-1]) + 1, -1, np.int64)
    spot[places] = np.arange(n)
    exact: dict[int, list[int]] = {}
    power = how.least_power
    while power <= how.length:
        ahead = np.flatnonzero(places >= power)
        back = spot[places[ahead] - power]
        for j, i in zip(ahead[back >= 0].tolist(), back[back >= 0].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
        power *= 2
    at, fine, length, fee = places.tolist(), penalty.tolist(), how.length, how.fee
    cost, origin = [0] * n, [0] * n
    best: deque[int] = deque([0])
    worth = [0] * n  # cost(i) + place(i), rising from the head of the queue
    for j in range(1, n):
        here = at[j]
        while here - at[best[0]] > length:
            best.popleft()
        i = best[0]
        least = worth[i] + length - here
        for k in exact.get(j, ()):
            if cost[k] < least:
                i, least = k, cost[k]
        total = least + fine[j] + fee
        cost[j], origin[j] = total, i
        w = worth[j] = total + here
        while best and worth[best[-1]] >= w:
            best.pop()
        best.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(origin[cuts[-1]])
    return [at[c] for c in reversed(cuts)]


def _pack(texts: list[str | None], how: Packing) -> dict[str, np.ndarray | list]:
    """Pieces of the texts: the number of the text, start and length in it, sequence and offset."""
    coder = encoder(how.path)
    ids, starts = coder.encode(texts)
    ids = np.insert(ids, starts[1:], np.uint32(how.end_id))
    starts = starts + np.arange(len(starts))
    cuts = np.array(choose_cuts(*cut_places(ids, starts[1:], coder.ends_of_sentences, how), how))
    begins = np.union1d(cuts[:-1], starts[:-1])
    ends = np.append(begins[1:], len(ids))
    text = np.searchsorted(starts, begins, "right") - 1
    sequence = np.searchsorted(cuts, begins, "right") - 1
    view = memoryview(ids.astype("<u4").tobytes())
    pieces = [view[4 * b:4 * e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
    return {
        "text": text, "start": begins - starts[text], "length": ends - begins, "pieces": pieces,
        "doc_tokens": np.diff(starts)[text], "sequence": sequence, "offset": begins - cuts[sequence],
    }


def pack(docs: DataFrame, how: Packing = Packing(), key: str = "doc_id", with_ids: bool = False) -> DataFrame:  # noqa: B008
    """One row for each piece: where it lies in its document and in its sequence, and the check sum of its ids.

    ``with_ids`` adds ``ids``, the piece's ids as little-endian 32-bit numbers. Sequences are numbered within each task, with
    the task's number above.
    """
    kind = docs.schema[key].dataType
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"{key} {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in numbers)
    schema += ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in chunks(texts, how.block_bytes):
                p = _pack(texts[i:j], how)
                columns = {
                    "start": p["start"], "length": p["length"], "ids_crc32": [zlib.crc32(x) for x in p["pieces"]],
                    "doc_tokens": p["doc_tokens"], "sequence_id": sequence + p["sequence"], "offset": p["offset"],
                }
                out = {key: names.take(pa.array(p["text"] + i))}
                out |= {c: pa.array(columns[c], pa.int64()) for c in numbers}
                if with_ids:
                    out["ids"] = pa.array([bytes(x) for x in p["pieces"]], pa.binary())
                sequence += int(p["sequence"][-1]) + 1
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(key, F.col("text")).mapInArrow(run, schema)


@query("op8_pack_in_order")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
