"""Questions about all n-grams of a table, asked by groups of documents and answered by ranges of hashes.

Counting n-grams as rows would shuffle a row for each word of the corpus. Here a group of some hundred documents sends one
packed list for each range of hashes, a range is answered as a whole, and the answers go back to the groups:

    documents -> groups -(packed lists)-> ranges -(packed answers)-> groups

Both visits to the groups read one shuffle of the documents, as the exchange is the same. Groups and ranges grow in
number with the table, not in size. Every step is a grouped function of Spark over Arrow tables, so a lost
executor costs the repetition of its groups only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCS_PER_GROUP = 512
_LETTER = "bucket int, g bigint, load binary"


def in_groups(docs: DataFrame, *keys: str, per_group: int = DOCS_PER_GROUP) -> tuple[DataFrame, int]:
    """Add ``g``, the group of each row by its keys, and tell how many groups there are."""
    groups = max(1, -(-docs.count() // per_group))
    return docs.withColumn("g", F.pmod(F.xxhash64(*keys), F.lit(groups))), groups


def range_bits(groups: int) -> int:
    """Bits of a hash that name its range: about as many ranges as groups."""
    return max(1, (groups - 1).bit_length())


def ask(
    rows: DataFrame,
    question: Callable[[pa.Table], Iterable[tuple[int, bytes]]],
    answer: Callable[[list[bytes]], list[bytes]],
) -> DataFrame:
    """Answers ``(bucket, g, load)``: ``question`` gives a group's packed lists, ``answer`` those of one bucket in turn."""
    def send(group: pa.Table) -> pa.Table:
        g = group["g"][0].as_py()
        letters = list(question(group))
        return _letters([b for b, _ in letters], [g] * len(letters), [x for _, x in letters])

    def reply(bucket: pa.Table) -> pa.Table:
        loads = answer(bucket["load"].to_pylist())
        return _letters(bucket["bucket"], bucket["g"], loads)

    return rows.groupBy("g").applyInArrow(send, _LETTER).groupBy("bucket").applyInArrow(reply, _LETTER)


def _letters(bucket: object, g: object, load: list[bytes]) -> pa.Table:
    arrays = [pa.array(x, t) if isinstance(x, list) else x for x, t in ((bucket, pa.int32()), (g, pa.int64()))]
    return pa.table({"bucket": arrays[0], "g": arrays[1], "load": pa.array(load, pa.binary())})


def with_answers(
    rows: DataFrame, answers: DataFrame, use: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str
) -> DataFrame:
    """Each group together with the answers to it, by bucket."""
    def read(group: pa.Table, letters: pa.Table) -> pa.Table:
        loads = dict(zip(letters["bucket"].to_pylist(), letters["load"].to_pylist(), strict=True))
        return use(group, loads)

    return rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(read, schema)


def by_range(hashes: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Cut rising hashes at the borders of ranges."""
    top = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(top, prepend=-1, append=1 << bits))
    return [(int(top[a]), slice(a, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


class Counts:
    """In how many documents each hash occurs, asked with five bytes for a hash besides its range.

    Two hashes that agree in all those bits get their sum, so a count is never too small.
    """

    def __init__(self, bits: int) -> None:
        self.bits = bits

    def ask(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes]]:
        """Packed lists for rising distinct hashes and their counts in the group."""
        out = []
        for bucket, part in by_range(hashes, self.bits):
            short = ((hashes[part] << np.uint64(self.bits)) >> np.uint64(24)).astype(">u8").view(np.uint8)
            planes = short.reshape(-1, 8)[:, 3:].T  # the leading bytes of rising numbers pack well together
            often = np.flatnonzero(counts[part] > 1).astype("<u4")
            head = np.array([planes.shape[1], len(often)], "<u4")
            much = np.minimum(counts[part][often], 2**32 - 1).astype("<u4")
            out.append((bucket, b"".join([head.tobytes(), planes.tobytes(), often.tobytes(), much.tobytes()])))
        return out

    @staticmethod
    def _unpack(load: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, m = np.frombuffer(load, "<u4", 2).tolist()
        planes = np.frombuffer(load, np.uint8, 5 * n, 8).reshape(5, n)
        short = np.zeros((n, 8), np.uint8)
        short[:, 3:] = planes.T
        counts = np.ones(n, np.int64)
        tail = np.frombuffer(load[8 + 5 * n:], "<u4")
        counts[tail[:m]] = tail[m:]
        return short.view(">u8").ravel().astype(np.uint64), counts

    @classmethod
    def answer(cls, loads: list[bytes]) -> list[bytes]:
        """For each list, a bit for each hash that occurs in several documents, then their counts (at most 65535)."""
        lists = [cls._unpack(x) for x in loads]
        whole = np.concatenate([x for x, _ in lists])
        keys, back = np.unique(whole, return_inverse=True)
        total = np.bincount(back, np.concatenate([c for _, c in lists]), len(keys)).astype(np.int64)[back]
        cut = np.cumsum([len(x) for x, _ in lists])[:-1]
        return [
            np.packbits(t > 1).tobytes() + np.minimum(t[t > 1], 65535).astype("<u2").tobytes()
            for t in np.split(total, cut)
        ]

    def read(self, hashes: np.ndarray, loads: dict[int, bytes]) -> np.ndarray:
        """The counts for the rising distinct hashes that were asked."""
        out = np.ones(len(hashes), np.int64)
        for bucket, part in by_range(hashes, self.bits):
            n = part.stop - part.start
            held = -(-n // 8)
            many = np.unpackbits(np.frombuffer(loads[bucket], np.uint8, held), count=n).astype(bool)
            out[part][many] = np.frombuffer(loads[bucket], "<u2", offset=held)
        return out
