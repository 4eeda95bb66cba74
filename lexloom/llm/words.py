"""Words of texts: the separators are the six ASCII spaces, as ``bytes.split`` has them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text handled at once inside a task; bounds the arrays, not the texts.
CHUNK_BYTES = 1 << 20


def words_of(text: Column) -> Column:
    """The words of a text as an array, in Spark's own functions; null text has none."""
    flat = F.translate(text, SPACES, " " * len(SPACES))
    return F.coalesce(F.array_remove(F.split(flat, " "), ""), F.array().cast("array<string>"))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(texts: Sequence[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a single longer text is a range of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Words:
    """Words of several texts in one array of dense numbers."""

    ids: np.ndarray
    starts: np.ndarray  # first word of each text, with the total at the end
    vocab: list[bytes]

    @property
    def text_of(self) -> np.ndarray:
        """The number of its text for each word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        table = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocab), np.uint64, len(self.vocab))
        return table[self.ids] if len(table) else np.zeros(0, np.uint64)

    def windows(self, width: int) -> np.ndarray:
        """Where a window of ``width`` words of one text starts, as word numbers."""
        left = np.repeat(self.starts[1:], np.diff(self.starts)) - np.arange(len(self.ids))
        return np.flatnonzero(left >= width)


def number_words(texts: Sequence[bytes | None]) -> Words:
    known = _Numbers()
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words = text.split() if text else []
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        starts[i + 1] = starts[i] + len(words)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Words(ids, starts, list(known))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9E3779B97F4A7C15), (32, 1)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
    return x


def gram_hashes(word_hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each place on."""
    out = np.zeros(len(at), np.uint64)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(width):
            out += word_hashes[at + j] * factors[j]
    return mix(out)


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of ``width`` from one of the starts."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, total), -1)
    return np.cumsum(step[:-1]) > 0
