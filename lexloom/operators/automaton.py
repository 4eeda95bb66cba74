"""Words of a lexicon found in texts by a prefix automaton that goes with the tasks.

A lexicon whose measured size is within ``Limit`` becomes a few sorted arrays on the driver, once for each job, and every task walks its
texts through them, all places of a batch in step. Only matches leave a task, as a column of the row they were found in: nothing
is shuffled. A larger lexicon stays a table; its callers then look substrings up by equality joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbols of texts that are walked at once.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Limit:
    """Words and symbols of a lexicon that goes with the tasks (about 24 bytes each, and the words themselves)."""

    words: int = 1 << 19
    symbols: int = 1 << 22


LIMIT = Limit()


def fits(words: DataFrame, symbols: Column, limit: Limit = LIMIT) -> bool:
    """Whether a lexicon (a row for each word, with its number of symbols) is small enough."""
    n, total = words.agg(F.count("*"), F.coalesce(F.sum(symbols), F.lit(0))).first()
    return n <= limit.words and total <= limit.symbols


@dataclass(frozen=True)
class Automaton:
    """A prefix tree: ``keys`` (node and symbol) rise, ``child`` is where they lead, ``word`` the number of what ends at a node."""

    alphabet: dict[str, int]
    keys: np.ndarray
    child: np.ndarray
    word: np.ndarray
    longest: int

    @classmethod
    def of(cls, words: Sequence[Sequence[str]]) -> Automaton:
        """Words are sequences of symbols and differ; empty ones are never found. Built level by level."""
        alphabet: dict[str, int] = {}
        flat = np.fromiter((alphabet.setdefault(s, len(alphabet)) for w in words for s in w), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        starts, size = np.cumsum(sizes) - sizes, max(1, len(alphabet))
        node, nodes = np.zeros(len(sizes), np.int64), 1
        keys, child, word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.full(1, -1)]
        longest = int(sizes.max(initial=0))
        for level in range(longest):
            longer = np.flatnonzero(sizes > level)
            step, back = np.unique(node[longer] * size + flat[starts[longer] + level], return_inverse=True)
            node[longer] = nodes + back
            keys.append(step)
            child.append(nodes + np.arange(len(step)))
            nodes += len(step)
            here = np.full(len(step), -1)
            ending = longer[sizes[longer] == level + 1]
            here[node[ending] - nodes + len(step)] = ending
            word.append(here)
        order = np.argsort(every := np.concatenate(keys))
        return cls(alphabet, every[order], np.concatenate(child)[order], np.concatenate(word), longest)

    def numbers(self, symbols: Sequence[str]) -> np.ndarray:
        """Numbers of symbols, -1 for those no word has."""
        return np.fromiter((self.alphabet.get(s, -1) for s in symbols), np.int64, len(symbols))

    def find(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All matches: place, length and word. ``ends`` tells for each place where its text ends."""
        found = [(np.zeros(0, np.int64),) * 3]
        at, node = np.flatnonzero(symbols >= 0), np.zeros(int((symbols >= 0).sum()), np.int64)
        size = max(1, len(self.alphabet))
        for length in range(1, self.longest + 1):
            last = at + length - 1
            inside = last < ends[at]
            at, node, last = at[inside], node[inside], last[inside]
            key = np.where(symbols[last] >= 0, node * size + symbols[last], -1)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            at, node = at[hit], self.child[place[hit]]
            word = self.word[node]
            whole = word >= 0
            found.append((at[whole], np.full(int(whole.sum()), length), word[whole]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts in a row, and where each text begins, with the end of the last one. Null is empty."""
    each = [t or "" for t in texts.to_pylist()]
    codes = np.frombuffer("".join(each).encode("utf-32-le"), "<u4").astype(np.int64)
    return codes, np.append(0, np.cumsum([len(t) for t in each], dtype=np.int64))


def parts(sizes: np.ndarray, limit: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` symbols; a single longer row is a range of its own."""
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _of_codes(machine: Automaton, codes: np.ndarray) -> np.ndarray:
    kinds, back = np.unique(codes, return_inverse=True)
    return machine.numbers([chr(c) for c in kinds.tolist()])[back]


def lists(owner: np.ndarray, n: int, values: pa.Array, valid: np.ndarray | None = None) -> pa.Array:
    """One list for each of ``n`` rows, of the values whose owner it is (owners rise); null where a row is not valid."""
    edges = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    offsets = pa.array(edges, pa.int32(), mask=None if valid is None else np.append(~valid, False))
    return pa.ListArray.from_arrays(offsets, values)


def _looked(words: list[str]) -> Callable[[pa.Array], list[pa.Array]]:
    """Looks for words in texts: the words of each, for ranges of texts."""
    machine, names = Automaton.of(words), pa.array(words, pa.string())

    def look(texts: pa.Array) -> list[pa.Array]:
        out = []
        for i, j in parts(_sizes(texts)):
            codes, starts = characters(texts.slice(i, j - i))
            row = np.repeat(np.arange(j - i), np.diff(starts))
            at, _, word = machine.find(_of_codes(machine, codes), np.repeat(starts[1:], np.diff(starts)))
            pairs = np.unique(row[at] * max(1, len(words)) + word)
            out.append(lists(pairs // max(1, len(words)), j - i, names.take(pa.array(pairs % max(1, len(words))))))
        return out

    return look


def contained(text: Column, words: list[str]) -> Column:
    """The words that a text contains, each once."""
    look = _looked(words)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def look_all(texts: pa.Array) -> pa.Array:
        return pa.chunked_array(look(texts), pa.list_(pa.string())).combine_chunks()

    return look_all(text)


def contained_in_each(texts: Column, words: list[str]) -> Column:
    """The same for each text of an array. Rows leave a task a few at a time, as what is found may be far larger than the texts."""
    look = _looked(words)

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def look_each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            flat, starts = rows.flatten(), np.append(0, np.cumsum(_lengths(rows)))
            upto = np.append(0, np.cumsum(_sizes(flat), dtype=np.int64))
            for i, j in parts(np.diff(upto[starts])):
                # Questions on one item stand together, so many texts are the same.
                some = flat.slice(starts[i], starts[j] - starts[i]).dictionary_encode(null_encoding="encode")
                found = pa.chunked_array(look(some.dictionary), pa.list_(pa.string())).combine_chunks().take(some.indices)
                yield pa.ListArray.from_arrays(pa.array((starts[i:j + 1] - starts[i]).astype(np.int32)), found)

    return look_each(texts)


def _sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def _lengths(runs: pa.Array) -> np.ndarray:
    """Symbols of each row, without making Python's strings of them. Null is empty."""
    return pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def follow(first: np.ndarray, step: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walk all rows from their first place on, in step.

    ``first`` names what is taken at a place (or -1), ``step`` how far that leads. Returns the rows and what they took, in order, and
    which rows came to their end.
    """
    ends, here = starts[1:], starts[:-1].copy()
    rows = np.flatnonzero(here < ends)
    done = here == ends
    who, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rows):
        taken = first[here[rows]]
        rows, taken = rows[taken >= 0], taken[taken >= 0]
        who.append(rows)
        what.append(taken)
        here[rows] += step[here[rows]]
        over = here[rows] >= ends[rows]
        done[rows[over]] = here[rows[over]] == ends[rows[over]]
        rows = rows[~over]
    who, what = np.concatenate(who), np.concatenate(what)
    order = np.argsort(who, kind="stable")
    return who[order], what[order], done


_SEGMENTED = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("tags", "readings")])


def segmented(units: Column, unit: Column, entries: pa.Table) -> Column:
    """``tags`` and ``readings`` by longest match with the entries known by the row's unit, or nulls where a place has no match.

    ``units`` is the text as an array; null gives nulls. Of the entries that fit at a place the one with the longest word is taken,
    then the one that comes first. ``entries`` has ``phrase`` (the word's own units), ``word``, ``unit``, ``seq``, ``reading``.
    """
    rows = [r for r in entries.to_pylist() if r["phrase"] and r["unit"] is not None]
    rows.sort(key=lambda r: (-len(r["word"]), r["seq"] is not None, r["seq"] or 0, r["word"], r["reading"] or ""))
    phrases: dict[tuple[str, ...], list[int]] = {}
    for rank, r in enumerate(rows):
        phrases.setdefault(tuple(r["phrase"]), []).append(rank)
    machine = Automaton.of(list(phrases))
    many = np.array([len(x) for x in phrases.values()], np.int64)
    begin = np.cumsum(many) - many
    ranks = np.array([x for each in phrases.values() for x in each], np.int64)
    taught = np.array([r["unit"] for r in rows], np.int64)
    words, readings = (pa.array([r[c] for r in rows], pa.string()) for c in ("word", "reading"))
    lengths = np.array([len(r["phrase"]) for r in rows], np.int64)

    def walk(runs: pa.Array, known: np.ndarray) -> tuple[pa.Array, pa.Array]:
        sizes = _lengths(runs)
        starts = np.append(0, np.cumsum(sizes))
        flat = runs.flatten().dictionary_encode()
        symbols = machine.numbers(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        at, _, phrase = machine.find(symbols, np.repeat(starts[1:], sizes))
        n = many[phrase]
        place, rank = np.repeat(at, n), ranks[np.repeat(begin[phrase] - np.cumsum(n) + n, n) + np.arange(n.sum())] if len(n) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        able = taught[rank] <= known[row[place]] if len(rank) else np.zeros(0, bool)
        best = np.full(len(symbols), len(rows), np.int64)
        np.minimum.at(best, place[able], rank[able])
        first = np.where(best < len(rows), best, -1)
        who, what, done = follow(first, np.append(lengths, 0)[best], starts)
        valid = done & np.asarray(runs.is_valid())
        keep = valid[who]
        take = pa.array(what[keep])
        return lists(who[keep], len(sizes), words.take(take), valid), lists(who[keep], len(sizes), readings.take(take), valid)

    @F.arrow_udf(_SEGMENTED)
    def segment(runs: pa.Array, of: pa.Array) -> pa.Array:
        known = np.array([-(1 << 62) if x is None else x for x in of.to_pylist()], np.int64)
        sizes = _lengths(runs)
        out = [walk(runs.slice(i, j - i), known[i:j]) for i, j in parts(sizes)]
        columns = [pa.chunked_array([x[k] for x in out], pa.list_(pa.string())).combine_chunks() for k in range(2)]
        return pa.StructArray.from_arrays(columns, ["tags", "readings"])

    return segment(units, unit)


_UNITS = T.ArrayType(T.StructType([T.StructField("unit", T.StringType()), T.StructField("tag", T.BooleanType())]))
_Find = Callable[[int, int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _cut(texts: pa.Array, marked: pa.Array, find: _Find) -> pa.Array:
    """Units of the texts; ``find`` tells place and length of the words in a range of rows, by its codes and the starts and ends of texts."""
    kind = pa.list_(pa.struct([("unit", pa.string()), ("tag", pa.bool_())]))
    out = []
    for i, j in parts(_sizes(texts)):
        here = texts.slice(i, j - i)
        codes, starts = characters(here)
        script = (characters(marked.slice(i, j - i))[0] == 1) & (codes != 1)
        ends = np.repeat(starts[1:], np.diff(starts))
        at, length = find(i, j, codes, starts, ends)
        # Where nothing fits: one character of the script, or all up to the next one.
        places = np.arange(len(codes))
        border = np.where(script, places, len(codes))
        following = np.minimum.accumulate(border[::-1])[::-1] if len(codes) else border
        step = np.where(script, 1, np.minimum(following, ends) - places)
        best = np.zeros(len(codes), np.int64)
        np.maximum.at(best, at, length)
        step = np.where(best > 0, best, step)
        who, place, _ = follow(places, step, starts)
        whole = "".join(t or "" for t in here.to_pylist())
        pieces = [whole[a:b] for a, b in zip(place.tolist(), (place + step[place]).tolist(), strict=True)]
        units = pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(best[place] > 0)], ["unit", "tag"])
        out.append(lists(who, j - i, units, np.asarray(here.is_valid())))
    return pa.chunked_array(out, kind).combine_chunks()


def split(text: Column, inside: Column, words: list[str]) -> Column:
    """A text as runs outside the script, the longest word at a place, or one character of the script: ``unit``, ``tag`` (if it is a word).

    ``inside`` is the text with every character of the script replaced by U+0001.
    """
    machine = Automaton.of(words)

    @F.arrow_udf(_UNITS)
    def cut(texts: pa.Array, marked: pa.Array) -> pa.Array:
        return _cut(texts, marked, lambda i, j, codes, starts, ends: machine.find(_of_codes(machine, codes), ends)[:2])

    return cut(text, inside)


def split_at(text: Column, inside: Column, at: Column, length: Column) -> Column:
    """The same with words found before: arrays of their places in the text and their lengths."""
    @F.arrow_udf(_UNITS)
    def cut(texts: pa.Array, marked: pa.Array, at: pa.Array, length: pa.Array) -> pa.Array:
        def found(i: int, j: int, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            some, sizes = at.slice(i, j - i), length.slice(i, j - i)
            first = np.repeat(starts[:-1], some.value_lengths().to_numpy(zero_copy_only=False))
            return first + some.flatten().to_numpy(zero_copy_only=False), sizes.flatten().to_numpy(zero_copy_only=False)

        return _cut(texts, marked, found)

    return cut(text, inside, at, length)
