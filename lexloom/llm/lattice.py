"""Likelihood of texts under a unigram model of word pieces, summed over all ways to cut a text into pieces.

The pieces are those of a public vocabulary file, which is never trained; how likely each is, is learned here. A text is its
words, lower-cased in A-Z, each with a mark before it, and one end. A piece fits where its characters stand, a character that
is no piece by itself goes by its bytes, so every text has a probability. The marginal probability of a word adds up all paths
through the lattice of its pieces by a forward recursion in log space. No piece goes beyond a word, so
all paths of a text pass between its words, and the recursion over a text is the sum of its words' and the end's.

1. Spark counts every distinct word, over all rows and over those to learn from (``count_words``).
2. ``learn``: a few rounds of expectation-maximisation over the counted words. A task adds up the expected uses of each piece by
   forward and backward recursion; what reaches the driver has a row for each piece of the vocabulary file.
3. The marginal of each distinct word is computed once, whatever its number.
4. ``score``: words that make up more than one in ``HEAVY`` of all words are at most ``HEAVY`` in number; their figures go with the
   tasks (24 bytes each). A text adds up its heavy words at once and keeps the others as a list, which meets the table of words by a
   join without hot keys, as no word in it is frequent. No table grows on the driver.

The base score takes whole words: ``log10((c + 1) / (N + V + 1))`` for each, as unigrams smoothed by one.

Null texts are empty: they have the end only. Rows without an id are learned from and not held out. Repeated rows are rows of their
own. With nothing to learn from, pieces have the probabilities they start with, which follow the file's order by Zipf's law (its
scores are ranks). An empty table gives an empty result. Columns of other names do not matter. A very long word costs a step for each of its characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.registry import query, table
from lexloom.llm.words import chunks, number_words, utf8, words_of
from lexloom.sources.store import materialise

DEFAULT_FILE = "piece_bpe_32k.model"
MARK = "▁"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that are more than one in so many go with the tasks; there are fewer than that of them.
HEAVY = 1 << 20
#: Rounds of learning, and uses of each piece that are taken for granted.
ROUNDS, SMOOTH = 3, 0.1
#: Words whose lattices are held at once.
AT_ONCE = 1 << 14
_SHIFT = np.int64(1 << 21)


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as a prefix tree: ``keys`` (node and character) rise, ``child`` is where they lead, ``piece`` what ends at a node.

    Pieces are numbered as the file ranks them, then 256 bytes, then the end.
    """

    keys: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    longest: int
    n: int  # pieces that are not bytes

    @property
    def size(self) -> int:
        return self.n + 257

    @property
    def end(self) -> int:
        return self.n + 256

    @classmethod
    def of(cls, names: list[str]) -> Pieces:
        """Pieces with a blank for the mark before a word, best first. Those that no word can hold are left out by the caller."""
        edges: dict[int, int] = {}
        piece = [-1]
        for number, name in enumerate(names):
            node = 0
            for char in name:
                key = (node << 21) | ord(char)
                node = edges.setdefault(key, len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = number
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        child = np.fromiter(edges.values(), np.int64, len(edges))[order]
        return cls(keys[order], child, np.array(piece, np.int64), max(map(len, names), default=1), len(names))

    def start(self) -> np.ndarray:
        """Log probabilities by Zipf's law over ranks; bytes and the end come last."""
        p = 1 / (np.arange(self.size) + 10.0)
        return np.log(p / p.sum())


def read_pieces(path: str | None = None) -> Pieces:
    """The pieces of a ``sentencepiece`` file that can stand in words without A-Z."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_FILE)
    file = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(file.vocab_size()) if not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i) or file.is_byte(i))]
    ranked = sorted(ids, key=lambda i: (-file.get_score(i), i))
    named = [file.id_to_piece(i) for i in ranked]
    able = [x for x in named if MARK not in x[1:] and not set(x) & set(UPPER + " \t\n\x0b\x0c\r")]
    return Pieces.of([x.replace(MARK, " ") for x in able])


@dataclass
class Lattice:
    """Lattices of several words, the longest first. A slot is a place between characters of a word; slots stand level by level.

    All pieces of one length that begin at one level are a group. They lead to slots that differ, so a group is one step on arrays.
    """

    order: np.ndarray  # the place of each word among those given
    sizes: np.ndarray  # characters, with the mark
    first: np.ndarray  # first slot of each level
    groups: list[tuple[int, int, np.ndarray, np.ndarray]]  # level, length, words, pieces; by the level they lead to
    lone: np.ndarray  # characters that go by their bytes; they are numbered behind the pieces

    @classmethod
    def of(cls, words: list[str], pieces: Pieces) -> Lattice:
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order] + 1
        text = "".join([" " + words[i] for i in order.tolist()])
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        level = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        top = int(sizes.max(initial=0))
        by_level = np.argsort(level.astype(np.uint16) if top < 1 << 16 else level, kind="stable")
        codes, word, level = codes[by_level], word[by_level], level[by_level]
        in_level = np.bincount(level, minlength=top)  # characters of a level; the next level has as many slots
        chars = np.append(0, np.cumsum(in_level))
        first = np.append(0, len(words) + chars)[:top + 1]
        groups: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def add(length: int, level: np.ndarray, word: np.ndarray, number: np.ndarray) -> None:
            cuts = np.flatnonzero(np.diff(level, prepend=-1, append=top + 1))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                groups.append((int(level[i]), length, word[i:j], number[i:j]))

        alone, lone = np.zeros(0, bool), codes
        at_level, at_word, node = level, word, np.zeros(len(codes), np.int64)
        for length in range(1, pieces.longest + 1):
            inside = at_level + length <= sizes[at_word]
            at_level, at_word, node = at_level[inside], at_word[inside], node[inside]
            key = node * _SHIFT + codes[chars[at_level + length - 1] + at_word]
            place = np.minimum(np.searchsorted(pieces.keys, key), max(len(pieces.keys) - 1, 0))
            hit = pieces.keys[place] == key if len(pieces.keys) else np.zeros(len(key), bool)
            if length == 1:
                alone = ~hit
                alone[hit] = pieces.piece[pieces.child[place[hit]]] < 0
            at_level, at_word, node = at_level[hit], at_word[hit], pieces.child[place[hit]]
            number = pieces.piece[node]
            whole = number >= 0
            add(length, at_level[whole], at_word[whole], number[whole])
        if not pieces.longest:
            alone = np.ones(len(codes), bool)
        lone, kind = np.unique(codes[alone], return_inverse=True)
        add(1, level[alone], word[alone], pieces.size + kind)
        return cls(order, sizes, first, sorted(groups, key=lambda g: g[0] + g[1]), lone)

    def _spelling(self) -> tuple[np.ndarray, np.ndarray]:
        """The lone characters and their bytes."""
        raw = [chr(c).encode() for c in self.lone.tolist()]
        return np.repeat(np.arange(len(raw)), [len(x) for x in raw]), np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)

    def weights(self, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
        """Log probabilities of the pieces and of the lone characters."""
        who, byte = self._spelling()
        return np.append(logp, np.bincount(who, logp[pieces.n + byte], len(self.lone)))

    @property
    def ends(self) -> np.ndarray:
        """The last slot of each word."""
        return self.first[self.sizes] + np.arange(len(self.sizes))

    def _slots(self) -> np.ndarray:
        return np.full(int(self.first[-1] + (self.sizes == len(self.first) - 1).sum()), -np.inf)

    def forward(self, w: np.ndarray) -> np.ndarray:
        """The log sum of all paths from the beginning of its word to each slot."""
        total = self._slots()
        total[:len(self.sizes)] = 0.0
        for level, length, word, piece in self.groups:
            to = self.first[level + length] + word
            total[to] = np.logaddexp(total[to], total[self.first[level] + word] + w[piece])
        return total

    def backward(self, w: np.ndarray) -> np.ndarray:
        """The log sum of all paths from each slot to the end of its word."""
        total = self._slots()
        total[self.ends] = 0.0
        for level, length, word, piece in sorted(self.groups, key=lambda g: -g[0]):
            here = self.first[level] + word
            total[here] = np.logaddexp(total[here], total[self.first[level + length] + word] + w[piece])
        return total

    def marginals(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        out[self.order] = self.forward(w)[self.ends]
        return out

    def expected(self, pieces: Pieces, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in all words, a word counted ``counts`` times."""
        w = self.weights(pieces, logp)
        ahead, behind = self.forward(w), self.backward(w)
        whole, counts = ahead[self.ends], counts[self.order]
        paths = [np.zeros(0)]
        for level, length, word, piece in self.groups:
            here, there = self.first[level] + word, self.first[level + length] + word
            paths.append(np.exp(ahead[here] + w[piece] + behind[there] - whole[word]) * counts[word])
        every = np.concatenate([np.zeros(0, np.int64), *(piece for *_, piece in self.groups)])
        used = np.bincount(every, np.concatenate(paths), len(w))
        who, byte = self._spelling()
        return used[:pieces.size] + np.bincount(pieces.n + byte, used[pieces.size:][who], pieces.size)


def _parts(words: list[str]) -> Iterator[np.ndarray]:
    """Places of some thousand words of about one length, so that few steps serve them all."""
    order = np.argsort([len(w) for w in words], kind="stable")
    for i in range(0, len(words), AT_ONCE):
        yield order[i:i + AT_ONCE]


def marginals(words: list[str], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """The natural logarithm of the marginal probability of each word."""
    out = np.zeros(len(words))
    for part in _parts(words):
        lattice = Lattice.of([words[i] for i in part.tolist()], pieces)
        out[part] = lattice.marginals(lattice.weights(pieces, logp))
    return out


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def count_words(docs: DataFrame, text: str, train: Column) -> DataFrame:
    """``word``, ``n``, ``n_train``: every distinct word of the texts, over all rows and over those with ``train``."""
    each = docs.select(train.cast("long").alias("train"), F.explode(words_of(_lowered(F.col(text)))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"), F.sum("train").alias("n_train"))


def _expect(pieces: Pieces, logp: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pieces.size)
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n_train").to_numpy()
            for part in _parts(words):
                total += Lattice.of([words[i] for i in part.tolist()], pieces).expected(pieces, logp, counts[part])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    return run


def learn(words: DataFrame, n_texts: int, pieces: Pieces, rounds: int = ROUNDS, smooth: float = SMOOTH) -> np.ndarray:
    """Log probabilities of the pieces, from counted words and the number of texts (each has an end)."""
    logp = pieces.start()
    for _ in range(rounds):
        found = words.where("n_train > 0").select("word", "n_train").mapInArrow(_expect(pieces, logp), "piece bigint, uses double")
        found = found.groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.full(pieces.size, smooth)
        uses[found["piece"].to_numpy()] += found["uses"].to_numpy()
        uses[pieces.end] += n_texts
        logp = np.log(uses / uses.sum())
    return logp


def _with_marginals(pieces: Pieces, logp: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = marginals(batch.column("word").to_pylist(), pieces, logp) / np.log(10)
            yield batch.append_column("logp", pa.array(found))

    return run


@dataclass(frozen=True)
class Heavy:
    """Frequent words by hash, with their base and lattice figures and whether training has them."""

    hashes: np.ndarray
    known: np.ndarray
    base: np.ndarray
    logp: np.ndarray

    @classmethod
    def of(cls, scored: DataFrame, n_words: int, heavy: int) -> Heavy:
        rows = scored.where(F.col("n") * F.lit(heavy) > F.lit(n_words)).select("word", "n_train", "logp").toArrow()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in utf8(rows["word"])), np.uint64, len(rows))
        order = np.argsort(hashes)
        count = rows["n_train"].to_numpy()[order]
        return cls(hashes[order], (count > 0).astype(np.int64), np.log10(count + 1.0), rows["logp"].to_numpy()[order])


_SCORED = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                     ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])


def _score_texts(texts: list[bytes | None], heavy: Heavy) -> pa.RecordBatch:
    words = number_words([t.lower() if t else t for t in texts])
    n = len(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.vocab), np.uint64, len(words.vocab))
    place = np.searchsorted(heavy.hashes, hashes)
    held = np.zeros(len(hashes), bool)
    inside = np.flatnonzero(place < len(heavy.hashes))
    held[inside] = heavy.hashes[place[inside]] == hashes[inside]
    figure = lambda x: np.where(held, x[np.where(held, place, 0)] if len(x) else 0.0, 0.0)
    text_of = words.text_of
    total = lambda x: np.bincount(text_of, figure(x)[words.ids] if len(words.ids) else None, n)
    loose = np.flatnonzero(~held[words.ids]) if len(words.ids) else np.zeros(0, np.int64)
    pairs, times = np.unique(text_of[loose] * max(1, len(hashes)) + words.ids[loose], return_counts=True)
    owner, word = pairs // max(1, len(hashes)), pairs % max(1, len(hashes))
    edges = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    names = pa.array(words.vocab, pa.binary()).cast(pa.string()).take(pa.array(word))
    return pa.RecordBatch.from_arrays([
        pa.array(np.diff(words.starts)), pa.array(total(heavy.known).astype(np.int64)), pa.array(total(heavy.base)), pa.array(total(heavy.logp)),
        pa.ListArray.from_arrays(edges, names), pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int64))),
    ], schema=_SCORED)


def _lookup(heavy: Heavy, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest = utf8(batch.column(text)), batch.drop_columns([text])
            for a, b in chunks(texts):
                found = _score_texts(texts[a:b], heavy)
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, *found.columns], names=[*rest.schema.names, *_SCORED.names])

    return run


def score(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
    rounds: int = ROUNDS, heavy: int = HEAVY,
) -> DataFrame:
    """``key``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10) of every row.

    The model learns from the rows with ``train`` (a column without nulls).
    """
    spark = docs.sparkSession
    pieces = read_pieces(vocabulary)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), train.alias("train"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # lattices take more time than their bytes tell
    words = materialise(count_words(rows, "text", F.col("train")).repartition(spread), "words")
    n_words, n_train, distinct = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)
    ).first()
    n_texts = rows.where("train").count()
    tokens, kinds = n_train + n_texts, distinct + (n_texts > 0)
    logp = learn(words, n_texts, pieces, rounds)
    scored = materialise(words.mapInArrow(_with_marginals(pieces, logp), "word string, n bigint, n_train bigint, logp double"), "marginals")

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    schema = f"key {docs.schema[key].dataType.simpleString()}, train boolean, row bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<string>, times array<bigint>"
    part = numbered.select("key", "train", "row", "text").mapInArrow(_lookup(Heavy.of(scored, n_words, heavy), "text"), schema)
    part = materialise(part, "texts")
    rare = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = rare.join(scored.select("word", "n_train", F.col("logp").alias("word_logp")), "word").groupBy("row").agg(
        F.sum(F.col("times") * (F.col("n_train") > 0).cast("long")).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("n_train") + 1.0)).alias("more_base"), F.sum(F.col("times") * F.col("word_logp")).alias("more_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_tokens = F.col("n_tokens") + 1
    ended = float(np.log10(n_texts + 1.0))
    return part.join(met, "row", "left").select(
        F.col("key").alias(key), "train", all_tokens.alias("n_tokens"),
        (F.col("n_known") + zero("more_known") + (1 if n_texts else 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") + ended - all_tokens * float(np.log10(tokens + kinds + 1.0))).alias("base_score"),
        (F.col("score") + zero("more_score") + float(logp[pieces.end] / np.log(10))).alias("score"),
    )


@query("op12_lattice_score")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = score(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
