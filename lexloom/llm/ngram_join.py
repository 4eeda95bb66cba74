"""Near duplicates by Jaccard similarity of word n-gram sets, joined on rare prefixes.

A text's set is that of its distinct lower-cased five-word shingles, as 64-bit hashes. Steps:

1. Every group of documents asks in how many documents each shingle occurs (``exchange.Counts``).
2. Shingles of a set are ordered rare first. Of two sets that are similar enough, the first ``n - ceil(t n) + 1`` of
   each (its prefix) have one in common; shingles that occur once cannot be it. A document whose prefix has
   only those is done, which is most of them.
3. Equal sets are one class from here on, with a number of its own, as an id may stand before several texts. The prefix shingles of a class are its postings; the classes of a posting,
   in the order of size, are chained where the length filter lets neighbours pass. Chains connect all pairs that may link,
   in as many rows as there are postings, never in pairs.
4. Connected chains make blocks. In a block, pairs pass the length filter, the suffix filter (bitmaps whose
   differing bits cannot outnumber the differing shingles), the prefix join and the positional filter, and are then verified on
   whole sets, each once. A block with more than ``tile`` classes is cut into parts, and each two parts are compared in a task
   of their own.
5. Every task adds up the links of each class, so links never become rows; of the links themselves it gives those that
   span its trees, which join to components.

Null and empty texts have no shingles and link with nothing; texts of fewer words than ``width`` have their whole sequence
as the only one. Rows without an id are returned unlinked. Rows that share an id are rows of their own: each has the links and the
component of its own text. Ids are integers; others end with an error. An empty table gives an empty result. Hashes stand for shingles: two shingles share one with
probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import exchange as X
from lexloom.llm.components import Forest, components
from lexloom.llm.registry import query, table
from lexloom.llm.words import gram_hashes, mix, number_words, utf8
from lexloom.sources.store import materialise

BITMAP = 1024


@dataclass(frozen=True)
class Join:
    """Words in a shingle, least similarity in percent, classes in one part of a block, blocks in one task."""

    width: int = 5
    percent: int = 75
    tile: int = 1024
    docs_per_group: int = X.DOCS_PER_GROUP


@dataclass
class Sets:
    """Distinct shingles of several texts: ``hashes`` rising, ``text`` and ``gram`` name who has which."""

    hashes: np.ndarray
    counts: np.ndarray
    text: np.ndarray
    gram: np.ndarray


def shingle_sets(texts: list[bytes | None], width: int) -> Sets:
    words = number_words([t.lower() if t else t for t in texts])
    hashed, text_of = words.hashes(), words.text_of
    at = words.windows(width)
    found, owner = [gram_hashes(hashed, at, width)], [text_of[at]]
    sizes = np.diff(words.starts)
    for n in range(1, width):
        short = np.flatnonzero(sizes == n)
        found.append(mix(gram_hashes(hashed, words.starts[short], n) + np.uint64(n)))
        owner.append(short)
    hashes, text = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(hashes, kind="stable")  # the windows of a text come in a row, so equal hashes have rising texts
    hashes, text = hashes[order], text[order]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    hashes, text = hashes[~again], text[~again]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    gram = np.cumsum(first) - 1
    return Sets(hashes[first], np.bincount(gram, minlength=int(first.sum())), text, gram)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


_HEADS = "id bigint, digest binary, n_shingles bigint, set_hash binary, skip int, prefix array<bigint>, whole binary"


def _heads(how: Join, counts: X.Counts):
    def use(group: pa.Table, loads: dict[int, bytes]) -> pa.Table:
        texts = utf8(group["text"])
        sets = shingle_sets(texts, how.width)
        often = counts.read(sets.hashes, loads)[sets.gram]
        order = np.lexsort((sets.hashes[sets.gram], often, sets.text))
        text, often, hashes = sets.text[order], often[order], sets.hashes[sets.gram[order]]
        edges = np.searchsorted(text, np.arange(len(texts) + 1))
        out: dict[str, list] = {c: [] for c in ("n_shingles", "set_hash", "skip", "prefix", "whole")}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = b - a
            end = a + prefix_length(n, how.percent)
            skip = int(np.searchsorted(often[a:b], 2))
            shared = a + skip < end
            whole = np.sort(hashes[a:b]).astype("<u8").tobytes()
            out["n_shingles"].append(n)
            out["set_hash"].append(xxhash.xxh3_128_digest(whole) if n else None)
            out["skip"].append(skip)
            out["prefix"].append(hashes[a + skip:end].view(np.int64) if shared else None)
            out["whole"].append(whole if shared else None)
        kinds = {"n_shingles": pa.int64(), "set_hash": pa.binary(), "skip": pa.int32(),
                 "prefix": pa.list_(pa.int64()), "whole": pa.binary()}
        return pa.table({"id": group["id"].cast(pa.int64()), "digest": group["digest"]} | {c: pa.array(out[c], t) for c, t in kinds.items()})

    return use


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def heads(docs: DataFrame, key: str, how: Join) -> DataFrame:
    """For each document its set's size and hash, and, where a partner is possible, the shared prefix and the whole set."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"), _digest().alias("digest"))
    rows, groups = X.in_groups(rows, "id", "digest", per_group=how.docs_per_group)
    counts = X.Counts(X.range_bits(groups))

    def question(group: pa.Table) -> list[tuple[int, bytes]]:
        sets = shingle_sets(utf8(group["text"]), how.width)
        return counts.ask(sets.hashes, sets.counts)

    return X.with_answers(rows, X.ask(rows, question, counts.answer), _heads(how, counts), _HEADS)


def _passes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _chains(how: Join):
    """Neighbours in the order of size of every posting of a slot, where the length filter lets them pass."""

    def run(group: pa.Table) -> pa.Table:
        gram, n, cls = (group[c].to_numpy() for c in ("gram", "n_shingles", "cls"))
        order = np.lexsort((cls, n, gram))
        gram, n, cls = gram[order], n[order], cls[order]
        near = np.flatnonzero((gram[1:] == gram[:-1]) & _passes(n[1:], n[:-1], how.percent))
        pairs = np.unique(np.stack([cls[near], cls[near + 1]], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """The parity of the number of shingles at each of ``BITMAP`` places, packed."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate(sets) >> np.uint64(17)) % np.uint64(BITMAP)
    odd = np.bincount(who * BITMAP + place.astype(np.int64), minlength=len(sets) * BITMAP) & 1
    return np.packbits(odd.astype(bool).reshape(len(sets), BITMAP), axis=1).view(np.uint64)


@dataclass
class Held:
    """Classes of a block: shingles by number, prefixes (rare first), and how many shingles of each come before its prefix."""

    sets: list[np.ndarray]
    prefixes: list[np.ndarray]
    skips: np.ndarray
    n: np.ndarray
    n_grams: int

    @classmethod
    def of(cls, sets: list[np.ndarray], prefixes: list[np.ndarray], skips: list[int]) -> Held:
        every = np.unique(np.concatenate(sets))
        number = lambda x: np.searchsorted(every, x.view(np.uint64)).astype(np.int32)
        return cls([number(x) for x in sets], [number(x) for x in prefixes], np.array(skips), np.array([len(x) for x in sets]), len(every))


def _joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All in a row, where each begins, and the place of every value in its own."""
    sizes = np.array([len(x) for x in arrays])
    starts = np.cumsum(sizes) - sizes
    return np.concatenate(arrays), starts, np.arange(sizes.sum()) - np.repeat(starts, sizes)


def _similar(a: int, others: np.ndarray, held: Held, place: np.ndarray, how: Join) -> np.ndarray:
    """Which of the others link with ``a``: prefix join, positional filter, then the whole sets. ``place`` is all -1."""
    least = -(-how.percent * (held.n[a] + held.n[others]) // (100 + how.percent))
    mine = held.prefixes[a]
    place[mine] = np.arange(len(mine))
    grams, starts, at = _joined([held.prefixes[b] for b in others.tolist()])
    own = place[grams]
    place[mine] = -1
    never = held.n_grams
    i = np.minimum.reduceat(np.where(own >= 0, own, never), starts)
    j = np.minimum.reduceat(np.where(own >= 0, at, never), starts)  # both prefixes are in one order
    left = np.minimum(held.n[a] - held.skips[a] - i, held.n[others] - held.skips[others] - j)
    able = (i < never) & (left >= least)
    others, least = others[able], least[able]
    if not len(others):
        return others
    place[held.sets[a]] = 0
    grams, starts, _ = _joined([held.sets[b] for b in others.tolist()])
    common = np.add.reduceat((place[grams] >= 0).astype(np.int64), starts)
    place[held.sets[a]] = -1
    return others[common >= least]


def _pairs(maps: np.ndarray, n: np.ndarray, rows: np.ndarray, other: np.ndarray, how: Join) -> Iterator[np.ndarray]:
    """Pairs that pass the length and the bitmap filter, in the order of ``rows``."""
    for k in range(0, len(rows), 64):
        mine = rows[k:k + 64]
        apart = np.bitwise_count(maps[mine][:, None, :] ^ maps[other][None, :, :]).sum(axis=2, dtype=np.int64)
        total = n[mine][:, None] + n[other][None, :]
        able = (100 + how.percent) * apart <= (100 - how.percent) * total
        able &= _passes(n[mine][:, None], n[other][None, :], how.percent)
        i, j = np.nonzero(able)
        yield np.stack([mine[i], other[j]], axis=1)


#: Values of sets that are looked up at once.
LOOKED_UP = 1 << 20


def _link(how: Join):
    """Links that span trees as ``a``, ``b``; for each class ``a`` without ``b``, the documents it links with in this tile."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending"), ("cls", "ascending")])
        cls, block, own, copies = (group[c].to_numpy() for c in ("cls", "block", "part", "copies"))
        i, j = group["part_a"][0].as_py(), group["part_b"][0].as_py()
        edges = np.flatnonzero(np.diff(block, prepend=block[0] - 1, append=block[-1] + 1))
        found: list[tuple[int, int]] = []
        links = np.zeros(len(cls), np.int64)
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = group.slice(begin, end - begin)
            sets = [np.frombuffer(x, "<u8") for x in part["whole"].to_pylist()]
            held = Held.of(sets, [np.array(x, np.int64) for x in part["prefix"].to_pylist()], part["skip"].to_pylist())
            mine = own[begin:end]
            rows, other = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            forest, maps = Forest(end - begin), _bitmaps(sets)
            del sets
            place = np.full(held.n_grams, -1, np.int32)
            at_once = max(1, LOOKED_UP // int(held.n.max()))
            for pairs in _pairs(maps, held.n, rows, other, how):
                pairs = pairs[pairs[:, 0] < pairs[:, 1]] if i == j else pairs
                firsts, starts = np.unique(pairs[:, 0], return_index=True)
                ends = [*starts[1:].tolist(), len(pairs)]
                for a, first, last in zip(firsts.tolist(), starts.tolist(), ends if len(firsts) else [], strict=True):
                    all_b = pairs[first:last, 1]
                    for k in range(0, len(all_b), at_once):
                        linked = _similar(a, all_b[k:k + at_once], held, place, how)
                        links[begin + a] += copies[begin + linked].sum()
                        links[begin + linked] += copies[begin + a]
                        found += [(int(cls[begin + a]), int(cls[begin + b])) for b in linked.tolist() if forest.join(a, b)]
        has = np.flatnonzero(links)
        return pa.table({
            "a": pa.array([*(x for x, _ in found), *cls[has].tolist()], pa.int64()),
            "b": pa.array([*(y for _, y in found), *[None] * len(has)], pa.int64()),
            "links": pa.array([*[None] * len(found), *links[has].tolist()], pa.int64()),
        })

    return run


def classes_of(all_heads: DataFrame) -> DataFrame:
    """A row for each set that some text has: its number, smallest id and how many rows have it."""
    found = all_heads.where("set_hash IS NOT NULL AND id IS NOT NULL").groupBy("set_hash").agg(
        F.min("id").alias("least"), F.count("*").alias("copies")
    )
    return materialise(found.withColumn("cls", F.monotonically_increasing_id()), "classes")


def linked_classes(all_heads: DataFrame, classes: DataFrame, how: Join) -> DataFrame:
    """``set_hash``, ``tree`` (number of its component), ``component`` (smallest id there), ``links`` (other rows linked) of every class."""
    able = all_heads.where("prefix IS NOT NULL AND id IS NOT NULL").withColumnRenamed("id", "least")
    lead = able.join(classes, ["set_hash", "least"]).dropDuplicates(["cls"])
    lead = materialise(lead.select("cls", "copies", "n_shingles", "skip", "prefix", "whole"), "leaders")

    postings = lead.select("cls", "n_shingles", F.explode("prefix").alias("gram"))
    slots = max(1, lead.count() // 1000)
    chains = postings.groupBy(F.pmod("gram", F.lit(slots)).alias("slot")).applyInArrow(_chains(how), "a bigint, b bigint")
    blocks = materialise(components(chains).select(F.col("id").alias("cls"), F.col("component_id").alias("block")), "blocks")
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
    placed = blocks.join(sizes, "block").withColumn("parts", F.ceil(F.col("n") / how.tile).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    small = F.pmod(F.xxhash64("block"), F.lit(max(1, blocks.count() // 500)))
    placed = placed.withColumn("slot", F.when(F.col("parts") == 1, small).otherwise(-1 - F.col("block")))
    tiles = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cls", "block", "slot", "part", F.least("part", "with").alias("part_a"), F.greatest("part", "with").alias("part_b")
    )
    tiles = tiles.join(lead, "cls")
    found = tiles.groupBy("slot", "part_a", "part_b").applyInArrow(_link(how), "a bigint, b bigint, links bigint")
    found = materialise(found, "links")
    trees = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("id").alias("cls"), F.col("component_id").alias("tree"))
    linked = found.where("links IS NOT NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))

    in_tree = classes.join(trees, "cls")
    least = in_tree.groupBy("tree").agg(F.min("least").alias("component"))
    named = trees.join(least, "tree")
    return classes.join(named, "cls", "left").join(linked, "cls", "left").select(
        "set_hash", "least", F.coalesce("tree", "cls").alias("tree"), F.coalesce("component", "least").alias("component"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
    )


def near_copies(docs: DataFrame, key: str = "doc_id", how: Join = Join()) -> DataFrame:  # noqa: B008
    """``key``, ``n_shingles``, ``component_id`` (smallest key reachable by links), ``n_links`` (other rows linked directly)."""
    all_heads = materialise(heads(docs, key, how), "heads")
    of_class = linked_classes(all_heads, classes_of(all_heads), how)
    kind = docs.schema[key].dataType
    named = all_heads.where("id IS NOT NULL").select("id", "n_shingles", "set_hash")
    nameless = all_heads.where("id IS NULL").select("id", "n_shingles", F.col("id").alias("component"), F.lit(0).cast("bigint").alias("links"))
    out = named.join(of_class, "set_hash", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links")
    ).unionByName(nameless)
    return out.select(F.col("id").cast(kind).alias(key), "n_shingles", F.col("component").cast(kind).alias("component_id"), F.col("links").alias("n_links"))


def keep_first(docs: DataFrame, key: str = "doc_id", how: Join = Join()) -> DataFrame:  # noqa: B008
    """One document of each component, with the columns it came with.

    It is the one with the smallest id, and of rows that share that id the one whose text has the smallest digest. Of rows equal
    in id and text one stays, also where the text is empty; rows without an id all stay.
    """
    all_heads = materialise(heads(docs, key, how), "heads")
    of_class = linked_classes(all_heads, classes_of(all_heads), how)
    first = of_class.where("least = component").select("set_hash", "tree", F.col("least").alias("id"))
    rows = all_heads.where("id IS NOT NULL").groupBy("id", "digest", "set_hash").agg(F.count("*").alias("n"))
    leads = rows.join(first, ["set_hash", "id"]).groupBy("tree").agg(F.min(F.struct("id", "digest", "n")).alias("lead")).select("lead.*")
    alone = rows.where("set_hash IS NULL").select("id", "digest", "n")
    kept = materialise(leads.unionByName(alone), "kept").withColumnsRenamed({"id": "_kept_id", "digest": "_kept_digest", "n": "_kept_n"})
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    own = own.select("own", F.col(f"own.`{key}`").cast("bigint").alias("_id"), F.unhex(F.md5(F.coalesce(F.col("own.text").cast("string"), F.lit("")))).alias("_digest"))
    met = own.join(kept, (F.col("_id") == F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest")))
    once = met.where("_kept_n = 1").select("own")
    repeated = met.where("_kept_n > 1").groupBy("_id", "_digest").agg(F.first("own").alias("own")).select("own")
    return once.unionByName(repeated).unionByName(own.where("_id IS NULL").select("own")).select("own.*")


_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
gram AS (
  SELECT DISTINCT r, hash(g) AS g FROM (
    SELECT r, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
link AS (
  SELECT x, y FROM (SELECT a.r AS x, b.r AS y, count(*) AS common FROM gram a JOIN gram b ON a.g = b.g AND a.r <> b.r GROUP BY ALL)
  JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
named AS (SELECT x, y FROM link JOIN d a ON a.r = x JOIN d b ON b.r = y WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, named.y FROM reach JOIN named ON named.x = reach.y),
part AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON d.r = y GROUP BY x)
SELECT doc_id, coalesce(size.n, 0) AS n_shingles, component_id, (SELECT count(*) FROM named WHERE named.x = d.r) AS n_links
FROM d JOIN part ON part.x = d.r LEFT JOIN size ON size.r = d.r
"""


@query("op7_ngram_join", _SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
