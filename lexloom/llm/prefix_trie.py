"""Prefix trie of conversations: Z-fast tries over batches of conversations, their nodes merged by Spark.

A node is a sequence of turns with which some conversation begins. A turn goes by the 128-bit digest of its role and text and
a sequence by the digest chained over its turns, so a node is named by 16 bytes; texts are never shuffled.

1. Equal conversations become one class with their number and smallest id (``classes``).
2. Classes are dealt by ranges of their first turns, with the class itself behind them: neighbours share their beginnings,
   and a first turn that a third of all conversations share is spread over many tasks.
3. A task inserts batches of classes into a Z-fast trie (``ZFast``): compacted nodes are hashed at the two-fattest depth of
   their edge, and fat binary search finds the node where a conversation leaves the trie in logarithmic steps. At
   ``most_turns`` turns the trie is written out and a new one is begun, which bounds memory. Edges are expanded: each depth of an
   edge becomes a row, with the values it gets from the members below it.
4. Rows of equal nodes, of different tries, are added up by Spark, with map-side combine.
5. A node's own words may be counted once only, however many tries hold it: for the class of its smallest member. Such a
   class owns a lower part of its path; how long it is follows from the number of nodes that carry its id. With
   that the classes go through the tries once more, and each node adds up the words and leaves below it.

A conversation is one row of about 24 bytes for each turn. Ids of members that end at a node are hashed as a stream: ranges of
them are packed to pieces by many tasks, then the pieces of one node, in order, are one task's.

Null role and text are empty. Turns of equal number come in the order of their digests, the null turn first. Rows without
``conv_id`` belong to no conversation and are left out, columns of other names too. A conversation without turns is a member
of the root. Without conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.registry import query, table
from lexloom.llm.words import words_of
from lexloom.sources.store import materialise

ROOT = bytes(16)
#: Members of a family take their first turns from its first conversation, up to ``HEADS - 1`` of them.
FAMILY, HEADS = 20, 4
#: A node with more than one in so many of all nodes as children is joined to them on its own; there are fewer such nodes.
BROAD = 1024
#: Ids in one packed piece.
PIECE = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Limits:
    """Turns that a task's trie holds before it is written out."""

    most_turns: int = 1 << 19


def two_fattest(a: int, b: int) -> int:
    """The number in ``(a, b]`` that is divisible by the highest power of two."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


@dataclass(slots=True)
class Node:
    """A compacted node: the first ``length`` turns of the path ``of``; values are sums over the members of its subtree."""

    of: int
    length: int
    parent: int
    n: int = 0
    least: int | None = None
    words: int = 0  # of all members, copies counted
    own: int = 0  # words of the parts that members own
    top: tuple[int, int] | None = None  # where the part that begins highest begins, and the words before it
    leaves: int = 0

    def add(self, n: int, least: int | None, words: int, own: int, top: tuple[int, int] | None, leaves: int) -> None:
        self.n += n
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)
        self.words, self.own, self.leaves = self.words + words, self.own + own, self.leaves + leaves
        self.top = top if self.top is None else self.top if top is None else min(self.top, top)


@dataclass
class ZFast:
    """A Z-fast trie over paths (digests of all prefixes of a sequence, the empty one included)."""

    paths: list[list[bytes]] = field(default_factory=lambda: [[ROOT]])
    nodes: list[Node] = field(default_factory=lambda: [Node(0, 0, -1)])
    handles: dict[bytes, int] = field(default_factory=dict)
    edges: dict[bytes, int] = field(default_factory=dict)  # first prefix of an edge -> the node it leads to
    looked: int = 0

    def _extent(self, node: Node) -> bytes:
        return self.paths[node.of][node.length]

    def _handle(self, node: Node) -> bytes:
        return self.paths[node.of][two_fattest(self.nodes[node.parent].length, node.length)]

    def exit(self, path: list[bytes]) -> tuple[int, int]:
        """The node on whose edge (or at which) a path leaves the trie, and the length they have in common."""
        low, high, at = 0, len(path) - 1, 0
        while low < high:
            depth = two_fattest(low, high)
            self.looked += 1
            found = self.handles.get(path[depth])
            if found is None:
                high = depth - 1
                continue
            node = self.nodes[found]
            if node.length < len(path) and path[node.length] == self._extent(node):
                low, at = node.length, found
            else:
                return found, self._shared(path, node, depth)
        if low + 1 < len(path):
            child = self.edges.get(path[low + 1])
            if child is not None:
                return child, self._shared(path, self.nodes[child], low + 1)
        return at, low

    def _shared(self, path: list[bytes], node: Node, low: int) -> int:
        """How far a path runs along an edge, known to share ``low``."""
        other, high = self.paths[node.of], min(len(path) - 1, node.length)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if path[middle] == other[middle] else (low, middle - 1)
        return low

    def insert(self, path: list[bytes]) -> int:
        """The node of a path, which is made if it is new."""
        at, shared = self.exit(path)
        node = self.nodes[at]
        if shared < node.length:
            del self.handles[self._handle(node)]
            upper = Node(node.of, shared, node.parent)
            self.nodes.append(upper)
            top = len(self.nodes) - 1
            self.edges[self.paths[node.of][self.nodes[node.parent].length + 1]] = top
            node.parent = top
            self.edges[self.paths[node.of][shared + 1]] = at
            self.handles[self._handle(upper)] = top
            self.handles[self._handle(node)] = at
            at = top
        if shared == len(path) - 1:
            return at
        self.paths.append(path)
        leaf = Node(len(self.paths) - 1, len(path) - 1, at)
        self.nodes.append(leaf)
        new = len(self.nodes) - 1
        self.edges[path[shared + 1]] = new
        self.handles[self._handle(leaf)] = new
        return new

    def settle(self) -> None:
        """Add every node's values to its ancestors'."""
        for node in sorted(self.nodes, key=lambda x: -x.length):
            if node.parent >= 0:
                self.nodes[node.parent].add(node.n, node.least, node.words, node.own, node.top, node.leaves)

    def expanded(self) -> Iterator[tuple[Node, int]]:
        """Every node of the trie that is not compacted: the one at whose edge it lies, and its depth."""
        for node in self.nodes:
            for depth in range(self.nodes[node.parent].length + 1 if node.parent >= 0 else 0, node.length + 1):
                yield node, depth


def prefixes(turns: list[bytes]) -> list[bytes]:
    """Digests of all prefixes, the empty one first."""
    out = [ROOT]
    for turn in turns:
        out.append(hashlib.md5(out[-1] + turn, usedforsecurity=False).digest())
    return out


class _Store:
    """Classes of a task in a trie, with the running words of each kept path."""

    def __init__(self) -> None:
        self.trie, self.turns = ZFast(), 0
        self.words: dict[int, list[int]] = {0: [0]}

    def insert(self, row: dict) -> None:
        turns = row["turns"]
        path = prefixes([t["d"] for t in turns])
        total = [0]
        for t in turns:
            total.append(total[-1] + t["w"])
        kept = len(self.trie.paths)
        at = self.trie.insert(path)
        if len(self.trie.paths) > kept:
            self.words[kept] = total
        self.turns += len(turns) + 1
        begin = len(path) - row["owned"]
        before = total[max(begin - 1, 0)]
        top = (begin, before) if row["owned"] else None
        self.trie.nodes[at].add(
            row["copies"], row["conv_id"], row["copies"] * total[-1], total[-1] - before if row["owned"] else 0, top, int(row["leaf"])
        )


_NODES = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64())])
_SUMS = pa.schema([("node", pa.binary()), ("saved", pa.int64()), ("leaves", pa.int64())])


def _node_rows(store: _Store) -> pa.RecordBatch:
    trie, out = store.trie, [[], [], [], [], []]
    for node, depth in trie.expanded():
        path = trie.paths[node.of]
        for column, value in zip(out, (path[depth], path[depth - 1] if depth else None, depth, node.least, node.n), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NODES, strict=True)], schema=_NODES)


def _sum_rows(store: _Store) -> pa.RecordBatch:
    """What the members of each node give to ``saved_tokens``: their words from its depth on, less those of the nodes they own."""
    trie, out = store.trie, [[], [], []]
    for node, depth in trie.expanded():
        above = store.words[node.of][max(depth - 1, 0)]
        own = node.own
        if node.top is not None and node.top[0] < depth:  # its owned part begins above this node
            own -= above - node.top[1]
        for column, value in zip(out, (trie.paths[node.of][depth], node.words - node.n * above - own, node.leaves), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SUMS, strict=True)], schema=_SUMS)


def _through_tries(rows: pa.RecordBatch, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Store()
        for batch in batches:
            for row in batch.to_pylist():
                store.insert(row)
                if store.turns >= limits.most_turns:
                    store.trie.settle()
                    yield rows(store)
                    store = _Store()
        if store.turns:
            store.trie.settle()
            yield rows(store)

    return run


def _dealt(classes: DataFrame) -> DataFrame:
    first = [F.get("turns", i)["d"] for i in range(3)]
    order = [*first, F.col("end")]
    return classes.repartitionByRange(*order).sortWithinPartitions(*order)


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas, in pieces of one class."""
    held, first, ids = None, None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["end", "first", "ids"])

    for batch in batches:
        for end, conv in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (end != held or len(ids) == PIECE):
                yield piece()
                ids = []
            if not ids:
                held, first = end, conv
            ids.append(str(conv))
    if ids:
        yield piece()


def _digest_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, running = None, None

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([running.hexdigest()])], names=["end", "ends_sha256"])

    for batch in batches:
        for end, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if end == held:
                running.update(b",")
            else:
                if held is not None:
                    yield result()
                held, running = end, hashlib.sha256()
            running.update(ids.encode())
    if held is not None:
        yield result()


def ends_digests(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``end``, ``ends_sha256``: the digest of the ids (``end``, ``conv_id`` rows) of each class, in order."""
    alone = classes.where("copies = 1").select("end", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    several = members.join(classes.where("copies > 1").select("end"), "end", "left_semi")
    ordered = several.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    pieces = ordered.mapInArrow(_digest_pieces, "end binary, first bigint, ids string")
    streamed = pieces.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_digest_streams, "end binary, ends_sha256 string")
    return alone.unionByName(streamed)


_TURN = "array<struct<d:binary,w:int>>"


def own_turns(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turns``: the digest and the words of every turn, in order."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").cast("long").alias("t"), digest.alias("d"), F.size(words_of(text)).alias("w"))
    held = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    listed = held.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first one of their family, as their checksum says how many."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    none = F.array().cast(_TURN)
    rest = F.when(n < F.size("turns"), F.slice("turns", n + 1, F.size("turns"))).otherwise(none)
    head = F.when(n > 0, F.slice(F.coalesce("head", none), F.lit(1), n)).otherwise(none)
    joined = convs.withColumn("family", family).join(heads, "family", "left")
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def _end_of(turns: Column) -> Column:
    """The digest of a whole sequence, chained as ``prefixes`` chains it."""
    return F.aggregate(turns, F.lit(ROOT), lambda d, t: F.unhex(F.md5(F.concat(d, t["d"]))))


def _with_parents(nodes: DataFrame, kids: DataFrame) -> DataFrame:
    """Add ``parent_conv_id``. Parents of very many children are fewer than ``BROAD`` and go to where their children are."""
    above = nodes.join(kids, "node").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    is_broad = F.col("n_children") * BROAD > nodes.count()
    broad = materialise(above.where(is_broad).drop("n_children"), "broad")
    few = nodes.join(F.broadcast(broad), "parent")
    rest = nodes.join(F.broadcast(broad.select("parent")), "parent", "left_anti").join(above.where(~is_broad).drop("n_children"), "parent", "left")
    return few.unionByName(rest)


def prefix_trie(convs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """All nodes of the trie of conversations (``conv_id``, ``turns``), one row each; ids are distinct.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent, ``n_convs`` the members, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` as their names say, ``ends_sha256`` the digest of the ids that end there.
    """
    members = materialise(convs.withColumn("end", _end_of(F.col("turns"))), "members")
    classes = members.groupBy("end").agg(
        F.first("turns").alias("turns"), F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")
    )
    classes = materialise(_dealt(classes), "classes")
    plain = classes.withColumns({"owned": F.lit(0).cast("long"), "leaf": F.lit(False)})
    found = plain.mapInArrow(_through_tries(_node_rows, limits), "node binary, parent binary, depth bigint, conv_id bigint, n bigint")
    nodes = found.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs")
    )
    nodes = materialise(nodes, "nodes")
    kids = materialise(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "kids")
    owned = nodes.groupBy("conv_id").agg(F.count("*").alias("owned"))
    told = classes.join(owned, "conv_id", "left").join(
        kids.select(F.col("node").alias("end"), F.lit(False).alias("leaf")), "end", "left"
    ).select("turns", "conv_id", "copies", "end", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(True)).alias("leaf"))
    sums = _dealt(told).mapInArrow(_through_tries(_sum_rows, limits), "node binary, saved bigint, leaves bigint")
    sums = sums.groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = ends_digests(members.select("end", "conv_id"), classes.select("end", "conv_id", "copies"))
    return (
        _with_parents(nodes, kids).join(kids, "node", "left").join(sums, "node").join(ends.withColumnRenamed("end", "node"), "node", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
                "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    )


_SQL = """
WITH t AS (
  SELECT conv_id, turn, md5(length(r) || ':' || r || x) AS d, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({'d': d, 'w': w} ORDER BY turn NULLS FIRST, d) AS s FROM t GROUP BY conv_id),
-- crc32 of the decimal id, by its table of 256 steps
step AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
sums AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(steps[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 4 AS h
  FROM (SELECT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT) AS bytes FROM own), step),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(f.s, [])[1:h], a.s[h + 1:]) AS s
  FROM own a JOIN sums USING (conv_id) LEFT JOIN own f ON f.conv_id = a.conv_id - a.conv_id % 20),
path AS (
  SELECT conv_id, len(s) AS n, depth, array_to_string(list_transform(s[1:depth], lambda x: x.d), ',') AS k,
         CASE WHEN depth > 0 THEN array_to_string(list_transform(s[1:depth - 1], lambda x: x.d), ',') END AS above, s[depth].w AS w
  FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM rebuilt)),
node AS (
  SELECT k, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(w), 0) AS w FROM path GROUP BY k, depth),
kids AS (SELECT above AS k, count(*) AS n FROM node WHERE above IS NOT NULL GROUP BY above),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM path WHERE depth = n GROUP BY k),
-- every node counts for all prefixes of its smallest member up to its own depth
below AS (
  SELECT p.k, count(*) FILTER (kids.n IS NULL) AS leaves, sum((v.n_convs - 1) * v.w) AS saved
  FROM node v JOIN path p ON p.conv_id = v.conv_id AND p.depth <= v.depth LEFT JOIN kids ON kids.k = v.k GROUP BY p.k)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
       leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN node up ON up.k = node.above
"""


@query("op13_prefix_trie", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = materialise(own_turns(table(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie(rebuilt(convs))
