"""Repair of the order of roles in conversations, by the cheapest edits and the first of their audits.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. An edit keeps a row, gives it the role
user or assistant, deletes it, or inserts an empty row; its letter goes into the audit. The dynamic program reads the rows
once and holds, for each of the four states of that pattern, the cheapest edits that lead there:

- audits are linked nodes that share their beginnings; a node knows its length, a rolling hash of its letters, its
  parent and one farther ancestor (jumps of skew-binary lengths), so an ancestor at any length is found in
  logarithmic steps and dead branches cost nothing;
- of two audits of equal cost the smaller one stays. Their longest common prefix is searched by hashes over those
  ancestors, and where two hashes agree the letters are compared, so a collision decides nothing. Equal costs
  never meet in audits of which one begins with the other: what follows would be insertions, which cost;
- the digest of the repaired rows is carried as a running SHA-256 in each state, so texts are never held.

Rows are shuffled once by conversation and sorted; a task reads them as a stream. For a conversation it holds a node and a
16-byte digest for each row (about 0.3 KB), and never its texts; the audit has a letter for each row, so a conversation has to
fit a cell of the result in any case. Sorting spills.

Null role and text are one space; a row with an empty role has no initial, so it may stay anywhere. Rows of equal turn come by role, then text, the null turn first. Rows without ``conv_id``
are one conversation of their own. Blank and repeated rows are always deleted. A conversation of which no row is left
has counts of zero, an empty audit and the digest of the empty string. An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.registry import query, table
from lexloom.llm.words import SPACES

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
_BLANKS = SPACES.encode()
_ENDS = b".!?"
#: States: nothing yet, after the opening row, after a user's row, after an assistant's row. Complete ones may end.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_COMPLETE = (0, 3)
_WANTED = "uuau"
_NAME = {"u": "user", "a": "assistant"}
_BASE, _PRIME = 911_382_323, (1 << 61) - 1


class Node:
    """The last letter of an audit; the letters before it are its ancestors."""

    __slots__ = ("letter", "length", "hash", "parent", "jump")

    def __init__(self, letter: str, parent: Node | None) -> None:
        self.letter, self.parent = letter, parent
        if parent is None:
            self.length, self.hash, self.jump = 0, 0, self
            return
        self.length = parent.length + 1
        self.hash = (parent.hash * _BASE + ord(letter)) % _PRIME
        far = parent.jump
        # Two jumps of one length in a row make one of twice that and one more.
        self.jump = far.jump if parent.length - far.length == far.length - far.jump.length else parent

    def at(self, length: int) -> Node:
        """The ancestor of this length."""
        node = self
        while node.length > length:
            node = node.jump if node.jump.length >= length else node.parent
        return node

    def letters(self) -> str:
        out, node = [], self
        while node.parent is not None:
            out.append(node.letter)
            node = node.parent
        return "".join(reversed(out))


def same(a: Node, b: Node) -> bool:
    """Whether two nodes of equal length have the same letters: by hash, and then for certain."""
    if a is b:
        return True
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.parent, b.parent
    return True


def common(a: Node, b: Node) -> int:
    """Length of the longest common prefix."""
    n = min(a.length, b.length)
    a, b = a.at(n), b.at(n)
    while not same(a, b):
        if same(a.jump, b.jump):
            a, b = a.parent, b.parent  # the border lies within the jump
        else:
            a, b = a.jump, b.jump
    return a.length


def before(a: Node, b: Node) -> bool:
    """Whether the audit ``a`` is smaller in the order of ASCII."""
    n = common(a, b)
    if n == a.length or n == b.length:
        return a.length < b.length
    return a.at(n + 1).letter < b.at(n + 1).letter


class Way:
    """The cheapest edits that lead to a state, with the running digest of the rows they leave."""

    __slots__ = ("cost", "audit", "digest", "empty")

    def __init__(self, cost: int, audit: Node, digest: hashlib._Hash, empty: bool) -> None:
        self.cost, self.audit, self.digest, self.empty = cost, audit, digest, empty

    def after(self, cost: int, audit: Node, row: bytes | None) -> Way:
        """This way and one more edit, which leaves ``row`` if it leaves any."""
        if row is None:
            return Way(cost, audit, self.digest, self.empty)
        digest = self.digest.copy()
        digest.update(row if self.empty else b"\n" + row)
        return Way(cost, audit, digest, False)


class _Choice:
    """The best of the edits that lead to one state; the rows they leave are only hashed for the best."""

    def __init__(self) -> None:
        self.best: tuple[int, Node, bytes | None, Way] | None = None

    def offer(self, letter: str, cost: int, row: bytes | None, way: Way) -> None:
        cost += way.cost
        if self.best is None or cost <= self.best[0]:
            audit = Node(letter, way.audit)
            if self.best is None or cost < self.best[0] or before(audit, self.best[1]):
                self.best = (cost, audit, row, way)

    def take(self) -> Way:
        cost, audit, row, way = self.best
        return way.after(cost, audit, row)


def _with_inserts(ways: dict[int, Way]) -> dict[int, Way]:
    """Ways that go on by inserted rows. Two in a row lead back to a state at a cost, so one round of each kind does."""
    for state in (2, 3):
        choice = _Choice()
        for origin, way in sorted(ways.items()):
            wanted = _WANTED[origin]
            if origin != state and _NEXT.get((origin, wanted)) == state:
                choice.offer(INSERT, COST[INSERT], f"{_NAME[wanted]}:".encode(), way)
        if choice.best is None:
            continue
        old = ways.get(state)
        if old is None or choice.best[0] < old.cost or choice.best[0] == old.cost and before(choice.best[1], old.audit):
            ways[state] = choice.take()
    return ways


class Conversation:
    """Reads rows in order; tells faults, the cheapest audit and the digest of the repaired rows."""

    def __init__(self) -> None:
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.seen: set[bytes] = set()
        self.initial: str | None = None
        self.ways = _with_inserts({0: Way(0, Node("", None), hashlib.sha256(), True)})

    def read(self, turn: int | None, role: str, text: bytes) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        said = text.strip(_BLANKS)
        mark = hashlib.md5(b"%d:%b%b" % (len(role), role.encode(), text), usedforsecurity=False).digest()
        again = mark in self.seen
        self.seen.add(mark)
        stays, extra = True, 0
        if not said:
            self.blank, stays = self.blank + 1, False
        elif again:
            self.duplicate, stays = self.duplicate + 1, False
        elif said[-1] not in _ENDS:
            self.truncated, extra = self.truncated + 1, TRUNCATED
        self._edit(role, initial, text, stays, extra)

    def _edit(self, role: str, initial: str, text: bytes, stays: bool, extra: int) -> None:
        choices = [_Choice() for _ in _WANTED]
        kept = f"{role}:".encode() + text
        for state, way in sorted(self.ways.items()):
            choices[state].offer(DELETE, COST[DELETE], None, way)
            if not stays:
                continue
            after = _NEXT.get((state, initial)) if initial else state
            if after is not None:
                choices[after].offer(KEEP, COST[KEEP] + extra, kept, way)
            wanted = _WANTED[state]
            made = f"{_NAME[wanted]}:".encode() + text
            choices[_NEXT[state, wanted]].offer(REROLE, COST[REROLE] + extra, made, way)
        self.ways = _with_inserts({s: c.take() for s, c in enumerate(choices) if c.best is not None})

    def result(self) -> dict[str, object]:
        ends = [self.ways[s] for s in _COMPLETE if s in self.ways]
        best = ends[0]
        for way in ends[1:]:
            if way.cost < best.cost or way.cost == best.cost and before(way.audit, best.audit):
                best = way
        return {
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": best.cost, "audit": best.audit.letters(), "repaired_sha256": best.digest.hexdigest(),
        }


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_OUT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_SCHEMA = f"conv_id bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, repaired_sha256 string"


def _repair_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose rows come in order; the last one of a batch may go on in the next."""
    nothing = object()
    held, now, done = nothing, Conversation(), []
    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text", "live")]
        columns[3] = columns[3].cast(pa.binary())
        for conv, turn, role, text, live in zip(*(c.to_pylist() for c in columns), strict=True):
            if held is nothing or conv != held:
                if held is not nothing:
                    done.append({"conv_id": held} | now.result())
                held, now = conv, Conversation()
            if live:
                now.read(turn, role, text)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_OUT)
            done = []
    if held is not nothing:
        yield pa.RecordBatch.from_pylist([{"conv_id": held} | now.result()], schema=_OUT)


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits and the digest of the repaired rows.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and may have ``live``: a row that is not live only says that its
    conversation exists.
    """
    live = F.coalesce(F.col("live"), F.lit(True)) if "live" in rows.columns else F.lit(True)
    held = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), live.alias("live"),
    )
    dealt = held.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(_repair_sorted, _SCHEMA)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the checksum of ``conv_id:turn`` names; a dropped row stays as one that is not live."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    copies: Column = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    marked = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault"))
    return marked.withColumn("copy", F.explode(copies)).select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") != 0).alias("live"),
    )


def _sql() -> str:
    """The program as a recursion over the rows of all conversations, with whole audits and texts in each state."""
    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def edit(way: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
        left = f"list_append({way}.t, {line})" if line else f"{way}.t"
        return f"CASE WHEN {way} IS NOT NULL AND {when} THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 't': {left}}} END"

    def keep(way: str, initial: str) -> str:
        return edit(way, "extra", KEEP, "role || ':' || text", f"stays AND left(role, 1) = '{initial}'")

    def rerole(way: str, name: str) -> str:
        return edit(way, f"{COST[REROLE]} + extra", REROLE, f"'{name}:' || text", "stays")

    def gone(way: str) -> str:
        return edit(way, str(COST[DELETE]), DELETE)

    def insert(way: str, name: str) -> str:
        return edit(way, str(COST[INSERT]), INSERT, f"'{name}:'")

    users = [f(f"s{i}", x) for i in (0, 1, 3) for f, x in ((keep, "u"), (rerole, "user"))]
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE step AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
marked AS (
  SELECT * EXCLUDE (bytes, steps), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(steps[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 20 AS k
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes
        FROM conversations), step),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{word}') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN regexp_extract(text, '({word})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
edited AS (SELECT conv_id, i, role, text, fault NOT IN ('blank', 'duplicate') AS stays, (fault = 'truncated')::BIGINT AS extra FROM faults),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s1,
         {{'c': 2::BIGINT, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, {best("s3", insert("s2", "assistant"))} FROM (
    SELECT conv_id, i, s0, s1, s3, {best("s2", *(insert(f"s{i}", "user") for i in (0, 1, 3)))} AS s2 FROM (
      SELECT w.conv_id, e.i, {best(gone("s0"), keep("s0", ""))} AS s0, {best(gone("s1"), keep("s1", ""), keep("s0", "s"))} AS s1,
             {best(gone("s2"), keep("s2", ""), *users)} AS s2,
             {best(gone("s3"), keep("s3", ""), keep("s2", "a"), rerole("s2", "assistant"))} AS s3
      FROM walk w JOIN edited e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1))),
ended AS (SELECT conv_id, {best("s0", "s3")} AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS z FROM walk) WHERE z = 1),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT ended.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s.c AS cost, s.a AS audit, sha256(array_to_string(s.t, chr(10))) AS repaired_sha256
FROM ended LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ended.conv_id
"""


@query("op11_repair_roles", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
