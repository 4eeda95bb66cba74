"""Which strings stand in the lines of their own document, with bounded text beside each string.

A document of ordinary length stands beside its strings and is searched for each. A long one is cut into blocks at ends of lines, and its
distinct strings are packed into parts, both of bounded size; each block meets each part once. A scan of the block looks up,
place by place, what begins there: a table from the first characters to the lengths of the strings that begin so, and the
strings. So a pair costs its block's length, not strings times length, and all that comes out of it are the
numbers of the strings that were found. A document with very many sentences is many pairs, which any task may take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.sources.store import materialise

#: Characters of a document that stands beside its strings.
LONG = 1 << 18
#: Characters of a document in a block (a longer line is a block of its own), and strings in a part.
BLOCK, PART = 1 << 21, 1 << 17
#: Characters by which strings are looked up; so many strings or fewer are searched for one by one, which is faster.
HEAD, FEW = 8, 100


def cut_blocks(text: str, size: int) -> list[str]:
    """A text in pieces of about ``size`` characters, cut at ends of lines."""
    out, start = [], 0
    while len(text) - start > size:
        end = text.rfind("\n", start, start + size)
        if end < 0:
            end = text.find("\n", start + size)
        if end < 0:
            break
        out.append(text[start:end])
        start = end + 1
    return [*out, text[start:]]


class Strings:
    """Strings by their first characters and lengths."""

    def __init__(self, strings: list[str]) -> None:
        by_size: dict[int, dict[str, dict[int, set[str]]]] = {}
        self.single: list[str] = []
        sized: dict[int, set[str]] = {}
        for s in filter(None, strings):
            sized.setdefault(min(len(s), HEAD), set()).add(s)
        for size, some in sized.items():
            if len(some) <= FEW:
                self.single += some
                continue
            heads = by_size.setdefault(size, {})
            for s in some:
                heads.setdefault(s[:HEAD], {}).setdefault(len(s), set()).add(s)
        self.tables = [(size, {h: list(x.items()) for h, x in heads.items()}) for size, heads in by_size.items()]

    def inside(self, text: str) -> set[str]:
        """Those that stand in a text."""
        out = {s for s in self.single if s in text}
        for size, heads in self.tables:
            if len(heads) <= FEW:
                places = (at for head in heads for at in _places(text, head))
            else:
                places = (at for at in range(len(text) - size + 1) if text[at:at + size] in heads)
            for at in places:
                out.update(text[at:at + n] for n, some in heads[text[at:at + size]] if text[at:at + n] in some)
        return out


def _places(text: str, head: str) -> Iterator[int]:
    at = text.find(head)
    while at >= 0:
        yield at
        at = text.find(head, at + 1)


def _blocks(size: int) -> Callable[[Column], Column]:
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut_blocks(t, size) for t in texts.to_pylist()], pa.list_(pa.string()))

    return cut


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _contained(blocks: pa.Array, wanted: pa.Array) -> pa.Array:
    """Numbers of the strings that stand in the block; the empty one always does."""
    out, last, strings = [], None, Strings([])
    for block, some in zip(blocks.to_pylist(), wanted.to_pylist(), strict=True):
        if some is not last:
            last, strings = some, Strings(some)
        found = strings.inside(block)
        out.append([i for i, s in enumerate(some) if not s or s in found])
    return pa.array(out, pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _in_order(blocks: pa.Array, wanted: pa.Array) -> pa.Array:
    """Numbers of the lists of strings that stand in one line of the block, in order and apart; the empty one always does.

    A list is only tried in the lines that hold its longest string.
    """
    out = []
    for block, some in zip(blocks.to_pylist(), wanted.to_pylist(), strict=True):
        hardest = [max(parts, key=len) if parts else "" for parts in some]
        waiting: dict[str, list[int]] = {}
        for i, s in enumerate(hardest):
            waiting.setdefault(s, []).append(i)
        good = set(waiting.get("", []))
        strings = Strings(hardest)
        for line in block.split("\n"):
            for s in strings.inside(line):
                left = []
                for i in waiting[s]:
                    at = 0
                    for part in some[i]:
                        at = line.find(part, at)
                        if at < 0:
                            break
                        at += len(part)
                    if at < 0:
                        left.append(i)
                    else:
                        good.add(i)
                waiting[s] = left
        out.append(sorted(good))
    return pa.array(out, pa.list_(pa.int32()))


def _in_long(rows: DataFrame, docs: DataFrame, keys: list[str], digest: Column, look: Callable, block: int, part: int) -> DataFrame:
    """The keys and ``_id`` (digest) of what is wanted and was found in some block of its document."""
    asked = rows.select(*keys, digest.alias("_id"), "_wanted")
    sizes = asked.groupBy(*keys).agg(F.ceil(F.count("*") / part).cast("int").alias("_parts"))
    dealt = asked.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    lists = dealt.groupBy(*keys, "_part").agg(F.collect_set(F.struct("_id", "_wanted")).alias("_some"))
    blocks = docs.join(sizes, keys).select(*keys, F.explode(_blocks(block)("_doc")).alias("_block"), "_parts")
    blocks = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    pairs = blocks.join(lists, [*keys, "_part"])
    hits = look("_block", F.transform("_some", lambda x: x["_wanted"]))
    return pairs.select(*keys, F.explode(F.transform(hits, lambda i: F.get("_some", i)["_id"])).alias("_id")).distinct()


def _flagged(
    rows: DataFrame, docs: DataFrame, keys: list[str], wanted: Column, able: Column, beside: Column, digest: Column, look: Callable,
    long: int, block: int, part: int,
) -> DataFrame:
    """``rows`` with ``verbatim``: whether what is wanted stands in the row's document."""
    columns = [F.col(c) for c in rows.columns if c != "verbatim"]
    is_long = F.col("_size") > long
    texts = docs.select(*keys, F.when(~is_long, F.col("_doc")).alias("_doc"), is_long.alias("_long"))
    # Made from the row once it has met its document, so that the join moves each text once.
    met = rows.join(texts, keys, "left").withColumn("_wanted", wanted)
    able = F.coalesce(able, F.lit(False))
    usual = met.where(~F.coalesce("_long", F.lit(False))).select(*columns, (able & F.coalesce(beside, F.lit(False))).alias("verbatim"))
    longer = docs.where(is_long)
    if longer.isEmpty():
        return usual
    rest = materialise(met.where("_long").select(*columns, F.when(able, F.col("_wanted")).alias("_wanted")), "verbatim")
    found = _in_long(rest.where("_wanted IS NOT NULL"), longer, keys, digest, look, block, part).withColumn("_met", F.lit(True))
    told = rest.withColumn("_id", F.coalesce(digest, F.lit(""))).join(found, [*keys, "_id"], "left")
    return usual.unionByName(told.select(*columns, F.coalesce("_met", F.lit(False)).alias("verbatim")))


def flag_contained(
    rows: DataFrame, docs: DataFrame, keys: list[str], wanted: Column, long: int = LONG, block: int = BLOCK, part: int = PART
) -> DataFrame:
    """Add ``verbatim``: ``wanted`` stands in one line of ``_doc``. ``docs`` has the keys, ``_doc`` and its ``_size``, a row for each."""
    able = ~F.col("_wanted").contains("\n")
    beside = F.col("_doc").contains(F.col("_wanted"))
    return _flagged(rows, docs, keys, wanted, able, beside, F.md5("_wanted"), _contained, long, block, part)


def flag_in_order(
    rows: DataFrame, docs: DataFrame, keys: list[str], wanted: Column, long: int = LONG, block: int = BLOCK, part: int = PART
) -> DataFrame:
    """Add ``verbatim``: the strings of ``wanted`` (an array, none of them empty) stand in one line of ``_doc``, in order and apart."""
    able = ~F.exists("_wanted", lambda p: p.contains("\n"))

    def ordered(line: Column) -> Column:
        """The place after the last string, each looked for behind the one before it; 0 if one is missing."""
        def behind(at: Column, p: Column) -> Column:
            here = F.call_function("locate", p, line, at)
            return F.when(at == 0, F.lit(0)).when(here == 0, F.lit(0)).otherwise(here + F.length(p))

        return F.aggregate("_wanted", F.lit(1), behind) > 0

    beside = F.exists(F.split("_doc", "\n"), ordered)
    digest = F.md5(F.array_join("_wanted", "\n"))
    return _flagged(rows, docs, keys, wanted, able, beside, digest, _in_order, long, block, part)
