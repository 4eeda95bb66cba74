"""Near duplicates of vectors: sign hashing on random hyperplanes in several tables, exact cosines, components.

Equal vectors are one class from the start. A table hashes the signs of a class's products with ``bits`` random
planes; classes with equal signs in a table share a bucket. In a bucket all cosines are computed in double precision and compared
with the threshold. A pair is counted in the first table in which it meets (each class carries its hashes of all
tables), so links are counted without writing the pairs; only the pairs that join two trees of the bucket go on to the
distributed components.

A bucket with more than ``tile`` classes is cut into parts, and each two parts are compared in a task of their own, so no
task holds more than two parts and no pair is lost.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different length
are not compared. Rows with the same id and equal vectors count as separate rows. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.components import Forest, components
from lexloom.llm.registry import query, table
from lexloom.sources.store import materialise


@dataclass(frozen=True)
class Hashing:
    """How vectors are hashed and compared.

    At cosine 0.95 a plane gives equal signs with probability 0.899, so 24 tables of 12 miss a pair in 2,500.
    """

    threshold: float = 0.95
    tables: int = 24
    bits: int = 12
    tile: int = 2048
    slot: int = 32
    seed: int = 20

    @classmethod
    def for_rows(cls, n: int, threshold: float = 0.95, miss: float = 4e-4) -> Hashing:
        """Bits that leave a bucket some sixteen of ``n`` unrelated vectors, and tables for the chance to miss a pair.

        So the vectors that are compared for each one do not grow with the table, the tables do a little.
        """
        bits = max(12, math.ceil(math.log2(max(n, 1) / 16)))
        meet = (1 - math.acos(threshold) / math.pi) ** bits
        return cls(threshold=threshold, bits=bits, tables=math.ceil(math.log(miss) / math.log1p(-meet)))


def planes(how: Hashing, size: int) -> np.ndarray:
    """The hyperplanes for vectors of one length: a row for each bit of each table."""
    draw = np.random.Generator(np.random.PCG64([how.seed, size]))
    return draw.standard_normal((how.tables * how.bits, size))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _hashes(how: Hashing):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def hashes(vector: pa.Array) -> pa.Array:
        sizes = vector.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(vector), how.tables), np.int32)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            m = _matrix(vector.take(pa.array(at)), int(size))
            signs = (m @ planes(how, int(size)).T > 0).reshape(len(at), how.tables, how.bits)
            out[at] = signs @ (1 << np.arange(how.bits))
        flat = pa.array(out.ravel())
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, how.tables, dtype=np.int32), flat)

    return hashes


def _links(how: Hashing):
    """Links inside the buckets of a slot, or between two parts of one bucket.

    Gives a row for each class with links and one for each joining pair.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("code", "ascending"), ("cls", "ascending")])
        cls, own, copies, code = (group[c].to_numpy() for c in ("cls", "part", "copies", "code"))
        m = _matrix(group["vector"], len(group["vector"][0]))
        m = m / np.abs(m).max(axis=1, keepdims=True)  # keeps the squares in range
        m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
        codes = group["hashes"].combine_chunks().flatten().to_numpy().reshape(len(cls), how.tables)
        no, i, j = (group[c][0].as_py() for c in ("table", "part_a", "part_b"))
        links = np.zeros(len(cls), np.int64)
        forest = Forest(len(cls))
        tied: list[tuple[int, int]] = []

        def compare(rows: np.ndarray, other: np.ndarray) -> None:
            a, b = np.nonzero(m[rows] @ m[other].T >= how.threshold)
            a, b = rows[a], other[b]
            keep = a < b if i == j else a != b
            a, b = a[keep], b[keep]
            if no and len(a):  # a pair that shares an earlier bucket was counted there
                fresh = ~(codes[a, :no] == codes[b, :no]).any(axis=1)
                a, b = a[fresh], b[fresh]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            tied.extend((x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y))

        edges = np.flatnonzero(np.diff(code, prepend=code[0] - 1, append=code[-1] + 1))
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            bucket = np.arange(begin, end)
            rows, other = bucket[own[bucket] == i], bucket[own[bucket] == j]
            for at in range(0, len(rows), 256):
                compare(rows[at:at + 256], other)
        held = np.flatnonzero(links)
        left = [*cls[held].tolist(), *(int(cls[x]) for x, _ in tied)]
        right = [*[None] * len(held), *(int(cls[y]) for _, y in tied)]
        return pa.table({
            "cls": pa.array(left, pa.int64()), "to": pa.array(right, pa.int64()),
            "links": pa.array([*links[held].tolist(), *[0] * len(tied)], pa.int64()),
        })

    return run


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", how: Hashing | None = None) -> DataFrame:
    """``key``, ``n_links``, ``component_id``, ``kept`` for every row.

    ``n_links`` is the number of other rows linked directly; ``component_id`` the smallest key that can be reached.
    """
    how = how or Hashing.for_rows(rows.count())
    held = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    plain = F.transform("vector", lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one value
    held = held.withColumn("vector", F.when(sound, plain))
    # A class has a number of its own, as an id may stand before several vectors.
    classes = held.where("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = classes.select("*", F.monotonically_increasing_id().alias("cls"), _hashes(how)("vector").alias("hashes"))
    classes = materialise(classes, "classes")

    placed = classes.select(
        "*", F.size("vector").alias("width"), F.posexplode("hashes").alias("table", "code")
    )
    sizes = placed.groupBy("width", "table", "code").agg(F.count("*").alias("n")).where("n > 1")
    tiles = placed.join(sizes, ["width", "table", "code"]).withColumn("parts", F.ceil(F.col("n") / how.tile).cast("int"))
    tiles = tiles.withColumn("part", F.pmod(F.xxhash64("cls", "table"), F.col("parts")).cast("int"))
    alone = F.floor(F.col("code") / how.slot)  # small buckets go to a task by the dozen
    tiles = tiles.withColumn("slot", F.when(F.col("parts") == 1, alone).otherwise(-1 - F.col("code")).cast("int"))
    tiles = tiles.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cls", "copies", "vector", "hashes", "width", "table", "code", "slot", "part",
        F.least("part", "with").alias("part_a"), F.greatest("part", "with").alias("part_b"),
    )
    found = tiles.groupBy("width", "table", "slot", "part_a", "part_b").applyInArrow(
        _links(how), "cls bigint, to bigint, links bigint"
    )
    found = materialise(found, "links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    trees = components(found.where("to IS NOT NULL").select(F.col("cls").alias("a"), F.col("to").alias("b")))
    trees = trees.select(F.col("id").alias("cls"), F.col("component_id").alias("tree"))
    least = classes.select("cls", "least").join(trees, "cls").groupBy("tree").agg(F.min("least").alias("component"))
    verdict = (
        classes.select("cls", "least", "copies", "vector").join(counts, "cls", "left")
        .join(trees.join(least, "tree"), "cls", "left")
        .select("vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                F.coalesce("component", "least").alias("component"))
    )
    component = F.coalesce("component", "id")
    return held.join(verdict, "vector", "left").select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.r AS x, b.r AS y FROM sound a JOIN sound b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r AS x, r AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
part AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN v ON v.r = y GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.x = v.r) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v JOIN part ON part.x = v.r
"""


@query("op9_near_vectors", _SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
