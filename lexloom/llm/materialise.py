"""Token ids in training order: a keyed permutation gives every sequence its slot, shards of equal stride hold the slots in order.

1. The ids of the documents, each closed by an end id, are cut into sequences of ``length`` ids; the last one of a task may be shorter and
   is padded. The sequences are written once, as a table of packed blocks, and numbered from 0 without gaps by the counts of
   the tasks.
2. The slot of a sequence is its number under a Feistel permutation of the next even power of two; numbers that land beyond the
   last sequence are permuted again until they do not (cycle-walking). So each slot is taken once, the order depends on the
   key alone, and the number can be found from the slot.
3. A shard is a range of slots. Every task sends each shard its sequences packed together. One task writes it as records of equal size in the order of slots: number of ids,
   check sum, ids. Slot ``s`` begins at ``(s mod per_shard) * stride`` of shard ``s div per_shard``, so a reader can stop
   and go on anywhere. A shard is written beside its place and moved there when whole; a repeated task writes the same bytes.

Null and empty texts give their end id only. Repeated rows are tokenized as often as they come. An empty table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import files
from lexloom.llm.registry import query, table
from lexloom.llm.tokens import encoder
from lexloom.llm.words import chunks, mix
from lexloom.session import shared_dir
from lexloom.sources.store import materialise


#: Shards that a task reads back.
SHARDS_READ = 4


@dataclass(frozen=True)
class Layout:
    """Ids in a sequence, sequences in a shard, the key of the order, how ids are stored.

    ``per_block`` sequences are packed together for the table; a task that deals them out holds ``held_bytes`` at most.
    """

    length: int = 1024
    per_shard: int = 4096
    key: int = 20240
    rounds: int = 6
    end_id: int = 0
    id_type: str = "<u2"
    per_block: int = 128
    held_bytes: int = 48 << 20
    path: str | None = None

    @property
    def id_bytes(self) -> int:
        return self.length * np.dtype(self.id_type).itemsize

    @property
    def stride(self) -> int:
        return 8 + self.id_bytes


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of ``0 .. n - 1``."""

    n: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, -(-max(self.n - 1, 1).bit_length() // 2))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        keys = mix(np.arange(self.rounds, dtype=np.uint64) + np.uint64(self.key * 1000))
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(x.astype(np.uint64), back)
        while (out := np.flatnonzero(x >= self.n)).size:
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def sequences(docs: DataFrame, how: Layout) -> DataFrame:
    """Blocks of sequences in the order in which tasks read the documents.

    ``task``, ``no`` (of the first sequence in its task), ``n``, ``sizes`` (ids in each, 32 bits) and ``load`` (the ids, packed).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no = TaskContext.get().partitionId(), 0
        coder, rest, packer = encoder(how.path), np.zeros(0, np.uint32), zstandard.ZstdCompressor()

        def emit(ids: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
            if ids.size and int(ids.max()) > np.iinfo(how.id_type).max:
                raise ValueError(f"id {int(ids.max())} does not fit {how.id_type}")
            return pa.RecordBatch.from_pydict({
                "task": pa.array([task], pa.int32()), "no": pa.array([no], pa.int64()), "n": pa.array([len(sizes)], pa.int64()),
                "sizes": [np.array(sizes, "<u4").tobytes()], "load": [packer.compress(ids.astype(how.id_type).tobytes())],
            })

        whole = how.length * how.per_block
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in chunks(texts):
                ids, starts = coder.encode(texts[i:j])
                rest = np.concatenate([rest, np.insert(ids, starts[1:], np.uint32(how.end_id))])
                while len(rest) >= whole:
                    yield emit(rest[:whole], [how.length] * how.per_block)
                    no += how.per_block
                    rest = rest[whole:]
        if len(rest):
            n = -(-len(rest) // how.length)
            sizes = [min(how.length, len(rest) - k * how.length) for k in range(n)]
            yield emit(np.pad(rest, (0, n * how.length - len(rest)), constant_values=how.end_id), sizes)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "task int, no bigint, n bigint, sizes binary, load binary")


def deal(cut: DataFrame, how: Layout) -> tuple[DataFrame, int]:
    """The sequences by ``shard``, packed, with their ``slots``; also the number of sequences.

    The tasks, not the sequences, are summed up in one place.
    """
    counts = cut.groupBy("task").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # Written, so that Spark knows it to be a row for each task and sends it to the blocks, not the blocks to it.
    begins = materialise(counts.select("task", F.coalesce(before, F.lit(0)).alias("begin")), "begins")
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = Permutation(total, how.key, how.rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, opener = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
        slots: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        loads: list[np.ndarray] = []

        def emit() -> Iterator[pa.RecordBatch]:
            slot, size, load = np.concatenate(slots), np.concatenate(sizes), np.concatenate(loads)
            by = np.argsort(slot)
            shard = slot[by] // how.per_shard
            for part in np.split(by, np.flatnonzero(np.diff(shard)) + 1):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([int(slot[part[0]]) // how.per_shard], pa.int64()), "slots": [slot[part].astype("<i8").tobytes()],
                    "sizes": [size[part].tobytes()], "load": [packer.compress(load[part].tobytes())],
                })

        for batch in batches:
            for row in batch.to_pylist():
                number = row["begin"] + row["no"] + np.arange(row["n"])
                slots.append(order.slots(number))
                sizes.append(np.frombuffer(row["sizes"], "<u4"))
                loads.append(np.frombuffer(opener.decompress(row["load"]), np.uint8).reshape(row["n"], how.id_bytes))
                if sum(x.size for x in loads) >= how.held_bytes:
                    yield from emit()
                    slots, sizes, loads = [], [], []
        if loads:
            yield from emit()

    placed = cut.join(begins, "task").select("no", "n", "sizes", "load", "begin")
    return placed.mapInArrow(run, "shard bigint, slots binary, sizes binary, load binary"), order.n


def write_shards(dealt: DataFrame, root: str, how: Layout) -> DataFrame:
    """Write the shards below ``root``; returns ``shard``, ``records`` of each."""
    def write(group: pa.Table) -> pa.Table:
        shard, opener = group["shard"][0].as_py(), zstandard.ZstdDecompressor()
        slot = np.concatenate([np.frombuffer(x, "<i8") for x in group["slots"].to_pylist()])
        size = np.concatenate([np.frombuffer(x, "<u4") for x in group["sizes"].to_pylist()])
        load = b"".join(opener.decompress(x) for x in group["load"].to_pylist())
        system, base = files.store(root)
        system.create_dir(base, recursive=True)
        part = f"{base}/{files.fresh_name('part', '.tmp')}"
        with system.open_output_stream(part, compression=None) as out:
            for k in np.argsort(slot).tolist():
                ids = load[k * how.id_bytes:(k + 1) * how.id_bytes]
                out.write(np.array([size[k], zlib.crc32(ids)], "<u4").tobytes() + ids)
        system.move(part, f"{base}/{shard_name(shard)}")
        return pa.table({"shard": pa.array([shard], pa.int64()), "records": pa.array([len(slot)], pa.int64())})

    return materialise(dealt.groupBy("shard").applyInArrow(write, "shard bigint, records bigint"), "shards")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(root: str, how: Layout, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """The ids of the slots from ``first`` to before ``last``, shard by shard, each read from its place on."""
    system, base = files.store(root)
    slot = first
    while slot < last:
        shard, at = divmod(slot, how.per_shard)
        n = min(last - slot, how.per_shard - at)
        with system.open_input_file(f"{base}/{shard_name(shard)}") as file:
            file.seek(at * how.stride)
            for _ in range(n):
                record = file.read(how.stride)
                if len(record) < how.stride:
                    return
                size, check = np.frombuffer(record, "<u4", 2).tolist()
                if zlib.crc32(record[8:]) != check:
                    raise ValueError(f"slot {slot} is damaged")
                yield slot, np.frombuffer(record, how.id_type, size, 8)
                slot += 1


def read_back(shards: DataFrame, root: str, total: int, how: Layout) -> DataFrame:
    """What the shards hold: ``slot``, ``sequence`` (the number before the permutation), place, number of ids and check sum."""
    order = Permutation(total, how.key, how.rounds)
    names = ["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, records in zip(batch["shard"].to_pylist(), batch["records"].to_pylist(), strict=True):
                begin = shard * how.per_shard
                found = [(s, len(ids), zlib.crc32(ids.astype("<u4"))) for s, ids in read_slots(root, how, begin, begin + records)]
                slot, size, check = (np.array([f[k] for f in found], np.int64) for k in range(3))
                columns = [slot, order.numbers(slot), np.full(len(slot), shard), (slot - begin) * how.stride, size, check]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    # The rows only name the shards, so their bytes would put all of them into one task: a few shards make a task.
    tasks = -(-shards.count() // SHARDS_READ) or 1
    return shards.repartition(tasks, "shard").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


@query("op6_training_order")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    how, root = Layout(), shared_dir(spark, "training")
    cut = materialise(sequences(table(spark, sf_dir, "documents"), how), "sequences")
    dealt, total = deal(cut, how)
    return read_back(write_shards(dealt, root, how), root, total, how)
