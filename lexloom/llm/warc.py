"""WARC bundles that can be read from any record: Zstandard frames with a seek table at the end.

A bundle is a file of independent Zstandard frames, each with a few whole WARC records, and a last frame that decoders skip: the
seek table, with the compressed and the full size of every frame (format of the seekable Zstandard files). An index maps a
record's id to its bundle, frame and place in the frame, so one record costs one frame.

Records with equal payloads of at least ``least_revisit`` bytes are stored once: the smallest page id is the response, the others are revisits
that refer to it. Only digests are grouped, with map-side combine; the payloads are written by the tasks that read
them. A task that is repeated writes a new bundle, and the written index names the bundles that count.

Null html is an empty payload. Rows with a null page id can be revisits only. Rows that repeat (same id and payload) are
responses all. An empty table gives no bundle and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import files
from lexloom.llm.registry import query, table
from lexloom.session import shared_dir
from lexloom.sources.store import materialise

SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: The payload of a revisit is not in its record; this header keeps its length.
LENGTH_HEADER = "X-Payload-Length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Frames that a task reads back.
FRAMES_READ = 16


@dataclass(frozen=True)
class Bundles:
    """Bytes of records in a frame and in a bundle (before compression), and how records are dated."""

    frame_bytes: int = 1 << 20
    bundle_bytes: int = 1 << 30
    level: int = 3
    least_revisit: int = 100
    date: str = "1970-01-01T00:00:00Z"


def with_types(pages: DataFrame, least: int) -> DataFrame:
    """Add ``payload_digest``, ``payload_bytes``, ``record_type`` and ``refers_to`` to ``page_id``, ``url``, ``html``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint"), "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"),
    )
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n")
    ).where("n > 1 AND first_id IS NOT NULL").drop("n")
    shared = materialise(shared, "payloads")  # Spark then knows its size before it chooses the join
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(shared, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(row: dict, date: str) -> bytes:
    """One WARC record; a revisit has no block."""
    payload = row["html"].encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_id(row['page_id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_id(row['refers_to'])}", f"{LENGTH_HEADER}: {len(payload)}"]
        block = b""
    else:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        block = http.encode() + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Writes one bundle and tells the place of each record when its frame is closed."""

    def __init__(self, root: str, how: Bundles) -> None:
        self.how = how
        system, base = files.store(root)
        system.create_dir(base, recursive=True)
        self.name = files.fresh_name("bundle", ".warc.zst")
        self.out = system.open_output_stream(f"{base}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=how.level, write_content_size=True)
        self.held: list[bytes] = []
        self.ids: list[int | None] = []
        self.frames: list[tuple[int, int]] = []
        self.bytes = self.total = 0

    def add(self, page_id: int | None, data: bytes) -> list[tuple]:
        self.held.append(data)
        self.ids.append(page_id)
        self.bytes += len(data)
        self.total += len(data)
        return self.close_frame() if self.bytes >= self.how.frame_bytes else []

    def close_frame(self) -> list[tuple]:
        if not self.held:
            return []
        packed = self.pack.compress(b"".join(self.held))
        self.out.write(packed)
        rows, at = [], 0
        for page_id, data in zip(self.ids, self.held, strict=True):
            rows.append((page_id, self.name, len(self.frames), at, len(data)))
            at += len(data)
        self.frames.append((len(packed), at))
        self.held, self.ids, self.bytes = [], [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.close_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        return rows


_INDEX = "page_id bigint, bundle string, frame int, record_offset bigint, record_length bigint"
_INDEX_ARROW = pa.schema([
    ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()),
    ("record_offset", pa.int64()), ("record_length", pa.int64()),
])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def write_bundles(typed: DataFrame, root: str, how: Bundles = Bundles()) -> DataFrame:  # noqa: B008
    """Write every row as a record below ``root``; returns the index, itself written and read back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: BundleWriter | None = None
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                writer = writer or BundleWriter(root, how)
                rows += writer.add(row["page_id"], record(row, how.date))
                if writer.total >= how.bundle_bytes:
                    rows += writer.close()
                    writer = None
            yield _batch(rows, _INDEX_ARROW)
        if writer:
            yield _batch(writer.close(), _INDEX_ARROW)

    return materialise(typed.mapInArrow(run, _INDEX), "warc-index")


def seek_table(system: object, path: str) -> list[tuple[int, int, int]]:
    """Offset, packed size and full size of every frame, from the end of the file."""
    with system.open_input_file(path) as file:
        end = file.size()
        file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        file.seek(end - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", file.read(8 * n)))
    out, at = [], 0
    for packed, full in sizes:
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(file: object, at: int, packed: int, full: int) -> bytes:
    file.seek(at)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=full)
    if len(data) != full:
        raise ValueError("a frame is shorter than its seek table says")
    return data


def _number(text: str | None) -> int | None:
    value = text[len("<urn:page:"):-1] if text else "null"
    return None if value == "null" else int(value)


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each record from ``at`` on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = data[end + 4:end + 4 + size]
        yield at, head, block.partition(b"\r\n\r\n")[2]
        at = end + 4 + size + 4


_FOUND = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()),
    ("record_offset", pa.int64()),
])


def _described(at: int, head: dict[str, str], payload: bytes, bundle: str, frame: int) -> tuple:
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(head.get(LENGTH_HEADER, len(payload)))
    if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    return (
        _number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _number(head.get("WARC-Refers-To")), bundle, frame, at,
    )


def read_bundles(bundles: DataFrame, root: str) -> DataFrame:
    """Every record of the bundles named in ``bundle``; frames are found by the seek tables and read by many tasks."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files.store(root)
        schema = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("packed", pa.int64()), ("full", pa.int64())])
        for batch in batches:
            rows = [(b, i, *f) for b in batch.column(0).to_pylist() for i, f in enumerate(seek_table(system, f"{base}/{b}"))]
            yield _batch(rows, schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files.store(root)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['bundle']}") as file:
                    data = read_frame(file, row["at"], row["packed"], row["full"])
                yield _batch([_described(*x, row["bundle"], row["frame"]) for x in parse(data)], _FOUND)

    frames = bundles.select("bundle").distinct().mapInArrow(tables, "bundle string, frame int, at bigint, packed bigint, full bigint")
    frames = materialise(frames, "frames")
    # The rows only name the frames, so their bytes would put all of them into one task: some frames make a task.
    spread = frames.repartition(-(-frames.count() // FRAMES_READ) or 1, "bundle", "frame")
    return spread.mapInArrow(
        records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "bundle string, frame int, record_offset bigint"
    )


def read_record(root: str, bundle: str, frame: int, record_offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, from the one frame that holds it."""
    system, base = files.store(root)
    at, packed, full = seek_table(system, f"{base}/{bundle}")[frame]
    with system.open_input_file(f"{base}/{bundle}") as file:
        _, head, payload = next(parse(read_frame(file, at, packed, full), record_offset))
    return head, payload


_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op4_warc_bundles", _SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = Bundles()
    root = shared_dir(spark, "warc")
    typed = with_types(table(spark, sf_dir, "pages").select("page_id", "url", "html"), how.least_revisit)
    index = write_bundles(typed, root, how)
    return read_bundles(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
