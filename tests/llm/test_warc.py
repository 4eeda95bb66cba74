"""Archives are read back whole, frame by frame and record by record."""

import io

import pytest
import zstandard
from lexloom.llm import files
from lexloom.llm import warc as W
from lexloom.session import shared_dir

LONG = "é" * 60
ROWS = [
    (7, "http://x/7", LONG), (3, "http://x/3", LONG), (3, "http://x/3", LONG), (9, None, LONG), (None, "u\r\nEvil: 1", LONG), (1, "u", "short"),
    (2, "u", "short"), (4, "u", None), (5, "u", ""), (6, "u", "a\r\n\r\nb" * 40), (8, "u", "q" * 3_000_000), (None, None, "n" * 200),
]


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, frame string").repartition(3)
    how = W.Bundles(frame_bytes=300)
    root = shared_dir(spark, "warc")
    index = W.write_bundles(W.with_types(pages, how.least_revisit), root, how)
    return root, index, W.read_bundles(index, root).collect()


def test_records(archive):
    _, _, got = archive
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert len(got) == len(ROWS)
    assert by[3] == [("response", None, 120)] * 2 and by[7] == by[9] == [("revisit", 3, 120)]
    assert sorted(by[None], key=str) == [("response", None, 200), ("revisit", 3, 120)]
    assert all(by[i] == [("response", None, n)] for i, n in ((1, 5), (2, 5), (4, 0), (5, 0), (6, 240), (8, 3_000_000)))


def test_one_record_costs_one_frame(archive):
    root, index, _ = archive
    payloads = {r[0]: r[2] or "" for r in ROWS}
    for row in index.collect():
        head, payload = W.read_record(root, row.bundle, row.frame, row.record_offset)
        assert head["WARC-Record-ID"] == W._id(row.page_id)
        if head["WARC-Type"] == "response" and row.page_id is not None:
            assert payload.decode() == payloads[row.page_id]


def test_bundles_are_plain_zstandard(archive):
    root, index, _ = archive
    system, base = files.store(root)
    for bundle in {r.bundle for r in index.collect()}:
        with system.open_input_file(f"{base}/{bundle}") as file:
            data = file.read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        table = W.seek_table(system, f"{base}/{bundle}")
        assert len(whole) == sum(full for _, _, full in table)
        assert whole.startswith(b"WARC/1.1\r\n") and b"\nEvil" not in whole


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    root = shared_dir(spark, "warc")
    assert W.read_bundles(W.write_bundles(W.with_types(pages, 100), root), root).count() == 0


def test_reading_back_is_spread(spark):
    """Tasks in proportion to frames, however few bytes name them."""
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id as string), 200) AS html")
    how = W.Bundles(frame_bytes=1000)
    root = shared_dir(spark, "warc")
    found = W.read_bundles(W.write_bundles(W.with_types(pages, 100), root, how), root)
    frames = found.select("bundle", "frame").distinct().count()
    assert frames > 100 and found.rdd.getNumPartitions() >= frames // W.FRAMES_READ
