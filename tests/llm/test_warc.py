import gzip
import hashlib
import io
import os
import random

import pytest

from lumenflow.llm import common, warc_split


def test_round_trip_with_revisits(spark):
    big, other = "x" * 1000, "é" * 700
    rows = [(1, "u", big), (2, "u", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", other), (None, "u", big), (8, "u", other)]
    got = {r.page_id: r for r in warc_split.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest")).collect()}
    assert len(got) == len(rows)
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 8), 8: ("response", None), None: ("revisit", 3)}
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())


def test_payloads_and_plain_gzip(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(20)], "page_id long, url string, html string")
    manifest = warc_split.write_archives(pages, common.fresh_path(spark, "warc-test"))
    got = {r.page_id: bytes(r.payload) for r in warc_split.read_archives(manifest, range_bytes=500, payloads=True).collect()}
    assert got == {i: (f"<p>{i}</p>" * 50).encode() for i in range(20)}
    for r in manifest.collect():
        assert gzip.decompress(warc_split.open_input(r.path).read()).count(b"WARC/1.1") == r.records + 1


@pytest.mark.parametrize("size", [1, 777, 50_000, 1 << 30])
def test_ranges_own_each_record_once(size):
    rng, data = random.Random(1), b""
    for i in range(30):
        body = os.urandom(rng.choice([0, 9, 3000])) if i % 2 else warc_split.MAGIC * rng.randint(1, 300)
        data += warc_split._member(warc_split._page_record(i, "u", body, None), 0 if i % 3 else 6)
    stop = min(len(data), 3000) if size == 1 else len(data)
    got = [int(h["x-page-id"]) for s in range(0, stop, size) for h, _ in warc_split.records_in_range(io.BytesIO(data), s, s + size)]
    assert got == list(range(30)) if stop == len(data) else got == list(range(len(got)))


def test_header_of_any_length():
    data = b"".join(warc_split._member(warc_split._page_record(i, "u" * n, b"x", None), 6) for i, n in enumerate((1, (1 << 20) + 1, 3 << 20, 1)))
    got = [(int(h["x-page-id"]), len(h["warc-target-uri"])) for h, _ in warc_split.records_in_range(io.BytesIO(data), 0, len(data))]
    assert got == [(0, 1), (1, (1 << 20) + 1), (2, 3 << 20), (3, 1)]


def test_empty_table(spark):
    assert warc_split.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
