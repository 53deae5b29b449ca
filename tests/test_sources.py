"""Containers against what was written, and against damage."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.functions import sniffing
from lumenflow.sources import containers as c


def test_ogg_packets_over_pages_and_gaps():
    packets = [b"a" * n for n in (0, 10, 255, 300, 5000)]
    for laces in (1, 3, 255):
        data = c.ogg_file(packets, 7, laces)
        assert [(s, n, size) for s, n, size, _, _ in c.ogg_packets(data)] == [(7, i, len(p)) for i, p in enumerate(packets)]
    data = c.ogg_file(packets, 7, 2)
    pages = list(c.ogg_pages(data))
    at, size = pages[4][4:6]  # within the last packet
    broken = data[:at] + data[at + size :]
    assert [n for _, _, n, _, _ in c.ogg_packets(broken)] == [0, 10, 255, 300]
    damaged = data[: at + 30] + b"!" + data[at + 31 :]
    assert [n for _, _, n, _, _ in c.ogg_packets(damaged)] == [0, 10, 255, 300]
    assert list(c.ogg_packets(b"")) == []


def test_mp4_tables():
    sizes, durations, shifts, syncs = [3, 1, 4, 1, 5], [10, 10, 20, 20, 10], [0, 5, -5, 0, 0], [True, False, False, True, False]
    rows = list(c.mp4_samples(c.mp4_file(sizes, durations, shifts, syncs, per_chunk=2)))
    assert [r[3] for r in rows] == sizes and [r[5] for r in rows] == durations and [r[7] for r in rows] == syncs
    assert [r[4] for r in rows] == [0, 10, 20, 40, 60] and [r[6] - r[4] for r in rows] == shifts
    assert [r[2] - rows[0][2] for r in rows] == [0, 3, 4, 8, 9]
    assert all(r[7] for r in c.mp4_samples(c.mp4_file(sizes, durations, [0] * 5, [True] * 5)))
    whole = c.mp4_file(sizes, durations, shifts, syncs)
    for end in range(0, len(whole), 7):
        list(c.mp4_samples(whole[:end]))  # damage is no error


@pytest.mark.parametrize("lacing, head", [(1, bytes([2, 255, 45, 4])), (2, bytes([2])), (3, bytes([2, 0x41, 0x2C]) + ((1 << 13) - 1 + (4 - 300) | 0x4000).to_bytes(2, "big"))])
def test_lacing(lacing, head):
    sizes = [300, 4, 7] if lacing != 2 else [5, 5, 5]
    data = head + bytes(sum(sizes))
    assert [n for _, n in c._laced(data, 0, len(data), lacing)] == sizes


def test_matroska_clusters_of_unknown_size_and_damage():
    frames = [(1, t, t % 2 == 0, bytes([t])) for t in range(6)]
    whole = c.matroska_file(frames, 2)
    assert [(t, k) for _, t, _, k, _, _ in c.matroska_frames(whole)] == [(t, t % 2 == 0) for t in range(6)]
    live = bytearray(whole)
    for mark in (b"\x18\x53\x80\x67", b"\x1f\x43\xb6\x75"):
        at = live.find(mark)
        while at >= 0:
            live[at + 4 : at + 12] = b"\x01" + b"\xff" * 7
            at = live.find(mark, at + 4)
    assert [t for _, t, *_ in c.matroska_frames(bytes(live))] == list(range(6))
    for end in range(0, len(whole), 5):
        list(c.matroska_frames(whole[:end]))


@pytest.mark.parametrize("fmt", list(c.WAV_FORMATS))
def test_pcm_formats(fmt):
    x = np.array([-1.0, -0.5, 0.0, 0.25, 1.0])
    data = c.pcm_bytes(x, fmt)
    step = 2.0 ** (1 - c.WAV_FORMATS[fmt][0]) if not c.WAV_FORMATS[fmt][1] else 1e-7
    assert np.abs(c.pcm_floats(data + b"\0" * (len(data) // 5 - 1), fmt) - x).max() <= step


def test_frames_chain():
    adts = bytes.fromhex("fff15080014000") + bytes(3)
    mp3 = bytes.fromhex("fffb1000") + bytes(100)
    assert sniffing.framed_format(b"zz" + adts * 3) == "adts" and sniffing.framed_format(mp3 * 3) == "mp3"
    assert sniffing.framed_format(mp3 + bytes(200)) is None and sniffing.framed_format(b"") is None
    assert sniffing.framed_format(adts + b"\0" * 20 + mp3 * 3) == "mp3"


def test_scan_of_nulls_and_many_rows(spark):
    sizes = [1] * 9000
    files = spark.createDataFrame([("a", c.mp4_file(sizes, sizes, [0] * 9000, [True] * 9000)), ("b", b""), ("c", None)], "path string, content binary")
    got = c.scan(files, "mp4_samples").selectExpr("count(*)", "count(distinct n)", "max(dts)").first()
    assert tuple(got) == (9000, 9000, 8999)
    assert c.read_wav(files).count() == 0 and struct.calcsize("<I") == 4


def test_rows_of_many_files_in_a_batch(spark):
    """Small files share a batch of rows, batches of files are small, and places are told from the first media data on."""
    import pyarrow as pa

    class Files:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [c.mp4_file([3, 1, 4], [1, 1, 1], [0, 0, 0], [True] * 3) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(300)), pa.string()), pa.array(files, pa.binary())], names=["path", "content"])
    got = list(c.scan(Files(), "mp4_samples")([batch, batch.slice(0, 0), batch]))
    assert [b.num_rows for b in got] == [1800]
    rows = got[0].to_pylist()
    assert [(r["path"], r["n"], r["size"], r["at"] - r["media"]) for r in rows[:6]] == [("0", 0, 3, 0), ("0", 1, 1, 3), ("0", 2, 4, 4), ("1", 0, 3, 0), ("1", 1, 1, 3), ("1", 2, 4, 4)]
    assert [b.num_rows for b in c.scan(Files(), "mp4_samples")([batch] * 5)] == [4096, 404]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_written_files_are_walked_as_written(spark):
    """Writers read the fields of their structs apart: nulls, empty arrays and slices included."""
    tracks = [[{"size": 3, "duration": 5, "shift": -1, "sync": True}, {"size": 2, "duration": 5, "shift": 0, "sync": False}], None, [], [{"size": 9, "duration": 1, "shift": 0, "sync": True}]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(tracks)], "path string, t array<struct<size: long, duration: long, shift: long, sync: boolean>>").coalesce(1)
    files = {r.path: r.f for r in df.select("path", c.mp4_writer(F.col("t")).alias("f")).collect()}
    want = [None if t is None else c.mp4_file(*([s[k] for s in t] for k in ("size", "duration", "shift", "sync"))) for t in tracks]
    assert [files[str(i)] for i in range(4)] == want
