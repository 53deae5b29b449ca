"""Subtitles, headers, checksums, containers and streams at their boundaries."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumenflow.functions import checksums, headers
from lumenflow.operators import clusters, signal, subtitles, timeline
from lumenflow.sources import containers
from lumenflow.streaming import packets


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_srt(spark):
    doc = "﻿1\r\n00:00:01,000 --> 00:00:02,5 X1:3\r\nfirst\r\nsecond  \r\n \r\nrubbish\n\n\nid\n00:00:09,000 --> 00:00:03,000\nback"
    cues, skipped = one(spark, subtitles.srt_cues(F.lit(doc)), subtitles.skipped_srt(F.lit(doc)))
    assert [(c.name, c.start_us, c.end_us, c.body) for c in cues] == [("1", 1_000_000, 2_500_000, "first\nsecond"), ("id", 9_000_000, 9_000_000, "back")]
    assert skipped == 1 and cues[0].settings == "X1:3"
    assert list(one(spark, subtitles.srt_cues(F.lit("")), subtitles.srt_cues(F.lit(None).cast("string")))) == [[], None]


def test_webvtt(spark):
    doc = "WEBVTT head\nmore\n\nNOTE a\n00:01.000 --> 00:02.000\n\nSTYLE\nx\n\n00:01.000 --> 00:02.000 align:start size:50%\nhi\n\nbroken\n\nNOTED\n00:03.000 --> 00:04.000\nyes"
    cues, skipped = one(spark, subtitles.webvtt_cues(F.lit(doc)), subtitles.skipped_webvtt(F.lit(doc)))
    assert [(c.name, c.start_us, c.body) for c in cues] == [(None, 1_000_000, "hi"), ("NOTED", 3_000_000, "yes")]
    assert skipped == 1
    assert list(one(spark, *(subtitles.webvtt_setting(F.lit(cues[0].settings), s) for s in ("align", "size", "line")))) == ["start", "50%", None]
    assert [c.body for c in one(spark, subtitles.webvtt_cues(F.lit("00:01.000 --> 00:02.000\nbare")))[0]] == ["bare"]


def test_ass(spark):
    doc = "[Script Info]\nTitle: x\n[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.50,a, b\\N{\\b1}c\nComment: 0:00:01.00,0:00:02.00,no\nDialogue: bad,0:00:02.00,no\n[Fonts]\nDialogue: 0:00:01.00,0:00:02.00,no"
    cues = one(spark, subtitles.ass_cues(F.lit(doc)))[0]
    assert [(c.start_us, c.end_us, c.style, c.body) for c in cues] == [(1_000_000, 2_500_000, None, "a, b\\N{\\b1}c")]
    assert one(spark, subtitles.ass_text(F.lit(cues[0].body)))[0] == "a, b\nc"
    assert one(spark, subtitles.ass_cues(F.lit("nothing")))[0] == []


def test_checksums(spark):
    digits = F.lit(b"123456789")
    assert list(one(spark, checksums.crc8(digits), checksums.crc16(digits), checksums.crc16_mpeg(digits), checksums.adler32(digits), checksums.crc8(F.lit(None).cast("binary")))) == [0xF4, 0xFEE8, 0xAEE7, zlib.adler32(b"123456789"), None]
    by_bits = 0
    for b in b"OggS and more":
        by_bits ^= b << 24
        for _ in range(8):
            by_bits = (by_bits << 1 ^ (0x04C11DB7 if by_bits >> 31 else 0)) & 0xFFFFFFFF
    assert checksums.ogg_crc_of(b"OggS and more") == by_bits


def test_headers(spark):
    got = one(spark, headers.mpeg_audio(F.lit(bytes.fromhex("fffb9064"))), headers.ac3(F.lit(bytes.fromhex("0b77000014"))), headers.adts(F.lit(bytes.fromhex("fff15080"))), headers.png(F.lit(b"\x89PNG")), headers.mpeg_audio(F.lit(b"")))
    assert (got[0].kbps, got[0].rate, got[0].frame_bytes, got[0].channels) == (128, 44100, 417, 2)
    assert (got[1].kbps, got[1].rate, got[1].frame_bytes) == (192, 48000, 768)
    assert list(got)[2:] == [None, None, None]
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + (44100 << 12 | 1 << 9 | 15 << 4 | 1).to_bytes(4, "big") + struct.pack(">I", 5) + bytes(16)
    flac = one(spark, headers.flac_stream_info(F.lit(info)))[0]
    assert (flac.rate, flac.channels, flac.bits, flac.samples) == (44100, 2, 16, (1 << 32) + 5)
    opus = one(spark, headers.opus_head(F.lit(b"OpusHead\x01\x02\x38\x01\x80\xbb\x00\x00\xff\xff\x00")))[0]
    assert (opus.channels, opus.pre_skip, opus.input_rate, opus.gain) == (2, 312, 48000, -1)
    gap = one(spark, headers.gapless(F.lit(10), F.lit(1152), F.lit(576), F.lit(1000)))[0]
    assert (gap.skip, gap.total) == (1105, 11520 - 471)


def scanned(spark, kind, *files):
    rows = spark.createDataFrame([(str(i), f) for i, f in enumerate(files)], "path string, content binary")
    return [tuple(r)[2:] for r in containers.scan(rows, kind).orderBy("path", "n").collect()]


def test_containers(spark):
    riff = b"RIFF\0\0\0\0WAVE" + b"LIST\x03\0\0\0abc\0" + b"data\xff\0\0\0xy"
    assert scanned(spark, "riff", riff, b"", None) == [("LIST", 20, 3), ("data", 32, 2)]
    pages = [containers.ogg_page(7, i, i * 10, 0, [b"a" * 300, b"b"]) for i in range(3)]
    bad = pages[1][:-1] + b"?"
    got = scanned(spark, "ogg", b"junk" + pages[0] + bad + pages[2])
    assert [(s, g, ok) for _, s, g, _, _, _, _, ok in got] == [(0, 0, True), (1, 10, False), (2, 20, True)] and got[0][6] == 2
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    file = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"tkhd", b"")) + box(b"udta", b"")) + struct.pack(">I4s", 0, b"mdat") + b"zz"
    assert [r[0] for r in scanned(spark, "mp4", file)] == ["/ftyp", "/moov", "/moov/trak", "/moov/trak/tkhd", "/moov/udta", "/mdat"]
    frame = bytes.fromhex("fff1508001") + bytes([0x5F, 0xFC]) + b"abc"
    assert scanned(spark, "adts", b"\xff\x00" + frame + frame) == [(2, 10), (12, 10)]
    flac = b"fLaC" + b"\x00\0\0\x02ab" + b"\x84\0\0\x01c" + b"rest"
    assert scanned(spark, "flac", flac, b"fLaC\x00\0\0\xff") == [(0, 8, 2, False), (4, 14, 1, True)]


def test_clusters():
    assert clusters.cut_clusters([0, 10, 29_999, 30_000, 30_001, 30_002], [1] * 6, [False] * 4 + [True, False]) == [0, 0, 0, 1, 2, 2]
    assert clusters.cut_clusters([0, 1, 2], [5, 5, 5], [False] * 3, most_bytes=10) == [0, 0, 1]
    assert clusters.cut_clusters([], [], []) == []


def test_cluster_rows(spark):
    rows = spark.createDataFrame([(s, t, 1, False) for s in (1, 2) for t in (0, 40_000, 10)], "s int, ms long, size int, key boolean")
    got = {(r.s, r.ms): r.cluster for r in clusters.assign_clusters(rows, "s", ["ms"], "ms", "size", "key").collect()}
    assert got == {(s, t): int(t == 40_000) for s in (1, 2) for t in (0, 10, 40_000)}


def test_display_order():
    assert clusters.display_order([0, 4, 2, 1, 3, 0, 1], [True] + [False] * 4 + [True, False], 2) == [0, 3, 2, 4, 1, 5, 6]


def test_transforms():
    import numpy as np

    two, three, four = (np.array(f(8)) for f in (signal.dct2_rows, signal.dct3_rows, signal.dct4_rows))
    assert np.allclose(three @ two, 4 * np.eye(8)) and np.allclose(four @ four, 4 * np.eye(8))
    w = np.array(signal.kbd_window(16, 4))
    assert np.allclose(w[:8] ** 2 + w[8:] ** 2, 1)


def test_remap(spark):
    code = lambda *v: tuple(map(F.lit, v))
    assert tuple(one(spark, *signal.remap(*code(100, 128, 128), "bt601", "bt709"))) == (100, 128, 128)
    assert tuple(one(spark, *signal.remap(*code(0, 0, 255), "bt601", "bt709"))) == (0, 12, 248)
    assert tuple(one(spark, *signal.remap(*code(1, 2, 3), "bt709", "bt2020"))) == (1, 2, 3)


def test_visible(spark):
    points = spark.createDataFrame([(1, t) for t in (-5, 0, 9, 10, 25, None)], "s int, t long")
    cues = spark.createDataFrame([(1, "a", -7, 10), (1, "b", 9, 26), (1, "none", 9, 9), (2, "other", 0, 99)], "s int, cue string, x long, y long")
    got = timeline.visible(points, cues, "s", "t", "x", "y", 10).select("t", "cue").collect()
    assert sorted(map(tuple, got)) == [(-5, "a"), (0, "a"), (9, "a"), (9, "b"), (10, "b"), (25, "b")]


@pytest.mark.parametrize("most", [0, 2])
def test_stream_reorder(spark, tmp_path, most):
    for i, part in enumerate([[(1, 3), (1, 1), (2, 5)], [(1, 2), (1, 4)], [(1, None), (2, None)]]):
        spark.createDataFrame(part, "s int, pos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            schema = spark.read.parquet(str(tmp_path / "in")).schema
        stream = packets.reorder(packets.packet_source(spark, str(tmp_path / "in"), schema), "s", "pos", most)
        got = packets.drain(stream, str(tmp_path / "out"), str(tmp_path / "log")).collect()
    assert sorted((r.s, r.pos) for r in got) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 5)]
    assert [r.pos for r in got if r.late] == ([2] if most == 0 else [])
