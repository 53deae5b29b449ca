"""File tags from bytes written by hand."""

from pyspark.sql import functions as F

from lumenflow.functions import tags

NONE = dict.fromkeys(tags.FIELDS)


def id3(version, flags, body, extra=b""):
    return b"ID3" + bytes([version, 0, flags, 0, 0, len(body) >> 7, len(body) & 127]) + body + extra


def frame(name, text, size=None):
    body = b"\x03" + text.encode()
    return name + (len(body) if size is None else size).to_bytes(4) + b"\0\0" + body


def test_id3v2():
    read = lambda data: tags.stated(tags.id3v2_frames(data))
    title = frame(b"TIT2", "Name")
    assert read(id3(3, 0, title))["title"] == "Name"
    assert read(id3(3, 0x80, title)) == NONE
    assert read(id3(3, 0x40, b"\0\0\0\2xx" + title))["title"] == "Name"
    assert read(id3(4, 0x40, b"\0\0\0\6xx" + title))["title"] == "Name"
    assert read(id3(4, 0, title + frame(b"TALB", "cut", 99)))["album"] is None
    assert read(id3(3, 0, title + bytes(4) + frame(b"TALB", "behind padding"))) == {**NONE, "title": "Name"}
    assert read(id3(3, 0, frame(b"TRCK", "x"), b"\xff")) == NONE
    assert read(b"ID3\3\0\0\x80\0\0\0" + title) == NONE
    assert read(b"") == read(b"ID3") == NONE


def test_track_numbers():
    read = lambda *values: tags.stated(("TRCK", v) for v in values)["track"]
    assert [read("3/12"), read("+7 of 9"), read("4294967296"), read("-1"), read("1", "x"), read("1", "")] == [3, 7, None, None, None, 1]


def test_vorbis():
    block = lambda *entries: b"\0\0\0\0" + len(entries).to_bytes(4, "little") + b"".join(len(e).to_bytes(4, "little") + e for e in entries)
    read = lambda data: tags.stated(tags.vorbis_comments(data))
    assert read(block(b"title=a=b", b"none", "album=ä".encode())) == {**NONE, "title": "a=b", "album": "ä"}
    assert read(block(b"title=a", b"date=b")[:-1]) == {**NONE, "title": "a"}
    assert read(b"") == read(b"\xff\xff\xff\xff") == NONE


def test_rows(spark):
    v1 = b"TAG" + b" old \0x".ljust(30, b"\0") + bytes(60) + b"1987" + bytes(28) + b"\0\5\0"
    rows = [(1, id3(3, 0, frame(b"TIT2", "new")) + v1), (2, v1), (3, v1[1:]), (4, b""), (5, None)]
    got = spark.createDataFrame(rows, "i int, data binary").select("i", tags.file_tags(F.col("data")).alias("t")).collect()
    assert {r.i: (r.t.title, r.t.date, r.t.track) for r in got} == {1: ("new", "1987", 5), 2: ("old", "1987", 5), **dict.fromkeys((3, 4, 5), (None, None, None))}
