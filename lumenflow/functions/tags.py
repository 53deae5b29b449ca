"""Title, artist, album, date and track number that a file states: ID3v1, ID3v2 and Vorbis comments.

ID3v1 has fixed places and is a Column expression; the others are walked, a batch of files at a time.
A null is no tag. What is cut short is read up to there.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: What frames and comments of these names state.
STATES = {
    "title": ("TIT2", "TT2", "TITLE"),
    "artist": ("TPE1", "TP1", "ARTIST"),
    "album": ("TALB", "TAL", "ALBUM"),
    "date": ("TDRC", "TYER", "TYE", "DATE"),
    "track": ("TRCK", "TRK", "TRACKNUMBER"),
}
FIELDS = tuple(STATES)
SCHEMA = StructType([StructField(f, LongType() if f == "track" else StringType()) for f in FIELDS])
#: Comments of one block that are read.
COMMENTS = 1024
#: Encodings by the first byte of a text frame; others are UTF-8.
ENCODINGS = {0: "latin-1", 1: "utf-16-be", 2: "utf-16-be"}

_FIELD_OF = {name: field for field, names in STATES.items() for name in names}
_TYPE = pa.struct([(f, pa.int64() if f == "track" else pa.string()) for f in FIELDS])


def _number(value: str) -> int | None:
    head = re.split("[/ ]", value, maxsplit=1)[0].strip()
    return int(head) if re.fullmatch(r"\+?[0-9]{1,20}", head) and int(head) < 1 << 32 else None


def stated(pairs: Iterator[tuple[str, str]]) -> dict:
    """The fields that named texts state: the first text of a name that is not empty, the last track number."""
    out = dict.fromkeys(FIELDS)
    for name, value in pairs:
        field = _FIELD_OF.get(name)
        if not field or not value:
            continue
        if field == "track":
            out[field] = _number(value)
        elif out[field] is None:
            out[field] = value
    return out


def _syncsafe(data: bytes) -> int | None:
    """Four bytes of seven bits; null where one has an eighth or is missing."""
    if len(data) < 4 or any(x > 127 for x in data):
        return None
    return sum(x << 7 * (3 - i) for i, x in enumerate(data))


def _frame_text(body: bytes) -> str:
    kind, rest = body[:1], body[1:]
    if not kind:
        return ""
    code = ENCODINGS.get(kind[0], "utf-8")
    if kind[0] == 1 and rest[:2] in (b"\xff\xfe", b"\xfe\xff"):
        code, rest = "utf-16-le" if rest[0] == 0xFF else code, rest[2:]
    if code.startswith("utf-16"):
        rest = rest[: len(rest) // 2 * 2]
    return rest.decode(code, "replace").rstrip("\0").strip()


def id3v2_frames(data: bytes) -> Iterator[tuple[str, str]]:
    """Names and texts of the text frames of a file's ID3v2 tag; none of an unsynchronised one."""
    size = _syncsafe(data[6:10])
    if data[:3] != b"ID3" or size is None or data[5] & 0x80:
        return
    version, tag = data[3], memoryview(data)[: 10 + size + (10 if data[5] & 0x10 else 0)]
    at = 10
    if data[5] & 0x40 and version >= 3:
        extra = bytes(tag[at : at + 4])
        at += (int.from_bytes(extra) + 4 if len(extra) == 4 else 0) if version == 3 else _syncsafe(extra) or 0
    wide, flags = (3, 0) if version == 2 else (4, 2)
    while at + 2 * wide <= len(tag) and tag[at]:
        name, raw = bytes(tag[at : at + wide]), bytes(tag[at + wide : at + 2 * wide])
        start = at + 2 * wide + flags
        at = start + ((_syncsafe(raw) or 0) if version == 4 else int.from_bytes(raw))
        if at > len(tag):
            return
        if name[:1] == b"T":
            yield name.decode("latin-1"), _frame_text(bytes(tag[start:at]))


def vorbis_comments(data: bytes) -> Iterator[tuple[str, str]]:
    """Names, in capitals, and texts of a comment block without its signature."""

    def counted(at: int) -> tuple[int, int] | None:
        return (int.from_bytes(data[at : at + 4], "little"), at + 4) if at + 4 <= len(data) else None

    vendor = counted(0)
    number = vendor and counted(sum(vendor))
    if not number:
        return
    count, at = number
    for _ in range(min(count, COMMENTS)):
        entry = counted(at)
        if not entry or sum(entry) > len(data):
            return
        at = sum(entry)
        name, equals, value = data[entry[1] : at].decode("utf-8", "replace").partition("=")
        if equals:
            yield re.sub("[a-z]+", lambda m: m[0].upper(), name), value


@arrow_udf(SCHEMA)
def id3v2(data: pa.Array) -> pa.Array:
    return pa.array([stated(id3v2_frames(d or b"")) for d in data.to_pylist()], _TYPE)


@arrow_udf(SCHEMA)
def vorbis(data: pa.Array) -> pa.Array:
    return pa.array([stated(vorbis_comments(d or b"")) for d in data.to_pylist()], _TYPE)


def id3v1(data: Column) -> Column:
    """The fields of the 128 bytes at a file's end; nulls where these are no tag."""
    tail = F.when(F.length(data) >= 128, F.substring(data, -128, 128))
    tail = F.when(F.substring(tail, 1, 3) == F.lit(b"TAG"), tail)
    text = lambda at, n: F.nullif(F.regexp_replace(F.regexp_extract(F.decode(F.substring(tail, at + 1, n), "ISO-8859-1"), r"^[^\x00]*", 0), r"(?U)^\s+|\s+$", ""), F.lit(""))
    byte = lambda at: F.conv(F.hex(F.substring(tail, at + 1, 1)), 16, 10).cast("bigint")
    track = F.when((byte(125) == 0) & (byte(126) > 0), byte(126))
    return F.struct(text(3, 30).alias("title"), text(33, 30).alias("artist"), text(63, 30).alias("album"), text(93, 4).alias("date"), track.alias("track"))


def over(first: Column, second: Column) -> Column:
    """Field by field the first, else the second."""
    return F.struct(*(F.coalesce(first[f], second[f]).alias(f) for f in FIELDS))


def file_tags(data: Column) -> Column:
    """What a file states at its head, and where that says nothing, at its end."""
    return over(id3v2(data), id3v1(data))
