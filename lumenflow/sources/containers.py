"""Container files as rows: one row for each chunk, page, box or frame, and WAV files from samples.

Input is a table with a path and a binary column (as ``spark.read.format("binaryFile")`` gives). Each
file is walked where it lies, in Arrow batches of few files, and only positions leave the walk, so
nothing is shuffled. Damage never ends a walk with an error: it goes on at the next mark it knows,
and what it passed over is told by the offsets. A null or empty file has no rows.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from lumenflow.functions.checksums import ogg_crc_of

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Boxes that hold boxes (fixed values).
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"moof", b"traf", b"dinf", b"udta"}
#: Rows of a walk that are held at once, of however many files.
ROWS = 4096
#: Files of an Arrow batch, and files that a writer makes at once.
FILES = 200
#: Sampling-rate indexes of AAC that are in use.
AAC_RATES = 13


def riff_chunks(data: bytes) -> Iterator[tuple]:
    """(id, offset of the body, size) of the chunks after the form type; a size beyond the file is cut to it."""
    if data[:4] not in (b"RIFF", b"RF64") or len(data) < 12:
        return
    at = 12
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        size = min(size, len(data) - at - 8)
        yield data[at : at + 4].decode("latin-1"), at + 8, size
        at += 8 + size + (size & 1)


def ogg_pages(data: bytes) -> Iterator[tuple]:
    """(serial, sequence, granule, flags, offset, size, packets ended on it, whether its checksum is right)."""
    at = data.find(b"OggS")
    while at >= 0:
        end = -1
        if at + 27 <= len(data) and at + 27 + data[at + 26] <= len(data):
            laces = data[at + 27 : at + 27 + data[at + 26]]
            end = at + 27 + len(laces) + sum(laces)
        if 0 <= end <= len(data):
            granule, serial, sequence, crc = struct.unpack_from("<qIII", data, at + 6)
            ok = ogg_crc_of(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc
            if ok:
                yield serial, sequence, granule, data[at + 5], at, end - at, sum(x < 255 for x in laces), True
                at = data.find(b"OggS", end)
                continue
            yield serial, sequence, granule, data[at + 5], at, end - at, 0, False
        at = data.find(b"OggS", at + 4)


def mp4_boxes(data: bytes) -> Iterator[tuple]:
    """(path of types, offset, size, offset of the body), parents before their children."""
    todo = [(0, len(data), "")]
    while todo:
        at, end, path = todo.pop()
        if at + 8 > end:
            continue
        (size, kind), head = struct.unpack_from(">I4s", data, at), 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            continue
        stop, name = min(at + size, end), f"{path}/{kind.decode('latin-1')}"
        yield name, at, stop - at, at + head
        if stop + 8 <= end:
            todo.append((stop, end, path))
        if kind in PARENTS:
            todo.append((at + head, stop, name))


def adts_frames(data: bytes) -> Iterator[tuple]:
    """(offset, size) of AAC frames; a frame counts if the next one, or the end, follows it."""

    def size_at(i: int) -> int:
        if i + 7 > len(data) or data[i] != 0xFF or data[i + 1] & 0xF6 != 0xF0 or data[i + 2] >> 2 & 15 >= AAC_RATES:
            return 0
        size = (data[i + 3] & 3) << 11 | data[i + 4] << 3 | data[i + 5] >> 5
        return size if size >= 7 and i + size <= len(data) else 0

    at = 0
    while 0 <= at < len(data):
        size = size_at(at)
        if size and (at + size == len(data) or size_at(at + size)):
            yield at, size
            at += size
        else:
            at = data.find(b"\xff", at + 1)


def flac_blocks(data: bytes) -> Iterator[tuple]:
    """(type, offset of the body, size, last) of the metadata blocks."""
    at = 4 if data[:4] == b"fLaC" else len(data)
    while at + 4 <= len(data):
        size, last = int.from_bytes(data[at + 1 : at + 4], "big"), data[at] >= 128
        if at + 4 + size > len(data):
            return
        yield data[at] & 127, at + 4, size, last
        if last:
            return
        at += 4 + size


def _table(data: bytes, at: int, end: int, shape: str, head: int = 4) -> list[tuple]:
    """Rows of a counted table of a full box, as many as the box holds."""
    if at + head + 4 > end:
        return []
    (n,) = struct.unpack_from(">I", data, at + head)
    at, step = at + head + 4, struct.calcsize(shape)
    return list(struct.iter_unpack(shape, data[at : at + min(n, (end - at) // step) * step]))


def mp4_samples(data: bytes) -> Iterator[tuple]:
    """(track, n, offset, size, dts, duration, cts, sync, media) of the samples that the sample tables list, track by track; media is where the file's first media data begins, None without any."""
    tables: dict[str, list] = {}
    seen, track = False, 0
    boxes = list(mp4_boxes(data))
    media = next((body for path, _, _, body in boxes if path == "/mdat"), None)

    def rows() -> Iterator[tuple]:
        sizes = [s for (s,) in tables.get("stsz", [])]
        starts = [o for (o,) in tables.get("stco", [])]
        runs = tables.get("stsc", [])
        deltas = [d for n, d in tables.get("stts", []) for _ in range(min(n, len(sizes)))]
        shifts = [d for n, d in tables.get("ctts", []) for _ in range(min(n, len(sizes)))]
        syncs = {n for (n,) in tables["stss"]} if "stss" in tables else None
        sample = dts = run = 0
        for chunk, at in enumerate(starts, 1):
            while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
                run += 1
            for _ in range(runs[run][1] if runs else 0):
                if sample == len(sizes):
                    return
                step = deltas[sample] if sample < len(deltas) else 0
                yield track, sample, at, sizes[sample], dts, step, dts + (shifts[sample] if sample < len(shifts) else 0), not syncs or sample + 1 in syncs, media
                at, dts, sample = at + sizes[sample], dts + step, sample + 1

    for path, at, size, body in boxes:
        kind, end = path[path.rfind("/") + 1 :], at + size
        if kind == "trak":
            if seen:
                yield from rows()
            tables, seen, track = {}, True, 0
        elif kind == "tkhd" and body + 24 <= end:
            (track,) = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))
        elif kind == "stsz" and body + 12 <= end:
            size_of_all, n = struct.unpack_from(">II", data, body + 4)
            tables[kind] = [(size_of_all,)] * n if size_of_all and n <= len(data) else [] if size_of_all else _table(data, body, end, ">I", 8)
        elif kind in ("stco", "co64"):
            tables["stco"] = _table(data, body, end, ">Q" if kind == "co64" else ">I")
        elif kind in ("stts", "stsc", "stss", "ctts"):
            tables[kind] = _table(data, body, end, {"stts": ">II", "stsc": ">III", "stss": ">I", "ctts": ">Ii" if data[body : body + 1] == b"\1" else ">II"}[kind])
    if seen:
        yield from rows()


def ogg_packets(data: bytes) -> Iterator[tuple]:
    """(serial, n, size, crc32, granule of the page it ends on if it is the last there) of the packets of sound pages; one whose start or middle is lost is left out."""
    import zlib

    held: dict[int, list] = {}  # pages so far, packets so far, bytes waiting (which grow in place) or None where a start is lost
    for serial, sequence, granule, flags, at, _, _, ok in ogg_pages(data):
        if not ok:
            continue
        state = held.setdefault(serial, [None, 0, bytearray()])
        if state[0] is not None and sequence != state[0] + 1 & 0xFFFFFFFF:
            state[2] = None  # a page is missing
        if not flags & 1:
            state[2] = bytearray()
        elif not state[2]:
            state[2] = None
        state[0] = sequence
        laces = data[at + 27 : at + 27 + data[at + 26]]
        body = at + 27 + len(laces)
        last = max((i for i, x in enumerate(laces) if x < 255), default=-1)
        for i, x in enumerate(laces):
            if state[2] is not None:
                state[2] += data[body : body + x]
            body += x
            if x < 255:
                if state[2] is not None:
                    yield serial, state[1], len(state[2]), zlib.crc32(state[2]), granule if i == last else None
                    state[1] += 1
                state[2] = bytearray()


#: Elements of Matroska that hold elements (fixed values): segment, cluster, block group, tracks, cues, info.
EBML_PARENTS = {0x18538067, 0x1F43B675, 0xA0, 0x1654AE6B, 0xAE, 0x1C53BB6B, 0xBB, 0xB7, 0x1549A966}
#: Top-level elements, at which an element of unknown size ends.
EBML_TOP = {0x1F43B675, 0x1654AE6B, 0x1C53BB6B, 0x1549A966, 0x114D9B74, 0x1254C367}


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A number of one to eight bytes (with its length mark if ``keep``) and its length; (-1, 0) where there is none."""
    if at >= len(data) or not data[at]:
        return -1, 0
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        return -1, 0
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep else value & (1 << 7 * n) - 1), n


def ebml_elements(data: bytes) -> Iterator[tuple]:
    """(id, depth, offset, offset of the body, size) of elements, parents before their children."""
    ends: list[tuple[int, int]] = []  # of open parents: id, end
    at = 0
    while at < len(data):
        while ends and at >= ends[-1][1]:
            ends.pop()
        kind, n = _vint(data, at, True)
        size, m = _vint(data, at + n, False) if n else (-1, 0)
        if not m:
            at += 1  # damage: hunt for the next element
            continue
        body, end = at + n + m, ends[-1][1] if ends else len(data)
        while ends and kind in EBML_TOP and ends[-1][0] == 0x1F43B675 and ends[-1][1] == (ends[-2][1] if len(ends) > 1 else len(data)):
            ends.pop()  # a cluster of unknown size ends where the next one starts
        unknown = size == (1 << 7 * m) - 1
        size = end - body if unknown else min(size, end - body)
        yield kind, len(ends), at, body, max(size, 0)
        if kind in EBML_PARENTS:
            ends.append((kind, body + size))
            at = body
        else:
            at = body + max(size, 0)


def _laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of a block's frames: one, or laced as Xiph (1), equal sizes (2) or EBML (3)."""
    if not lacing or at >= end:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        sizes = [(end - at) // n] * (n - 1)
    elif lacing == 1:
        for _ in range(n - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + (data[at] if at < end else 0), at + 1
            sizes.append(size)
    else:
        for i in range(n - 1):
            value, m = _vint(data, at, False)
            if not m:
                return []
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * m - 1) - 1))
            at += m
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        return []
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def matroska_frames(data: bytes) -> Iterator[tuple]:
    """(track, time in ticks, lace, key, offset, size) of the frames of blocks; laced frames share a time."""
    cluster = 0
    for kind, _, _, body, size in ebml_elements(data):
        if kind == 0xE7:
            cluster = int.from_bytes(data[body : body + size], "big")
        elif kind in (0xA3, 0xA1):
            track, n = _vint(data, body, False)
            if n and size >= n + 3:
                (time,) = struct.unpack_from(">h", data, body + n)
                flags = data[body + n + 2]
                for lace, (at, length) in enumerate(_laced(data, body + n + 3, body + size, flags >> 1 & 3)):
                    yield track, cluster + time, lace, kind == 0xA3 and flags >= 128, at, length


#: What each walk gives, as a schema.
WALKS: dict[str, tuple[Callable, str]] = {
    "riff": (riff_chunks, "id string, at long, size long"),
    "ogg": (ogg_pages, "serial long, sequence long, granule long, flags int, at long, size long, packets long, crc_ok boolean"),
    "ogg_packets": (ogg_packets, "serial long, packet long, size long, crc32 long, granule long"),
    "mp4": (mp4_boxes, "box string, at long, size long, body long"),
    "mp4_samples": (mp4_samples, "track long, sample long, at long, size long, dts long, duration long, cts long, sync boolean, media long"),
    "matroska": (ebml_elements, "id long, depth int, at long, body long, size long"),
    "matroska_frames": (matroska_frames, "track long, time long, lace int, key boolean, at long, size long"),
    "adts": (adts_frames, "at long, size long"),
    "flac": (flac_blocks, "type int, at long, size long, last boolean"),
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _few_files(spark: SparkSession) -> None:
    """Keep Arrow batches of files small, as a batch is held whole, and more than once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FILES))


def scan(files: DataFrame, container: str, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, n (from 0) and the columns of ``WALKS[container]``.

    Rows of several files leave in one batch: a batch costs as much as a hundred rows.
    """
    walk, columns = WALKS[container]
    fields = [c.split() for c in columns.split(", ")]

    names, types = ["path", "n", *(name for name, _ in fields)], [pa.string(), pa.int64(), *(_ARROW[kind] for _, kind in fields)]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):  # one file's bytes at a time
                for n, row in enumerate(walk(content.as_py() or b"")):
                    held.append((path, n, *row))
                    if len(held) == ROWS:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    _few_files(files.sparkSession)
    two = files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).alias("content"))
    return two.mapInArrow(run, f"path string, n long, {columns}")


#: Sample formats of WAV files: bits and whether they are floats.
WAV_FORMATS = {"u8": (8, False), "s16": (16, False), "s24": (24, False), "s32": (32, False), "f32": (32, True)}


def pcm_bytes(values: np.ndarray, fmt: str) -> bytes:
    """Samples from -1 to 1 in a format, little-endian."""
    bits, is_float = WAV_FORMATS[fmt]
    if is_float:
        return values.astype("<f4").tobytes()
    whole = np.floor(np.clip(values, -1, 1) * ((1 << bits - 1) - 1) + 0.5).astype(np.int64)
    if bits == 8:
        return (whole + 128).astype(np.uint8).tobytes()
    if bits == 24:
        return whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return whole.astype(f"<i{bits // 8}").tobytes()


def pcm_floats(data: bytes, fmt: str) -> np.ndarray:
    """Samples of a format as numbers from -1 to 1; what is left of a sample at the end is dropped."""
    bits, is_float = WAV_FORMATS[fmt]
    data = data[: len(data) // (bits // 8) * (bits // 8)]
    if is_float:
        return np.frombuffer(data, "<f4").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:  # into the top of 32 bits
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        return wide.reshape(-1).view("<i4") / 2147483648.0
    return np.frombuffer(data, f"<i{bits // 8}") / float(1 << bits - 1)


def wav_samples(data: bytes) -> tuple[int, int, str, np.ndarray] | None:
    """Rate, channels, format and interleaved samples of a WAV file; None for formats that are not in WAV_FORMATS."""
    told = None
    for name, at, size in riff_chunks(data):
        if name == "fmt " and size >= 16:
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
            if tag == 0xFFFE and size >= 26:
                (tag,) = struct.unpack_from("<H", data, at + 24)
            told = next(((rate, channels, f) for f, (n, is_float) in WAV_FORMATS.items() if n == bits and tag == (3 if is_float else 1)), None)
        elif name == "data" and told:
            return *told, pcm_floats(data[at : at + size], told[2])
    return None


def read_wav(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, rate, channels, format and samples (array of doubles) of the WAV files among ``files``, read where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = wav_samples(content or b"")
                if found:
                    rate, channels, fmt, values = found
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([rate], pa.int64()), pa.array([channels], pa.int32()), pa.array([fmt], pa.string()), pa.array([values.tolist()], pa.list_(pa.float64()))], names=["path", "rate", "channels", "format", "samples"])

    _few_files(files.sparkSession)
    return files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).alias("content")).mapInArrow(run, "path string, rate long, channels int, format string, samples array<double>")


def wav_writer(rate: int, channels: int = 1, fmt: str = "s16"):
    """A function of a column of interleaved samples from -1 to 1 that gives a WAV file; null gives null."""
    bits, is_float = WAV_FORMATS[fmt]

    @arrow_udf(BinaryType())
    def write(samples: pa.Array) -> pa.Array:
        out = []
        for s in samples:
            if not s.is_valid:
                out.append(None)
                continue
            pcm = pcm_bytes(np.nan_to_num(np.asarray(s.as_py(), dtype=np.float64)), fmt)
            head = struct.pack("<HHIIHH", 3 if is_float else 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
            body = b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(pcm)) + pcm + bytes(len(pcm) & 1)
            out.append(b"RIFF" + struct.pack("<I", len(body)) + body)
        return pa.array(out, pa.binary())

    return write


@arrow_udf(ArrayType(IntegerType()))
def samples_16(data: pa.Array) -> pa.Array:
    """Little-endian samples of 16 bits; an odd byte at the end is dropped."""
    return pa.array([None if d is None else np.frombuffer(d[: len(d) // 2 * 2], "<i2").tolist() for d in data.to_pylist()], pa.list_(pa.int32()))


def ogg_page(serial: int, sequence: int, granule: int, flags: int, packets: list[bytes]) -> bytes:
    """One page of whole packets, its checksum set."""
    laces = b"".join(bytes([255] * (len(p) // 255) + [len(p) % 255]) for p in packets)
    if len(laces) > 255:
        raise ValueError("a page holds at most 255 lacing values")
    page = b"OggS\x00" + bytes([flags]) + struct.pack("<qIII", granule, serial, sequence, 0) + bytes([len(laces)]) + laces + b"".join(packets)
    return page[:22] + struct.pack("<I", ogg_crc_of(page)) + page[26:]


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _runs(values: list[int]) -> list[tuple[int, int]]:
    return [(len(list(g)), v) for v, g in groupby(values)]


def mp4_file(sizes: list[int], durations: list[int], shifts: list[int], syncs: list[bool], scale: int = 90_000, per_chunk: int = 4, payload: bytes | None = None) -> bytes:
    """A file of one track: run-length coded sample tables, composition offsets only where one is not 0 (signed if one is negative)."""
    n, full = len(sizes), lambda *x: struct.pack(">I", 0) + b"".join(x)
    head = _box(b"ftyp", b"isom", bytes(4), b"isom")
    payload = payload if payload is not None else bytes(sum(sizes))

    def table(kind: bytes, rows: list[tuple], shape: str, version: int = 0) -> bytes:
        return _box(kind, struct.pack(">II", version << 24, len(rows)), struct.pack(">" + shape * len(rows), *chain.from_iterable(rows)))

    spans = [min(per_chunk, n - i) for i in range(0, n, per_chunk)]
    firsts = [i for i, x in enumerate(spans) if not i or spans[i - 1] != x]
    tables = [table(b"stts", _runs(durations), "II")]
    if any(shifts):
        tables.append(table(b"ctts", _runs(shifts), "Ii" if min(shifts) < 0 else "II", int(min(shifts) < 0)))
    if not all(syncs):
        tables.append(table(b"stss", [(i + 1,) for i, x in enumerate(syncs) if x], "I"))
    tables += [table(b"stsc", [(i + 1, spans[i], 1) for i in firsts], "III"), _box(b"stsz", struct.pack(f">III{n}I", 0, 0, n, *sizes))]
    total = sum(durations)
    mdhd = _box(b"mdhd", full(struct.pack(">IIIIHH", 0, 0, scale, total, 0x55C4, 0)))
    tkhd = _box(b"tkhd", full(struct.pack(">IIIII", 0, 0, 1, 0, total), bytes(60)))
    mvhd = _box(b"mvhd", full(struct.pack(">IIII", 0, 0, scale, total), bytes(80)))

    def moov(start: int) -> bytes:
        before = list(accumulate(sizes, initial=start))
        chunks = [(before[i],) for i in range(0, n, per_chunk)]
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, _box(b"minf", _box(b"stbl", *tables, table(b"co64", chunks, "Q"))))))

    start = len(head) + len(moov(0)) + 8
    return head + moov(start) + _box(b"mdat", payload)


def _values(a: pa.Array) -> list:
    return a.to_pylist() if a.null_count else a.to_numpy(zero_copy_only=False).tolist()


def _columns(rows: pa.Array, fields: tuple[str, ...]) -> Iterator[list[list] | None]:
    """Of arrays of structs the lists of the fields, without a dictionary for each struct; null gives None."""
    columns = [_values(rows.values.field(f)) for f in fields]
    ends = rows.offsets.to_pylist()
    for i, there in enumerate(rows.is_valid().to_pylist()):
        yield [c[ends[i] : ends[i + 1]] for c in columns] if there else None


@arrow_udf(BinaryType())
def mp4_writer(samples: pa.Array) -> pa.Array:
    """From arrays of structs (size, duration, shift, sync) in order: a file of one track each; null gives null."""
    return pa.array([None if x is None else mp4_file(*x) for x in _columns(samples, ("size", "duration", "shift", "sync"))], pa.binary())


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (0x0100000000000000 | len(body)).to_bytes(8, "big") + body


def matroska_file(frames: list[tuple[int, int, bool, bytes]], cluster_ticks: int = 30_000) -> bytes:
    """A file of simple blocks (track, time, key, data) in order; a cluster starts with the first block and every ``cluster_ticks``."""
    clusters: list[tuple[int, list[bytes]]] = []
    for track, time, key, data in frames:
        if not clusters or abs(time - clusters[-1][0]) >= cluster_ticks:
            clusters.append((time, []))
        clusters[-1][1].append(_element(0xA3, bytes([0x80 | track]) + struct.pack(">hB", time - clusters[-1][0], 128 * key) + data))
    body = b"".join(_element(0x1F43B675, _element(0xE7, t.to_bytes(8, "big")) + b"".join(blocks)) for t, blocks in clusters)
    return _element(0x1A45DFA3, _element(0x4282, b"matroska")) + _element(0x18538067, body)


@arrow_udf(BinaryType())
def matroska_writer(frames: pa.Array) -> pa.Array:
    """From arrays of structs (track, time, key, data) in order: a file each; null gives null."""
    return pa.array([None if x is None else matroska_file(list(zip(*x, strict=True))) for x in _columns(frames, ("track", "time", "key", "data"))], pa.binary())


@arrow_udf(BinaryType())
def ogg_writer(packets: pa.Array) -> pa.Array:
    """From arrays of packets: a stream of one serial each, packets over as many pages of 255 lacing values as they need; null gives null."""
    return pa.array([ogg_file(p.as_py()) if p.is_valid else None for p in packets], pa.binary())


def ogg_file(packets: list[bytes], serial: int = 1, laces_a_page: int = 255) -> bytes:
    """Pages of a stream; the granule is the number of packets ended so far, -1 on pages that end none."""
    laces: list[tuple[int, bytes]] = []
    for p in packets:
        parts = [p[i : i + 255] for i in range(0, len(p) + 1, 255)]
        laces += [(len(x), x) for x in parts]
    out, ended = [], 0
    for number, at in enumerate(range(0, len(laces), laces_a_page)):
        own = laces[at : at + laces_a_page]
        here = sum(n < 255 for n, _ in own)
        ended += here
        flags = (2 if not number else 0) | (4 if at + laces_a_page >= len(laces) else 0) | (1 if at and laces[at - 1][0] == 255 else 0)
        page = b"OggS\x00" + bytes([flags]) + struct.pack("<qIII", ended if here else -1, serial, number, 0) + bytes([len(own), *(n for n, _ in own)]) + b"".join(x for _, x in own)
        out.append(page[:22] + struct.pack("<I", ogg_crc_of(page)) + page[26:])
    return b"".join(out)
