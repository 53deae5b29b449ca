"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: one task writes one archive of gzip members, one member for each record, to a name of its
own attempt; only names of attempts that Spark has committed reach the manifest, so a lost executor
or a second attempt leaves no half file in the result. Of records with equal payloads of at least
``revisit_bytes`` bytes the one with the largest id is a ``response``, the others are ``revisit``
records that name it and carry no body.

Reading: files are cut into byte ranges, a task each. A task looks for the gzip magic in its range,
accepts a candidate only where it decodes to a WARC header, and owns the records that start inside
its range; it follows the last one past the range's end. Between records it goes from member to
member, so compressed bytes that look like a magic are met only before the first member.

Files are opened by path where they are on a shared mount and through ``pyarrow.fs`` elsewhere.

Defined cases: a null payload counts as empty; empty and short payloads are always ``response``. A
null id is written as no id and ranks below every other; where all ids of a group are null, all are
``response``. Rows that repeat an id and a payload are written each, as the same kind of record. An
empty table gives no archive and an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import common

REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 18
_NO_ID = -(1 << 63)


def _local(path: str) -> str | None:
    u = urlparse(path)
    return unquote(u.path) if u.scheme in ("", "file") else None


def open_output(path: str):
    here = _local(path)
    if here is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_output_stream(inner)
    os.makedirs(os.path.dirname(here), exist_ok=True)
    return open(here, "wb")


def open_input(path: str):
    here = _local(path)
    if here is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(here, "rb")


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _urn(number: int | None, seed: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number}/{seed}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = hashlib.sha1(payload).digest()
    uri = "".join((url or "about:blank").split())
    headers = [("WARC-Record-ID", _urn(page_id, digest.hex())), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        return record("response", [*headers, ("Content-Type", "application/http; msgtype=response")], http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to, digest.hex())), ("X-Refers-To-Page-ID", str(refers_to)), ("Content-Type", "application/http; msgtype=response")]
    return record("revisit", headers, http + b"\r\n")


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        f, size, n = None, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if f is None:
                    f = open_output(path)
                    size += f.write(_member(record("warcinfo", [("WARC-Record-ID", _urn(None, path)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level))
                data = _member(_page_record(page_id, url, (html or "").encode(), refers_to), level)
                f.write(data)
                size += len(data)
                n += 1
        if f is not None:
            f.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, level: int = 6) -> DataFrame:
    """Write one record for each row below ``folder``. Gives the manifest: path, bytes, records."""
    common.ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    known = common.settle(rows.filter(F.octet_length("html") >= revisit_bytes).select(F.coalesce("page_id", F.lit(_NO_ID)).alias("page_id"), "digest"), "warc-digests")
    groups = common.settle(known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("refers_to") > _NO_ID)), "warc-groups")
    revisits = common.lookup_by_group(known, groups, ["digest"], "n").filter("refers_to <> page_id").select(F.col("page_id").alias("own"), "digest", "refers_to").distinct()
    told = rows.withColumn("own", F.coalesce("page_id", F.lit(_NO_ID))).join(revisits, ["own", "digest"], "left")
    return common.settle(told.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder, level), "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """Bytes of a file from a moving start, read in chunks."""

    def __init__(self, f, at: int) -> None:
        self.f, self.at, self.data, self.end = f, at, b"", False
        f.seek(at)

    def need(self, n: int) -> bool:
        """Hold ``n`` bytes from ``at``, as far as the file goes."""
        while len(self.data) < n and not self.end:
            more = self.f.read(max(_CHUNK, n - len(self.data)))
            self.end = not more
            self.data += more
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        self.at += n
        self.data = self.data[n:]


def _inflate(w: _Window, limit: int | None = None) -> tuple[bytes, int] | None:
    """The member at the window's start and its packed size; with ``limit``, at least so much of it if it has as much. None if it is none."""
    z, out, used = zlib.decompressobj(31), [], 0
    size = 0
    while not z.eof:
        if not w.need(used + 1):
            return None
        part = w.data[used : used + _CHUNK]
        try:
            got = z.decompress(part)
        except zlib.error:
            return None
        used += len(part) - len(z.unused_data)
        out.append(got)
        size += len(got)
        if limit is not None and size >= limit:
            break
    return b"".join(out), used


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a WARC record."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    headers = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    if "warc-type" not in headers or not headers.get("content-length", "").isdigit():
        return None
    n = int(headers["content-length"])
    block = data[end + 4 : end + 4 + n]
    return (headers, block) if len(block) == n else None


def records_in_range(f, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose members start in ``[start, stop)``."""
    w = _Window(f, start)
    while w.at < stop:
        if not w.need(len(MAGIC)):
            return
        at = w.data.find(MAGIC)
        if at < 0:
            w.skip(len(w.data) - len(MAGIC) + 1)  # a magic may lie across this chunk's end
            continue
        if w.at + at >= stop:
            return
        w.skip(at)
        head = _inflate(w, 16)
        if head is None or not head[0].startswith(b"WARC/1."):
            w.skip(1)
            continue
        whole = _inflate(w)
        got = whole and parse_record(whole[0])
        if not got:
            w.skip(1)
            continue
        w.skip(whole[1])
        yield got


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read_ranges(keep_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * keep_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * keep_payload

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
                rows: list[tuple] = []
                held = 0
                with open_input(path) as f:
                    for h, block in records_in_range(f, start, stop):
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        page = int(h["x-page-id"]) if "x-page-id" in h else None
                        payload = None
                        if h["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            row = (page, h.get("warc-target-uri"), len(payload), hashlib.sha1(payload).hexdigest(), "response", None)
                        else:
                            digest = h.get("warc-payload-digest", "").rpartition(":")[2]
                            row = (page, h.get("warc-target-uri"), int(h.get("x-payload-length", 0)), base64.b32decode(digest).hex(), "revisit", int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None)
                        rows.append(row + (payload,) * keep_payload)
                        held += len(payload or b"") if keep_payload else 100
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return run


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """The response and revisit records of the archives in ``manifest`` (path, bytes), by ranges of ``range_bytes``."""
    spark: SparkSession = manifest.sparkSession
    common.ship(spark)
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = manifest.filter("bytes > 0").select("path", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + range_bytes)
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes)).alias("n")).first()["n"] or 1
    return ranges.repartition(int(n), "path", "start").mapInArrow(_read_ranges(payloads), _READ + ", payload binary" * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = common.fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
