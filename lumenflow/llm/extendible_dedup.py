"""Exact deduplication by an extendible-hash index on shared files.

Map tasks hash every text to a 64-bit key, merge equal texts that they meet themselves, and write
two files sets to the shared folder: *entries* (one small row for each document) and *pages* (one
row for each distinct text of a task, with the text). A directory over key prefixes is then grown
on the driver from a histogram of at most ``2 ** MAX_DEPTH`` prefixes: a bucket that holds more
bytes than ``bucket_bytes`` splits, and the directory doubles when the bucket's depth reaches its
own. Each bucket is a range of keys with one owner task. The owner reads its pages in key order,
chains the texts that share a key, compares their bytes, and writes one row for each distinct text.

Hot groups: a group of copies reaches its owner as one page row for each map task, however many
copies there are. Results go back to documents by :func:`common.lookup_by_group`.

Defined cases: a null text counts as empty; empty texts equal one another. A null ``doc_id``
ranks below every other. Rows that repeat both id and text are ties: the first met stays. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import common

MAX_DEPTH = 18
#: Bytes of text that one bucket may hold before it splits, or a 2 ** -16 part of all where that is more.
BUCKET_BYTES = 4 << 20
#: Bytes of distinct texts that a map task keeps for merging before it writes them out.
MERGE_BYTES = 16 << 20

_ROW = "key long, sha binary, doc_id long, rid long, n long, size long, text string"
_ROW_ARROW = pa.schema([("key", pa.int64()), ("sha", pa.binary()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("text", pa.string())])
_LEAST = -(1 << 63)


def _rank(doc_id: int | None, rid: int) -> tuple[int, int]:
    """Order of copies: the largest wins; the earlier of tied rows wins."""
    return (_LEAST if doc_id is None else doc_id, -rid)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (text is null, n is 0) for each row, and pages (with text) for each distinct text of the task."""
    rid = TaskContext.get().partitionId() << 40
    pages: dict[bytes, list] = {}
    held = 0

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW_ARROW, strict=True)], schema=_ROW_ARROW)

    for batch in batches:
        entries = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            key = xxhash.xxh64_intdigest(data) - (1 << 63)
            sha = hashlib.sha256(data).digest()
            entries.append((key, sha, doc_id, rid, 0, 0, None))
            page = pages.get(data)
            if page is None:
                pages[data] = [key, sha, doc_id, rid, 1]
                held += len(data) + 200
            else:
                page[4] += 1
                if _rank(doc_id, rid) > _rank(page[2], page[3]):
                    page[2:4] = doc_id, rid
            rid += 1
        if entries:
            yield out(entries)
        if held > MERGE_BYTES:
            yield from _flush(pages, out)
            held = 0
    yield from _flush(pages, out)


def _flush(pages: dict[bytes, list], out) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for data, (key, sha, doc_id, rid, n) in pages.items():
        rows.append((key, sha, doc_id, rid, n, len(data), data.decode()))
        size += len(data)
        if size > 4 << 20:
            yield out(rows)
            rows, size = [], 0
    if rows:
        yield out(rows)
    pages.clear()


class Directory:
    """An extendible-hash directory: slot ``prefix >> (MAX_DEPTH - depth)`` names a bucket."""

    def __init__(self, weights: dict[int, int], capacity: int) -> None:
        """``weights``: bytes for each prefix of MAX_DEPTH bits."""
        self.depth = 0
        self.slots = [0]
        self._local = [0]
        self._prefix = [0]
        self._weight = [sum(weights.values())]
        self._held = [sorted(weights.items())]
        queue = [0]
        while queue:
            b = queue.pop()
            if self._weight[b] > capacity and self._local[b] < MAX_DEPTH:
                queue += [b, self._split(b)]

    def _split(self, b: int) -> int:
        """Move the upper half of bucket ``b`` to a new bucket; double the directory where it is as deep as the bucket."""
        if self._local[b] == self.depth:
            self.slots = [s for s in self.slots for _ in range(2)]
            self.depth += 1
        new = len(self._local)
        self._local[b] += 1
        bit = MAX_DEPTH - self._local[b]
        upper = [x for x in self._held[b] if x[0] >> bit & 1]
        self._held[b] = [x for x in self._held[b] if not x[0] >> bit & 1]
        self._held.append(upper)
        self._local.append(self._local[b])
        self._weight[b] = sum(w for _, w in self._held[b])
        self._weight.append(sum(w for _, w in upper))
        self._prefix[b] *= 2
        self._prefix.append(self._prefix[b] + 1)
        run = 1 << self.depth - self._local[b]  # a bucket's slots lie side by side
        self.slots[self._prefix[new] * run : (self._prefix[new] + 1) * run] = [new] * run
        return new

    @property
    def buckets(self) -> int:
        return len(self._local)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in key order: chain the distinct texts of a key, compare bytes, give one row for each text."""
    schema = pa.schema([("key", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64())])
    now, chain, done = None, [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "sha", "doc_id", "rid", "n", "text")]
        for key, sha, doc_id, rid, n, text in zip(*columns, strict=True):
            if key != now:
                done += [(now, *link[1:]) for link in chain]
                now, chain = key, []
            for link in chain:
                if link[0] == text:
                    link[4] += n
                    if _rank(doc_id, rid) > _rank(link[2], link[3]):
                        link[2:4] = doc_id, rid
                    break
            else:
                chain.append([text, sha, doc_id, rid, n])
        if len(done) > 8192:
            yield out()
            done = []
    done += [(now, *link[1:]) for link in chain]
    if done:
        yield out()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    common.ship(spark)
    index = common.settle(docs.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"), F.col(common.quoted(text_col)).cast("string").alias("text")).mapInArrow(_index_rows, _ROW), "dedup-index")
    entries, pages = index.filter("n = 0").select("key", "sha", "doc_id", "rid"), index.filter("n > 0")
    prefix = F.shiftrightunsigned(F.col("key"), 64 - MAX_DEPTH)
    weights = {r["p"]: r["w"] for r in pages.groupBy(prefix.cast("int").alias("p")).agg(F.sum("size").alias("w")).collect()}  # 2 ** MAX_DEPTH rows at most
    directory = Directory(weights, max(bucket_bytes, sum(weights.values()) >> 16))
    slot = F.shiftrightunsigned(F.col("key"), 64 - directory.depth) if directory.depth else F.lit(0)
    slots = F.split(F.lit(",".join(map(str, directory.slots))), ",").cast("array<int>")  # folded to one constant
    owned = pages.repartitionById(directory.buckets, F.get(slots, slot.cast("int"))).sortWithinPartitions("key")
    groups = common.settle(owned.select("key", "sha", "doc_id", "rid", "n", "text").mapInArrow(_own, "key long, sha binary, keep_id long, keep_rid long, group_size long"), "dedup-groups")
    return common.lookup_by_group(entries, groups, ["key", "sha"], "group_size").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they had, whatever their names; one row of each group of equal texts.

    It is the one with the largest id, rows without an id last; of rows equal in id and text any one.
    """
    ids = F.coalesce(F.col(common.quoted(id_col)).cast("long"), F.lit(_LEAST))
    sha = F.sha2(F.coalesce(F.col(common.quoted(text_col)).cast("string"), F.lit("")), 256)
    rows = exact_groups(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.col("text_sha256").alias("sha"), "kept")
    gone = rows.groupBy("id", "sha").agg(F.max("kept").alias("kept")).filter("NOT kept").select("id", "sha")
    # One exchange of the texts: rows that tie in id and text meet in it too.
    held = docs.select(ids.alias("id"), sha.alias("sha"), F.struct(*(F.col(common.quoted(c)) for c in docs.columns)).alias("held"))
    return held.join(gone, ["id", "sha"], "left_anti").dropDuplicates(["id", "sha"]).select("held.*")
