"""Near-duplicate detection by MinHash with tensored banding.

Two collections of ``SIDE`` small sketches (``DEPTH`` minhashes each) are computed for a text; the
table keys are all pairs of one sketch from either, so ``SIDE ** 2`` tables of ``2 * DEPTH``
minhashes cost only ``2 * SIDE * DEPTH`` minhashes. Two sets of similarity s share no table with a
probability of at most ``2 * (1 - s ** DEPTH) ** SIDE``: 0.06 % at s = 0.8, 0.007 % at 0.85.

Steps. (1) Equal shingle sets form a class and only one row of it goes on, so copies make no pairs.
(2) Each class gets a row for each table; buckets with two classes or more are kept, and the sets of
their classes are settled once. (3) In a bucket all members are compared with its least one, and in
buckets of up to three with the greatest too: a number of candidates linear in the bucket. (4)
Candidates whose sizes or minhashes rule out the similarity are dropped (a pair at the threshold is
ruled out by minhashes with a probability of about 1e-6); the others are verified on their full sets.
(5) The classes of buckets of four and more that still hold several components are decided exactly,
component by component (:mod:`lumenflow.llm.residuals`); so no link is lost to the shortcut of step
3. (6) Components are labelled without collecting anything.

Defined cases: a text without words (null, empty, blank) has an empty set and is its own component.
A component is named by its least ``doc_id``; null ids name one only where no other id is there.
Rows are told apart by id and text, so an id that repeats with another text is another document.
An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import common, residuals
from lumenflow.llm.components import connected_components
from lumenflow.llm.shingles import mix, shingle_set

SIDE, DEPTH = 8, 2
HASHES = 2 * SIDE * DEPTH
#: Of the minhashes of a pair at 0.8, fewer than this many agree with a probability of about 1e-6.
AGREE = 14

_U = np.uint64
_random = np.random.default_rng(6)
_FACTOR = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_TABLE = mix(np.arange(1, 2 * SIDE + 1, dtype=np.uint64))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit hashes."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, _U)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        for j in range(HASHES):
            v = (part * _FACTOR[j] + _ADD[j]).min()
            if v < least[j]:
                least[j] = v
    return least


def sides(least: np.ndarray) -> np.ndarray:
    """The small sketches: SIDE of the first collection, then SIDE of the second."""
    key = _TABLE.copy()
    for d in range(DEPTH):
        key = mix(key ^ least[d::DEPTH] * _U(0x9E3779B97F4A7C15))
    return key


_SKETCH = "doc_id long, mark binary, n_shingles long, fingerprint binary, sketch binary, sides array<long>"


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints, sketches, keys = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, words)
                least = minhashes(s)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketches.append((least >> _U(32)).astype("<u4").tobytes() if len(s) else b"")
                keys.append(sides(least).astype(np.int64))
            offsets = pa.array(np.arange(0, 2 * SIDE * len(n) + 1, 2 * SIDE), pa.int32())
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "mark", "n_shingles", "fingerprint", "sketch", "sides"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingle_set(t, words).astype(np.int64) for t in b.column("text").to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, got)]), pa.int32())
            flat = pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, flat)], names=["id", "items"])

    return run


def _sizes_allow(n: str, m: str, percent: int):
    return (F.lit(100) * F.least(n, m)) >= F.lit(percent) * F.greatest(n, m)


def _agreeing(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs (a, b, their sketches) enough of whose minhashes agree."""
    for batch in pairs:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, HASHES) for c in ("sketch_a", "sketch_b"))
            ok = pa.array((one == two).sum(1) >= AGREE)
            yield batch.select(["a", "b"]).filter(ok)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(F.lit(100) * shared >= F.lit(percent) * (F.size("items_a") + F.size("items_b") - shared)).select("a", "b")


def _marked(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, text (null as empty), mark, which tells texts apart, and ``more``."""
    text = F.coalesce(F.col(common.quoted(text_col)).cast("string"), F.lit(""))
    return docs.select(F.col(common.quoted(id_col)).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("mark"), *more)


def _sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, items) of the classes in ``ids`` (settled), from one row of each class."""
    chosen = common.settle(classes.join(ids, "id").select("id", F.col("doc_id").alias("at"), F.col("mark").alias("by")), "near-chosen")
    found = docs.join(common.marks(chosen), F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("mark") == F.col("by"))).select("id", "text")
    sets = common.settle(found.mapInArrow(_sets(words), "id long, items array<long>"), "near-sets")
    return sets if sets.count() == chosen.count() else common.settle(sets.dropDuplicates(["id"]), "near-sets-once")


def _labelled(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """From :func:`_marked` rows: their sketches, and (fingerprint, n_shingles, size, component_id, stays) of each class; ``stays`` is the component's first row."""
    rows = common.settle(docs.mapInArrow(_sketch(words), _SKETCH), "near-sketches")
    named = rows.filter("n_shingles > 0")
    first_row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    grouped = named.groupBy("fingerprint", "n_shingles").agg(F.min(F.struct(first_row.alias("row"), "sketch", "sides")).alias("x"), F.count("*").alias("size"))
    classes = grouped.select(F.monotonically_increasing_id().alias("id"), "fingerprint", "n_shingles", "size", "x.row", "x.row.doc_id", "x.row.mark", "x.sketch", "x.sides")
    classes = common.settle(classes, "near-classes")
    nodes = classes.select("id", F.col("n_shingles").alias("n"), "sketch", "sides")

    one, two = F.slice("sides", 1, SIDE), F.slice("sides", SIDE + 1, SIDE)
    keys = F.flatten(F.transform(one, lambda a: F.transform(two, lambda b: F.xxhash64(a, b))))
    dealt = nodes.select(F.explode(keys).alias("key"), "id")
    buckets = dealt.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("members")).filter("lo <> hi")
    members = common.settle(dealt.join(common.settle(buckets, "near-buckets"), "key"), "near-members")

    light = nodes.select("id", "n", "sketch")

    def allowed(pairs: DataFrame) -> DataFrame:
        side = lambda c: light.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(_sizes_allow("n_a", "n_b", percent)).select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agreeing, "a long, b long")

    centres = F.when(F.col("members") > 3, F.array("lo")).otherwise(F.array("lo", "hi"))
    stars = members.select(F.explode(centres).alias("p"), "id").filter("p <> id").select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
    stars = common.settle(allowed(stars), "near-stars")
    # Buckets of up to three are complete; larger ones may hold a link across components.
    large = members.filter("members > 3").select("key", "id")
    wanted = common.settle(stars.select(F.explode(F.array("a", "b")).alias("id")).unionAll(large.select("id")).distinct(), "near-wanted")
    sets = _sets_of(wanted, classes, docs, words)
    links = common.settle(_verified(stars, sets, percent), "near-links")
    labels = common.settle(connected_components(links), "near-labels")

    told = common.settle(large.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "near-told")
    open_ = common.settle(told.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key", "x"), "near-open")
    met = told.join(open_, "key").select("id", "component", "x").distinct()
    met = common.settle(met, "near-met")
    if not met.isEmpty():
        regions = common.settle(connected_components(met.select(F.col("x").alias("a"), F.col("component").alias("b")).distinct()), "near-regions")
        placed = met.select("id", "component").distinct().join(regions.select(F.col("id").alias("component"), F.col("component").alias("g")), "component").join(light.select("id", "n"), "id")
        across = residuals.component_links(common.settle(placed, "near-placed"), sets, percent)
        merged = common.settle(connected_components(across), "near-merged").select(F.col("id").alias("component"), F.col("component").alias("whole"))
        alone = merged.select(F.col("component").alias("id"), "whole").join(labels.select("id"), "id", "left_anti")
        labels = labels.join(merged, "component", "left").select("id", F.coalesce("whole", "component").alias("component")).unionByName(alone.select("id", F.col("whole").alias("component")))
        labels = common.settle(labels, "near-all-labels")

    of = classes.select("id", "fingerprint", "n_shingles", "size", "row").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = common.settle(of, "near-components")
    firsts = common.settle(of.groupBy("component").agg(F.min("row").alias("stays"), F.count("*").alias("classes")), "near-firsts")
    told = common.lookup_by_group(of, firsts, ["component"], "classes")
    return rows, common.settle(told.select("fingerprint", "n_shingles", "size", F.col("stays.doc_id").alias("component_id"), "stays"), "near-groups")


def _decided(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row for each of the :func:`_marked` rows: doc_id, mark, n_shingles, component_id, and ``stays`` (doc_id and mark of the row that stays for it)."""
    rows, groups = _labelled(docs, words, percent)
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    found = common.lookup_by_group(rows.filter("n_shingles > 0").select("doc_id", "mark", "n_shingles", "fingerprint"), groups, ["fingerprint", "n_shingles"], "size")
    alone = rows.filter("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), own.alias("stays"))
    return found.select(*alone.columns).unionByName(alone)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id is component_id)."""
    common.ship(docs.sparkSession)
    told = _decided(_marked(docs, id_col, text_col), words, percent)
    return told.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they had: one row of each component.

    It is the one with the least id, rows without an id last; of rows with that id the one whose text
    has the least hash; of rows equal in id and text any one. Texts without words all stay.
    """
    common.ship(docs.sparkSession)
    told = common.settle(_decided(_marked(docs, id_col, text_col), words, percent).select("doc_id", "mark", "n_shingles", (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("mark") == F.col("stays.mark"))).alias("kept")), "near-decided")
    gone = common.settle(told.filter("NOT kept").select(F.col("doc_id").alias("at"), F.col("mark").alias("by")).distinct(), "near-gone")
    rows = _marked(docs, id_col, text_col, F.struct(*(F.col(common.quoted(c)) for c in docs.columns)).alias("held")).drop("text")
    same = F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("mark") == F.col("by"))
    left = rows.join(common.marks(gone), same, "left_anti")
    twice = common.settle(told.filter("kept AND n_shingles > 0").groupBy(F.col("doc_id").alias("at"), F.col("mark").alias("by")).agg(F.count("*").alias("n")).filter("n > 1").select("at", "by"), "near-twice")
    if not twice.isEmpty():
        again = common.marks(twice)
        one = left.join(again, same, "left_semi").groupBy("doc_id", "mark").agg(F.first("held").alias("held")).select("held")
        left = left.join(again, same, "left_anti").select("held").unionByName(one)
    return left.select("held.*")
