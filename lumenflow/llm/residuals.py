"""Which components of sets a link joins, decided from what the sets differ in.

The classes that share large buckets lie around a common original, so their sets agree in most items
and item joins over whole sets meet nearly every pair. Here each set is replaced by its difference d
from a reference B of its group: ``d = (set - B) | (B - set)``. For two sets of n and m items with
differences d and f, ``|set ^ other| = |d| + |f| - 2 |d & f|``, so their similarity is percent / 100
or more exactly where ::

    2 (100 + percent) |d & f| >= excess + excess'    excess = (100 + percent) |d| - (100 - percent) n

for any B. The reference only decides the speed: it holds the items that most of up to ``VOTERS``
sets of the group have.

Steps over component labels, which shrink in each: (1) every set is linked with the set of least
excess where both excesses sum to at most 0, for which nothing needs to be shared; what remains
needs common items in the differences. (2) ``ROUNDS`` of minhash tables over the differences: each
set is compared with the set of least excess of its bucket; where the groups hold few pairs there
is no round. (3) Sets still in different components
are joined exactly by prefixes of their differences. All steps decide by the formula, so what they
return are links and no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import common
from lumenflow.llm.components import connected_components
from lumenflow.llm.shingles import mix

#: Sets of a group whose majority makes the reference.
VOTERS = 31
#: Most rounds of minhash tables before the exact join, tables of a round, minhashes of a table's key.
ROUNDS, TABLES, DEPTH = 3, 16, 2
#: A further round follows one that joined at least this share of the components.
WORTH = 1 / 50
#: Pairs within groups that the exact join takes without a round before it.
FEW_PAIRS = 20_000

_U = np.uint64


def differences(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """From ``met`` (id, g, component, n) and ``sets`` (id, items): (id, g, component, excess, d)."""
    held = common.settle(met.join(sets, "id").select("id", "g", "component", "n", "items"), "near-held")
    voters = held.groupBy("g", F.pmod(F.xxhash64("id"), F.lit(VOTERS)).alias("part")).agg(F.min("id").alias("id"), F.count("*").alias("size"))
    voters = common.settle(voters, "near-voters")
    sizes = voters.groupBy("g").agg(F.sum("size").alias("size"), F.count("*").alias("voters"))
    votes = held.select("id", "items").join(voters.select("g", "id"), "id").select("g", F.explode("items").alias("item")).groupBy("g", "item").agg(F.count("*").alias("votes"))
    reference = votes.join(sizes.select("g", "voters"), "g").filter("2 * votes > voters").groupBy("g").agg(F.collect_list("item").alias("reference"))
    groups = common.settle(sizes.join(reference, "g", "left").select("g", "size", F.coalesce("reference", F.array().cast("array<long>")).alias("reference")), "near-references")
    d = F.concat(F.array_except("items", "reference"), F.array_except("reference", "items"))
    told = common.lookup_long_by_group(held, groups, ["g"], "size", F.lit(8) * F.size("reference"), F.xxhash64("id")).select("id", "g", "component", "n", d.alias("d"))
    excess = F.lit(100 + percent) * F.size("d") - F.lit(100 - percent) * F.col("n")
    return common.settle(told.select("id", "g", "component", excess.cast("long").alias("excess"), "d"), "near-differences")


def _needed(one: Column, two: Column, percent: int) -> Column:
    """Common items that two sets' excesses ask for; 1 at least, as pairs that need none are linked first."""
    return F.greatest(F.lit(1), F.ceil((one + two) / F.lit(2 * (100 + percent))).cast("long"))


def _relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``now``, the component that the component links (a, b) make of ``component``."""
    merged = common.settle(connected_components(links), "near-merged").select(F.col("id").alias("component"), F.col("component").alias("now"))
    return rows.drop("now").join(merged, "component", "left").withColumn("now", F.coalesce("now", "component"))


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` (id, g, now, excess, d) with xs, the items of d that several components of the group have, rarest first, and their number k."""
    each = rows.select("id", "g", "now", F.explode("d").alias("item"))
    counted = each.groupBy("g", "item").agg(F.count("*").alias("c"), F.min("now").alias("x"), F.max("now").alias("y")).filter("x <> y").select("g", "item", "c")
    counted = common.settle(counted, "near-items")
    xs = each.select("id", "g", "item").join(counted, ["g", "item"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "item"))).alias("xs"))
    xs = xs.select("id", F.size("xs").cast("long").alias("k"), F.col("xs.item").alias("xs"))
    return common.settle(rows.select("id", "g", "component", "now", "excess").join(xs, "id"), "near-shared")


def _keys(seed: int):
    random = np.random.default_rng(seed)
    factor = random.integers(1, 1 << 63, TABLES * DEPTH, dtype=np.uint64) * _U(2) + _U(1)
    add = random.integers(0, 1 << 63, TABLES * DEPTH, dtype=np.uint64)
    start = mix(np.arange(1, TABLES + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column("xs")
            ends = items.offsets.to_numpy()
            flat = items.values.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            keys = np.zeros((b.num_rows, TABLES), np.int64)
            for i in range(b.num_rows):
                own = flat[ends[i] : ends[i + 1]]
                least = np.array([(own * f + a).min() for f, a in zip(factor, add, strict=True)], _U)
                key = start.copy()
                for d in range(DEPTH):
                    key = mix(key ^ least[d::DEPTH] * _U(0x9E3779B97F4A7C15))
                keys[i] = key.astype(np.int64)
            offsets = pa.array(np.arange(0, TABLES * b.num_rows + 1, TABLES), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("g"), b.column("now"), b.column("excess"), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))], names=["id", "g", "now", "excess", "tables"])

    return run


def _linked(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Of candidate ids (a, b) in different components: the component links (a, b) of those that are similar enough."""
    side = lambda c: shared.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"), F.col("excess").alias(f"excess_{c}"), F.col("xs").alias(f"xs_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    enough = F.lit(2 * (100 + percent)) * F.size(F.array_intersect("xs_a", "xs_b")) >= F.col("excess_a") + F.col("excess_b")
    return both.filter(enough).select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).distinct()


def _nearest(rows: DataFrame) -> DataFrame:
    """Step 1: component links of the sets that need nothing in common with the set of least excess of their group."""
    least = common.settle(rows.groupBy("g").agg(F.min(F.struct("excess", "id", "component")).alias("m"), F.count("*").alias("size")).select("g", "size", F.col("m.excess").alias("least"), F.col("m.component").alias("centre")), "near-least")
    told = common.lookup_by_group(rows.select("g", "component", "excess"), least, ["g"], "size")
    return told.filter("component <> centre AND excess + least <= 0").select(F.col("centre").alias("a"), F.col("component").alias("b")).distinct()


def _starred(shared: DataFrame, seed: int) -> DataFrame:
    """Step 2: candidates (a, b), each set with the set of least excess of its bucket."""
    keyed = shared.select("id", "g", "now", "excess", "xs").mapInArrow(_keys(seed), "id long, g long, now long, excess long, tables array<long>")
    rows = common.settle(keyed.select("id", "g", "now", "excess", F.explode("tables").alias("table")), "near-tables")
    centres = rows.groupBy("g", "table").agg(F.min(F.struct("excess", "id", "now")).alias("m"), F.min("now").alias("x"), F.max("now").alias("y")).filter("x <> y")
    centres = common.settle(centres.select("g", "table", F.col("m.id").alias("centre"), F.col("m.now").alias("centre_now")), "near-centres")
    return rows.join(centres, ["g", "table"]).filter("now <> centre_now").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()


def _joined(shared: DataFrame, percent: int) -> DataFrame:
    """Step 3: candidates (a, b) in different components, a superset of all links between components.

    Two linked sets have ``o = _needed(...)`` common items or more, all among their xs. In an order
    common to all (rarest first) the first of them has o - 1 after it in either list, so its rank is
    at most k - o in both. The prefixes for the least excess of any other component are posted, and
    a pair must meet by an item that both ranks allow for its own o. A posted item's rows of its
    most frequent component are not joined with one another.
    """
    lows = common.settle(shared.groupBy("g", "now").agg(F.min("excess").alias("low"), F.count("*").alias("size")), "near-lows")
    first = common.settle(lows.groupBy("g").agg(F.min(F.struct("low", "now")).alias("m"), F.sum("size").alias("size")).select("g", "size", F.col("m.low").alias("low_1"), F.col("m.now").alias("now_1")), "near-first")
    # Groups of many components are as uneven here as anywhere; the sums below are partial before their exchange.
    others = common.lookup_by_group(lows, first.select("g", "low_1", "now_1", "size").withColumnRenamed("size", "all"), ["g"], "all")
    second = others.filter("now <> now_1").groupBy("g").agg(F.min("low").alias("low_2"))
    bounds = common.settle(first.join(second, "g"), "near-bounds")
    told = common.lookup_by_group(shared, bounds, ["g"], "size").filter("low_2 IS NOT NULL")
    other = F.when(F.col("now") == F.col("now_1"), F.col("low_2")).otherwise(F.col("low_1"))
    able = told.withColumn("upto", (F.col("k") - _needed(F.col("excess"), other, percent) + 1).cast("int")).filter("upto > 0")
    posted = common.settle(able.select("id", "g", "now", "excess", "k", F.posexplode(F.slice("xs", F.lit(1), F.col("upto"))).alias("rank", "item")), "near-prefixes")

    counted = posted.groupBy("g", "item", "now").agg(F.count("*").alias("c"))
    mains = counted.groupBy("g", "item").agg(F.max_by("now", F.struct("c", "now")).alias("main"), F.count("*").alias("components")).filter("components > 1").select("g", "item", "main")
    mains = common.settle(mains, "near-mains")
    own = ("id", "now", "excess", "k", "rank")
    left = common.settle(posted.join(mains, ["g", "item"]).filter("now <> main").select("g", "item", "main", *(F.col(c).alias(f"{c}_x") for c in own)), "near-left")
    right = posted.select("g", "item", *(F.col(c).alias(f"{c}_y") for c in own))
    need = _needed(F.col("excess_x"), F.col("excess_y"), percent)
    fits = (F.col("now_x") != F.col("now_y")) & ((F.col("now_y") == F.col("main")) | (F.col("id_x") < F.col("id_y")))
    fits &= (F.col("rank_x") + need <= F.col("k_x")) & (F.col("rank_y") + need <= F.col("k_y"))
    joined = left.alias("l").join(right.alias("r"), (F.col("l.g") == F.col("r.g")) & (F.col("l.item") == F.col("r.item")) & fits)
    return joined.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def component_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of ``met`` (id, g, component, n) that join all that ``sets`` (id, items) link within a group g.

    ``met`` is a settled table with one row for each id; sets are not empty. What is returned may
    hold a link twice, and leaves out links that others imply.
    """
    rows = differences(met, sets, percent)
    links = common.settle(_nearest(rows), "near-nearest")
    shared = _shared(_relabelled(rows, links))
    pairs = shared.groupBy("g").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).first()["pairs"] or 0
    components = rows.select("component").distinct().count() if pairs > FEW_PAIRS else 0
    for seed in range(ROUNDS if pairs > FEW_PAIRS else 0):
        new = common.settle(_linked(common.settle(_starred(shared, seed), "near-starred"), shared, percent), "near-starred-links")
        found = new.count()
        if found:
            links = links.unionByName(new)
        if found < components * WORTH:
            break
        shared = _relabelled(shared, links)
    if pairs > FEW_PAIRS:
        shared = _shared(_relabelled(rows, links))
    last = common.settle(_linked(common.settle(_joined(shared, percent), "near-joined"), shared, percent), "near-joined-links")
    return links.unionByName(last)
