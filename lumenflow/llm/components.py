"""Connected components of links that stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import common

#: Links that one task labels: a few tens of megabytes in its worker. More go through the rounds.
AT_ONCE = 100_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all links (a, b) of the batches, by union and find."""
    above: dict[int, int] = {}

    def least(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = least(a), least(b)
            above[max(a, b)] = min(a, b)
    if above:
        ids = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(least, ids), pa.int64())], names=["id", "component"])


def _are_stars(links: DataFrame) -> bool:
    """Whether every a has one b and no b is an a."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: long columns a, b. Gives (id, component): each id that has a link, with the least id reachable.

    Up to ``AT_ONCE`` links are labelled in one task of an executor: a round costs the driver half a
    dozen plans, however few the links are. More go through rounds of two steps until all components are stars around their least node: every node links its
    larger neighbours to its least neighbour, then its smaller ones. A round's table goes to the
    shared folder, so its lineage is short; nothing but the end of the rounds reaches the driver.
    Rounds grow with the logarithm of the links. A hot node is handled by partial aggregation and by
    a join with a settled table, which adaptive execution can split.
    """
    now = common.settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.count() <= AT_ONCE:
        return now.coalesce(1).mapInArrow(_united, "id long, component long")
    while not _are_stars(now):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "links-least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.settle(large, "links-large")
        least = common.settle(large.groupBy("a").agg(F.min("b").alias("m")), "links-least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        now = common.settle(small.filter("a <> b").distinct(), "links")
    own = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(own)
