"""Operators over packet timelines: seeks, clocks, sample tables, run lengths, default streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(rows: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front, so that none is a column of ``rows`` in any case."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def seek_sample(rows: DataFrame, stream: str, at: str, order: str, sync: Column, before: str = "before", after: str = "after") -> DataFrame:
    """For each row as a target: where a sample table lands, walking back and forth from the last sample at or before it.

    Back to the last sync sample, or else the stream's first sample; forth to the first sync sample, or
    else the stream's last sample, sync or not. ``order`` tells samples at one time apart.
    """
    whole = Window.partitionBy(stream)
    upto = whole.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = whole.orderBy(at).rangeBetween(1, Window.unboundedFollowing)
    here = F.when(sync, F.col(at))
    held = F.max(F.struct(F.col(at).alias("at"), F.col(order).alias("by"), sync.alias("sync"))).over(upto)
    back = F.coalesce(F.max(here).over(upto), F.min(at).over(whole))
    forth = F.when(held["sync"], held["at"]).otherwise(F.coalesce(F.min(here).over(later), F.max(at).over(whole)))
    return rows.select("*", back.alias(before), forth.alias(after))


def seek_before(rows: DataFrame, stream: str, at: str, sync: Column, name: str = "seek", clamp: bool = False) -> DataFrame:
    """For each row the last sync position at or before it in its stream; with ``clamp`` the first one where there is none."""
    w = Window.partitionBy(stream).orderBy(at)
    here = F.when(sync, F.col(at))
    found = F.last(here, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    if clamp:
        found = F.coalesce(found, F.min(here).over(Window.partitionBy(stream)))
    return rows.withColumn(name, found)


def seek_after(rows: DataFrame, stream: str, at: str, sync: Column, name: str = "seek", strict: bool = False, clamp: bool = False) -> DataFrame:
    """For each row the first sync position at or after it (after it if ``strict``); with ``clamp`` the last one where there is none."""
    here = F.when(sync, F.col(at))
    w = Window.partitionBy(stream).orderBy(at)
    w = w.rangeBetween(1, Window.unboundedFollowing) if strict else w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = F.min(here).over(w)
    if clamp:
        found = F.coalesce(found, F.max(here).over(Window.partitionBy(stream)))
    return rows.withColumn(name, found)


def default_stream(rows: DataFrame, group: list[str], flag: Column, order: str) -> DataFrame:
    """One row for each group: the first flagged, else the first."""
    w = Window.partitionBy(*group).orderBy(flag.desc(), F.col(order))
    (n,) = unused(rows, "n")
    return rows.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n)


def decode_times(rows: DataFrame, stream: str, order: list[str], delta: str, name: str = "dts") -> DataFrame:
    """The running sum of the durations before each row of its stream; the first is 0."""
    w = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(delta).over(w), F.lit(0)))


def durations(rows: DataFrame, stream: str, order: str, name: str = "duration") -> DataFrame:
    """Time to the next row of the stream, at least 0; the last repeats the one before it."""
    w = Window.partitionBy(stream).orderBy(order)
    step = F.lead(order).over(w) - F.col(order)
    return rows.withColumn(name, F.greatest(F.coalesce(step, F.col(order) - F.lag(order).over(w), F.lit(0)), F.lit(0)))


def run_lengths(rows: DataFrame, stream: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: stream, run (from 1), value, n."""
    w = Window.partitionBy(stream).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    held = rows.select(F.col(stream).alias("s"), F.col(value).alias("v"), changed.alias("changed"), F.struct(*order).alias("o"))
    upto = Window.partitionBy("s").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    runs = held.withColumn("run", F.sum("changed").over(upto).cast("bigint"))
    return runs.groupBy("s", "run").agg(F.first("v").alias("v"), F.count("*").alias("n")).select(F.col("s").alias(stream), "run", F.col("v").alias(value), "n")


def expand_runs(runs: DataFrame, stream: str, run: str, n: str, value: str) -> DataFrame:
    """One row for each element of the runs: stream, sample (from 1), value."""
    w = Window.partitionBy(stream).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    before = runs.filter(F.col(n) > 0).select(F.col(stream).alias("s"), F.col(value).alias("v"), F.col(n).cast("bigint").alias("n"), F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint").alias("before"))
    return before.select("s", "v", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("sample")).select(F.col("s").alias(stream), "sample", F.col("v").alias(value))


def reduced_ratio(num: Column, den: Column) -> tuple[Column, Column]:
    """A ratio of non-negative whole numbers in lowest terms, by Euclid's rule unrolled on an array; null for a zero denominator."""
    pair = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(pair(acc["b"], acc["a"] % F.greatest(acc["b"], F.lit(1))))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair(num, den), step)  # 92 steps do for any 64-bit numbers
    g = F.nullif(steps["a"], F.lit(0))
    div = lambda a: F.call_function("div", a.cast("bigint"), g)
    return div(num), F.when(den != 0, div(den))


def visible(points: DataFrame, cues: DataFrame, stream: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined with the cues of their stream that are up: ``start <= at < end``.

    Cues are laid out over buckets of ``width``, so the join is an equality of stream and bucket, not a
    product of a stream's points and cues. A cue yields a row for each bucket it touches: ``width``
    should be about a usual cue's length. Points without a cue give no row; cues without a length
    match nothing.
    """
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    b = max(unused(points, "bucket")[0], unused(cues, "bucket")[0], key=len)
    laid = cues.filter(F.col(end) > F.col(start)).withColumn(b, F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) - 1))))
    return points.withColumn(b, bucket(F.col(at))).join(laid, [stream, b]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop(b)
