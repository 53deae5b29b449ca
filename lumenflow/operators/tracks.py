"""Tables of samples, packets, pages and streams: composition times, edits, chunks, clocks, defaults, verdicts.

A stream's rows are told apart by the order columns given. Helper columns are named apart from the
rows' own. Windows over a stream are single ordered passes; folds are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.functions import timebase, units
from lumenflow.operators.timeline import unused


def composed(samples: DataFrame, offsets: DataFrame, syncs: DataFrame, track: str, number: str, dts: str = "dts") -> DataFrame:
    """``samples`` with cts and sync: decode times plus the offset of (track, number) if it has one; all are sync in a track that ``syncs`` does not name."""
    seen, listed, off = unused(samples, "seen", "listed", "off")
    shifted = samples.join(offsets.select(track, number, F.col("offset").alias(off)), [track, number], "left")
    marked = shifted.join(syncs.select(track, number, F.lit(True).alias(seen)), [track, number], "left")
    named = marked.join(syncs.select(track, F.lit(True).alias(listed)).distinct(), track, "left")
    sync = F.col(listed).isNull() | F.col(seen).isNotNull()
    return named.select(*samples.columns, (F.col(dts) + F.coalesce(F.col(off), F.lit(0))).alias("cts"), sync.alias("sync"))


def edit_shift(edits: DataFrame, track: str, order: str, media_time: str, duration: str, movie: tuple[int, int], media: tuple[int, int]) -> DataFrame:
    """(track, shift): empty edits (a negative media time) in the track's ticks, each rounded, less the first media time that is none."""
    empty = F.when(F.col(media_time) < 0, timebase.rescale(F.col(duration), movie, media))
    first = F.min_by(F.when(F.col(media_time) >= 0, F.col(media_time)), F.when(F.col(media_time) >= 0, F.col(order)))
    return edits.groupBy(track).agg((F.coalesce(F.sum(empty), F.lit(0)) - F.coalesce(first, F.lit(0))).alias("shift"))


def packet_times(packets: DataFrame, stream: str, order: str, base: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """``packets`` (with dts, pts, duration; dts and pts may be null) with out_dts and out_cts in ticks of ``to``.

    The decode time is the packet's, else its presentation time, else where the packet before it ends.
    """
    w = Window.partitionBy(stream).orderBy(order)
    own, known, passed = unused(packets, "own", "known", "passed")
    told = packets.withColumn(own, F.coalesce("dts", "pts"))
    told = told.withColumn(known, F.count(own).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(stream, known).orderBy(order)
    told = told.withColumn(passed, F.coalesce(F.sum("duration").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dts = F.coalesce(F.first(own, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.col(passed)
    out = told.select(*packets.columns, dts.alias(own))
    return out.select(*packets.columns, timebase.rescale(F.col(own), base, to).alias("out_dts"), timebase.rescale(F.coalesce(F.col("pts"), F.col(own)), base, to).alias("out_cts"))


def chunks(samples: DataFrame, track: str, order: list[str], offset: str, size: str) -> DataFrame:
    """(track, chunk, offset, samples, bytes): neighbours of a track that lie side by side in the file are one chunk."""
    w = Window.partitionBy("t").orderBy("o")
    held = samples.select(F.col(track).alias("t"), F.struct(*order).alias("o"), F.col(offset).alias("at"), F.col(size).alias("n"))
    cut = F.when(F.lag(F.col("at") + F.col("n")).over(w) == F.col("at"), 0).otherwise(1)
    numbered = held.withColumn("cut", cut).withColumn("chunk", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    out = numbered.groupBy("t", "chunk").agg(F.min_by("at", "o").alias("offset"), F.count("*").alias("samples"), F.sum("n").alias("bytes"))
    return out.withColumnRenamed("t", track)


def unit_clocks(index: DataFrame, stream: str, offset: str, size: str, sample_size: str, name: str = "time") -> DataFrame:
    """``index`` with the units of its stream's chunks that lie before each in the file."""
    w = Window.partitionBy(stream).orderBy(offset).rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn(name, F.coalesce(F.sum(units.avi_chunk_units(F.col(sample_size), F.col(size))).over(w), F.lit(0)))


def fragment_samples(runs: DataFrame, defaults: DataFrame, track: str, fragment: str, number: str) -> DataFrame:
    """Samples of fragments: own fields, else the fragment's, else the track's; decode times run on from the fragment's start or the track's last sample.

    ``runs`` has duration, size, flags (null where not said), fragment_duration, fragment_size,
    fragment_flags and start; ``defaults`` track, default_duration, default_size, default_flags.
    """
    told = runs.join(defaults, track, "left")
    pick = lambda f: F.coalesce(F.col(f), F.col(f"fragment_{f}"), F.col(f"default_{f}"), F.lit(0))
    told = told.select(track, fragment, number, "start", *(pick(f).cast("bigint").alias(f) for f in ("duration", "size", "flags")))
    w = Window.partitionBy(track).orderBy(fragment, number)
    told = told.withColumn("epoch", F.count("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(track, "epoch").orderBy(fragment, number)
    dts = F.coalesce(F.first("start", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.coalesce(F.sum("duration").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.select(track, fragment, number, dts.cast("bigint").alias("dts"), "duration", "size", (F.col("flags").bitwiseAND(1 << 16) == 0).alias("sync"))


def longest(streams: DataFrame, group: str, stream: str) -> DataFrame:
    """(group, stream, seconds) of the longest stream: duration less the padding in front, rounded down to its ticks.

    ``streams`` has duration, num, den (seconds of a tick), padding (samples) and sample_rate; streams
    without a duration are left out. Of equal lengths the last stream stands.
    """
    padded = (F.col("padding") > 0) & (F.col("sample_rate") > 0)
    exact = F.col("padding").cast("decimal(12,0)") * F.col("den").cast("decimal(10,0)")
    by = F.col("sample_rate").cast("decimal(10,0)") * F.col("num").cast("decimal(10,0)")
    ticks = F.when(padded, ((exact - exact % by) / by).cast("decimal(38,0)").cast("bigint")).otherwise(0)
    seconds = (F.col("duration") - ticks).cast("double") * (F.col("num").cast("double") / F.col("den").cast("double"))
    told = streams.filter("duration IS NOT NULL").select(group, stream, seconds.alias("seconds"))
    return told.groupBy(group).agg(F.max(F.struct("seconds", stream)).alias("x")).select(group, f"x.{stream}", "x.seconds")


def unsupported(streams: DataFrame, decoders: DataFrame, kind: str, codec: str) -> DataFrame:
    """The audio streams whose codec is not among ``decoders``; that table is small by nature, so Spark broadcasts it by its size."""
    return streams.filter(F.col(kind) == "audio").join(decoders.select(codec), codec, "left_anti")


def last_granules(pages: DataFrame, serial: str, granule: str, offset: str) -> DataFrame:
    """(serial, granule) of each stream's last page that ends a packet (a granule of -1 says none does)."""
    return pages.filter(F.col(granule) != -1).groupBy(serial).agg(F.max_by(granule, offset).alias(granule))


def interleaved(samples: DataFrame, group: str, offset: str, name: str = "nth") -> DataFrame:
    """``samples`` with their place in the file's order of bytes, whichever track they are of."""
    return samples.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(offset)).cast("bigint"))


def cue_index(cues: DataFrame, file: str, time: str, track: str, name: str = "place") -> DataFrame:
    """``cues`` with their place by time, then track."""
    return cues.withColumn(name, F.row_number().over(Window.partitionBy(file).orderBy(time, track)).cast("bigint"))


def picture_quality(frames: DataFrame, group: str, psnr: str) -> DataFrame:
    """(group, frames, mean_psnr over the finite ones, min_psnr over all; null stands for infinite)."""
    return frames.groupBy(group).agg(F.count("*").alias("frames"), F.avg(psnr).alias("mean_psnr"), F.min(psnr).alias("min_psnr"))


def sound_verdict(n: Column, m: Column, corr: Column, rms: Column) -> Column:
    """Whether two signals pass as one: lengths within 1 %, correlation 0.999 or more, RMS of the difference 0.001 at most."""
    return (F.abs(n - m) * 100 <= F.greatest(n, m)) & (corr >= 0.999) & (rms <= 1e-3)


def overlap_add(blocks: DataFrame, stream: str, number: str, values: str, hop: int) -> DataFrame:
    """(stream, at, value): blocks of samples laid ``hop`` apart and summed where they overlap."""
    each = blocks.select(stream, number, F.posexplode(values).alias("i", "v"))
    return each.groupBy(stream, (F.col(number) * hop + F.col("i")).cast("bigint").alias("at")).agg(F.sum("v").alias("value"))


def discard_preroll(frames: DataFrame, flag: str = "discard") -> DataFrame:
    """Frames that were decoded only to reach the ones wanted go."""
    return frames.filter(~F.coalesce(F.col(flag), F.lit(False)))
