"""Units of packets and samples as Column expressions: AVI clocks, packet ticks, sample sizes, HDR light, planes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenflow.functions.media import opus_frame_us, opus_frames

#: Bytes of a sample by format.
SAMPLE_BYTES = {"u8": 1, "s16": 2, "s32": 4, "f32": 4, "f64": 8}


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1)).cast("decimal(12,0)")


def avi_units(samples: Column, rate: Column, scale: Column, sample_rate: Column, length: Column, up: bool = False) -> Column:
    """AVI units of so many samples, rounded down (or ``up``), at most ``length`` unless that is 0; fields of 0 act as 1."""
    over = _least_one(scale) * _least_one(sample_rate)
    units = samples.cast("decimal(20,0)") * _least_one(rate)
    rest = units % over
    units = _whole((units - rest) / over) + (F.when(rest > 0, 1).otherwise(0) if up else 0)
    units = F.least(units, F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")).cast("bigint")
    return F.when(length == 0, units).otherwise(F.least(units, length.cast("bigint")))


def avi_samples(units: Column, rate: Column, scale: Column, sample_rate: Column) -> Column:
    """Samples of so many AVI units, rounded down."""
    n = units.cast("decimal(14,0)") * _least_one(scale) * _least_one(sample_rate)
    by = _least_one(rate)
    return _whole((n - n % by) / by).cast("bigint")


def avi_chunk_units(sample_size: Column, size: Column) -> Column:
    """Units of a chunk: 1 where samples have no size, else how many fit, at least 1 if there are bytes."""
    fit = F.call_function("div", size.cast("bigint"), F.nullif(sample_size.cast("bigint"), F.lit(0)))
    return F.when(sample_size == 0, 1).otherwise(F.greatest(fit, F.when(size > 0, 1).otherwise(0))).cast("bigint")


def packet_ticks(codec: Column, toc: Column, count: Column, scale_ns: Column, sample_rate: Column) -> Column:
    """Ticks of ``scale_ns`` of an Opus packet or an AAC frame, at least 1; null for other codecs, and for AAC without a rate."""
    opus = opus_frames(toc, count).cast("bigint") * opus_frame_us(toc) * 1000
    aac = F.call_function("div", F.lit(1024 * 1_000_000_000).cast("bigint"), F.when(sample_rate > 0, sample_rate.cast("bigint")))
    ns = F.when(codec == "opus", opus).when(codec == "aac", aac)
    ticks = F.call_function("div", ns, F.greatest(scale_ns.cast("bigint"), F.lit(1)))
    return F.when(ns.isNotNull(), F.greatest(ticks, F.lit(1)))


def sample_bytes(fmt: Column, channels: Column | int = 1) -> Column:
    """Bytes of one sample of each channel; null for unknown formats."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in SAMPLE_BYTES.items() for x in pair)), fmt) * channels


def block_align(bits: Column, channels: Column) -> Column:
    """Bytes of one PCM frame: whole bytes a sample, all channels."""
    return F.call_function("div", (bits + 7).cast("bigint"), F.lit(8)) * channels


def peak_light(max_cll: Column, mastering_max: Column) -> Column:
    """The measured peak, or else the mastering display's."""
    return F.coalesce(max_cll, mastering_max)


def light_over(container: Column, stream: Column) -> Column:
    """Field by field what the container says of light, else the bitstream."""
    return F.struct(*(F.coalesce(container[f], stream[f]).alias(f) for f in ("max_cll", "max_fall", "mastering_max", "mastering_min")))


def interleave(channels: Column) -> Column:
    """An array of equal channels as one array of frames."""
    n = F.size(F.element_at(channels, 1))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(channels, lambda c: F.get(c, i))))


def deinterleave(samples: Column, channels: int) -> Column:
    """An array of frames as an array of channels; a partial frame at the end is dropped."""
    n = F.call_function("div", F.size(samples).cast("bigint"), F.lit(channels)).cast("int")
    own = lambda c: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(samples, i * channels + c))).otherwise(F.slice(samples, 1, 0))
    return F.array(*(own(c) for c in range(channels)))


def nv12_chroma(u: Column, v: Column) -> Column:
    """One plane of pairs from two chroma planes; :func:`deinterleave` by 2 is its inverse."""
    return F.flatten(F.zip_with(u, v, lambda a, b: F.array(a, b)))


def fixed_residual(samples: Column, order: int) -> Column:
    """What a fixed predictor of ``order`` 0 to 4 leaves of integer samples, behind the first ``order`` samples as they are."""
    terms = [(-1) ** j * math.comb(order, j) for j in range(order + 1)]
    at = lambda i: sum((F.get(samples, i - j) * t for j, t in enumerate(terms) if j), F.get(samples, i) * terms[0])
    return F.transform(samples, lambda x, i: F.when(i < order, x).otherwise(at(i)))
