"""Boundary cases of the expressions."""

import math

import pytest
from pyspark.sql import functions as F

from lumenflow.functions import cues, media, timebase
from lumenflow.operators import signal, timeline


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("rounding", "want"), [("down", -2), ("up", -1), ("zero", -1), ("nearest", -2)])
def test_rounding(spark, rounding, want):
    assert one(spark, timebase.rescale(F.lit(-1500), (1, 1000), (1, 1), rounding))[0] == want


def test_rescale_is_exact(spark):
    assert one(spark, timebase.rescale(F.lit(863136), (1001, 24000), (1, 90000)))[0] == 3239996760
    assert one(spark, timebase.rescale(F.lit(None).cast("bigint"), (1, 1), (1, 2)))[0] is None


def test_clock(spark):
    got = one(spark, *(cues.clock_us(F.lit(t)) for t in ("00:00:01,5", "-1:02.25", "7", "1:2:3:4", "x", "")))
    assert list(got) == [1_500_000, -62_250_000, 7_000_000, None, None, None]


def test_plain_text(spark):
    assert one(spark, cues.plain_text(F.lit(r"{\i1}a<b>c</b>\Nd &lt;e&gt; &amp;lt;")))[0] == "ac\nd <e> &lt;"


def test_media(spark):
    assert one(spark, media.frame_bytes(F.lit("p010le"), F.lit(1920), F.lit(1080)))[0] == 1920 * 1080 * 3
    assert one(spark, media.frame_bytes(F.lit("yuv420p"), F.lit(3), F.lit(3)))[0] == 9 + 2 * 4
    assert one(spark, media.frame_bytes(F.lit("what"), F.lit(3), F.lit(3)))[0] is None
    assert one(spark, media.opus_samples(F.lit(0b00011011), F.lit(3)))[0] is None  # 3 x 60 ms is over the limit
    assert one(spark, media.sniff(F.lit(b"OggS\x00")))[0] == "ogg"


def test_signals(spark):
    a, b = F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (2.0, 2.0, 2.0)))
    z = F.array(*map(F.lit, (0.0, 0.0, 0.0)))
    got = one(spark, signal.correlation(a, a), signal.correlation(a, b), signal.correlation(z, z), signal.correlation(z, b), signal.psnr(a, a, 1.0), signal.psnr(a, F.transform(a, lambda x: x + 1), 255.0))
    assert [round(x, 4) if x is not None else None for x in got] == [1.0, 0.0, 1.0, 0.0, None, 48.1308]


def test_mdct_overlap_add(spark):
    import numpy as np

    n, w = 8, np.array(signal.sine_window(16))
    x = np.random.default_rng(0).normal(size=24)
    m, i = np.array(signal.mdct_rows(n)), np.array(signal.imdct_rows(n))
    y = np.zeros(24)
    for s in (0, 8):
        y[s : s + 16] += w * (i @ (m @ (w * x[s : s + 16])))
    assert np.allclose(y[8:16], x[8:16])


def test_runs_round_trip(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbbac")], "s int, i int, v string")
    runs = timeline.run_lengths(rows, "s", ["i"], "v")
    assert [(r.v, r.n) for r in runs.orderBy("run").collect()] == [("a", 2), ("b", 3), ("a", 1), ("c", 1)]
    assert "".join(r.v for r in timeline.expand_runs(runs, "s", "run", "n", "v").orderBy("sample").collect()) == "aabbbac"


def test_ratio(spark):
    num, den = timeline.reduced_ratio(F.lit(90000), F.lit(3003))
    assert list(one(spark, num, den)) == [30000, 1001]
    num, den = timeline.reduced_ratio(F.lit(5), F.lit(0))
    assert one(spark, den)[0] is None and math.isclose(one(spark, num)[0], 1)


def test_bounds_and_exact_ratios(spark):
    from lumenflow.functions import cues, labels, timebase
    from lumenflow.operators import timeline

    big = (1 << 62) + 1
    num, den = timeline.reduced_ratio(F.lit((1 << 53) + 1), F.lit(1))
    row = spark.range(1).select(
        timebase.rescale(F.lit(big), (1, 1), (1, 1000)).alias("most"),
        timebase.rescale(F.lit(-big), (1, 1), (1, 1000)).alias("least"),
        timebase.checked_rescale(F.lit(big), (1, 1), (1, 1000)).alias("none"),
        num.alias("num"),
        den.alias("den"),
        cues.clock_us(F.lit(" 01:02:03.1234567 x")).alias("clock"),
        cues.clock_us(F.lit("1:2:3:4")).alias("no_clock"),
        labels.language(F.lit("fra"), F.lit(None).cast("string")).alias("legacy"),
    ).first()
    assert tuple(row) == ((1 << 63) - 1, -(1 << 63), None, (1 << 53) + 1, 1, 3_723_123_456, None, "fra")


def test_columns_of_any_name_stay(spark):
    from lumenflow.operators import timeline

    rows = spark.createDataFrame([(1, 5, "a", 9), (1, 6, "b", 9), (2, 7, "c", 8)], "s int, at long, n string, changed int")
    assert sorted(map(tuple, timeline.default_stream(rows, ["s"], F.col("n") == "b", "at").collect())) == [(1, 6, "b", 9), (2, 7, "c", 8)]
    assert sorted(map(tuple, timeline.run_lengths(rows, "s", ["at"], "changed").collect())) == [(1, 1, 9, 2), (2, 1, 8, 1)]
