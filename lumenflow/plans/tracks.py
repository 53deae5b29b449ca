"""Queries over sample tables, packet clocks, metadata words and signals; see :mod:`registry`.

An order is a track and its lines are samples: q, the quantity, is a size or duration; p, the part, a
number to derive the rest from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.functions import labels, timebase, units
from lumenflow.operators import tracks
from lumenflow.operators.timeline import Window
from lumenflow.plans.registry import _OFFSET, _query, _table

_S = "s AS (SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p FROM lineitem)"
_BEFORE = "OVER (PARTITION BY track ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


#: Rows that one task sorts: windows hold some hundred bytes for each, once for each order they ask for.
TASK_ROWS = 200_000


def _samples(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # Partitions grow in number with the rows (which Parquet's footers tell), not in size; the windows by track keep them.
    lines = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS)), "l_orderkey")
    return lines.select(F.col("l_orderkey").alias("track"), F.row_number().over(w).cast("bigint").alias("n"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_partkey").alias("p"))


def _running(c):
    w = Window.partitionBy("track").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(w), F.lit(0))


def _pick(values, index):
    """One of some constants by number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def _pick_sql(values, index):
    text = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{text}])[{index} + 1]"


# Sample tables --------------------------------------------------------------------------------


@_query("mp4_cts_sync", f"WITH {_S} SELECT track, n, CAST(coalesce(sum(q) {_BEFORE}, 0) + CASE WHEN p % 3 = 0 THEN p % 7 - 2 ELSE 0 END AS BIGINT) AS cts, track % 5 = 0 OR n % 4 = 1 AS sync FROM s")
def _cts_sync(spark, sf_dir):
    s = _samples(spark, sf_dir)
    offsets = s.filter("p % 3 = 0").select("track", "n", (F.col("p") % 7 - 2).alias("offset"))
    return tracks.composed(s.withColumn("dts", _running("q")), offsets, s.filter("track % 5 <> 0 AND n % 4 = 1"), "track", "n").select("track", "n", "cts", "sync")


@_query("mp4_edit_shift", f"WITH {_S} SELECT track, CAST(coalesce(sum(CASE WHEN p % 3 = 0 THEN (q * 882 + 10) // 20 END), 0) - coalesce(arg_min(p, n) FILTER (p % 3 <> 0), 0) AS BIGINT) AS shift FROM s GROUP BY track")
def _edit_shift(spark, sf_dir):
    edits = _samples(spark, sf_dir).withColumn("media_time", F.when(F.col("p") % 3 == 0, -1).otherwise(F.col("p")))
    return tracks.edit_shift(edits, "track", "n", "media_time", "q", (1, 1000), (1, 44100))


@_query(
    "mp4_chunking",
    f"""WITH {_S}, a AS (SELECT track, n, q, CAST(coalesce(sum(q) {_BEFORE}, 0) + 10 * count(*) FILTER (p % 4 = 0) OVER (PARTITION BY track ORDER BY n) AS BIGINT) AS off FROM s),
    c AS (SELECT *, CASE WHEN lag(off + q) OVER (PARTITION BY track ORDER BY n) = off THEN 0 ELSE 1 END AS cut FROM a), d AS (SELECT *, sum(cut) OVER (PARTITION BY track ORDER BY n) AS chunk FROM c)
    SELECT track, CAST(chunk AS BIGINT) AS chunk, min(off) AS "offset", count(*) AS samples, CAST(sum(q) AS BIGINT) AS bytes FROM d GROUP BY track, chunk""",
)
def _chunking(spark, sf_dir):
    gaps = F.count_if(F.col("p") % 4 == 0).over(Window.partitionBy("track").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    s = _samples(spark, sf_dir).withColumn("at", _running("q") + 10 * gaps)
    return tracks.chunks(s, "track", ["n"], "at", "q")


@_query(
    "mp4_packet_times",
    f"""WITH {_S}, d AS (SELECT track, n, q, CASE WHEN p % 4 = 0 THEN n * 40 END AS dts, CASE WHEN p % 3 = 0 THEN n * 40 + p % 5 END AS pts FROM s),
    o AS (SELECT *, coalesce(dts, pts) AS own, count(coalesce(dts, pts)) OVER (PARTITION BY track ORDER BY n) AS run FROM d),
    e AS (SELECT *, coalesce(first_value(own) OVER (PARTITION BY track, run ORDER BY n), 0) + coalesce(sum(q) OVER (PARTITION BY track, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM o)
    SELECT track, n, CAST((CAST(t AS HUGEINT) * 882 + 10) // 20 AS BIGINT) AS out_dts, CAST((CAST(coalesce(pts, t) AS HUGEINT) * 882 + 10) // 20 AS BIGINT) AS out_cts FROM e""",
)
def _packet_times(spark, sf_dir):
    n, p = F.col("n"), F.col("p")
    s = _samples(spark, sf_dir).select("track", "n", F.col("q").alias("duration"), F.when(p % 4 == 0, n * 40).alias("dts"), F.when(p % 3 == 0, n * 40 + p % 5).alias("pts"))
    return tracks.packet_times(s, "track", "n", (1, 1000), (1, 44100)).select("track", "n", "out_dts", "out_cts")


@_query(
    "mp4_fragments",
    f"""WITH {_S}, a AS (SELECT track, n // 4 AS f, n, CASE WHEN p % 2 = 0 THEN q END AS d, CASE WHEN n // 4 % 2 = 0 THEN 33 END AS fd, CASE WHEN track % 3 > 0 THEN 20 END AS td, CASE WHEN p % 5 = 0 THEN 65536 END AS g, CASE WHEN track % 3 > 0 THEN 65537 * (track % 2) END AS tg,
      CASE WHEN n % 4 = 0 AND n // 4 % 3 = 1 THEN n * 1000 END AS start FROM s),
    b AS (SELECT track, f, n, coalesce(d, fd, td, 0) AS d, coalesce(g, tg, 0) AS g, start, count(start) OVER (PARTITION BY track ORDER BY f, n) AS e FROM a)
    SELECT track, f AS fragment, n, CAST(coalesce(first_value(start) OVER w, 0) + coalesce(sum(d) OVER (PARTITION BY track, e ORDER BY f, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts, CAST(d AS BIGINT) AS duration, (g & 65536) = 0 AS sync
    FROM b WINDOW w AS (PARTITION BY track, e ORDER BY f, n)""",
)
def _fragments(spark, sf_dir):
    n, p = F.col("n"), F.col("p")
    f = F.floor(n / 4)
    runs = _samples(spark, sf_dir).select("track", f.alias("fragment"), "n", F.when(p % 2 == 0, F.col("q")).alias("duration"), F.lit(None).cast("bigint").alias("size"), F.when(p % 5 == 0, 65536).alias("flags"), F.when(f % 2 == 0, 33).alias("fragment_duration"), F.lit(7).alias("fragment_size"), F.lit(None).cast("int").alias("fragment_flags"), F.when((n % 4 == 0) & (f % 3 == 1), n * 1000).alias("start"))
    defaults = _samples(spark, sf_dir).filter("n = 1 AND track % 3 > 0").select("track", F.lit(20).alias("default_duration"), F.lit(1).alias("default_size"), (F.col("track") % 2 * 65537).alias("default_flags"))
    return tracks.fragment_samples(runs, defaults, "track", "fragment", "n").select("track", "fragment", "n", "dts", "duration", "sync")


@_query("mp4_interleave", f"WITH {_S} SELECT track, n, row_number() OVER (PARTITION BY track % 100 ORDER BY n, track) AS nth FROM s")
def _interleave(spark, sf_dir):
    s = _samples(spark, sf_dir).select("track", "n", (F.col("track") % 100).alias("file"), F.struct("n", "track").alias("at"))
    return tracks.interleaved(s, "file", "at").select("track", "n", "nth")


# Clocks and units -----------------------------------------------------------------------------


@_query("avi_stream_clock", "WITH u AS (SELECT event_id, user_id, CASE WHEN user_id % 4 = 0 THEN 1 ELSE greatest(event_id % 50 // (user_id % 4), CAST(event_id % 50 > 0 AS INT)) END AS k FROM events) SELECT event_id, CAST(coalesce(sum(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS time FROM u")
def _avi_clock(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 50).alias("size"), (F.col("user_id") % 4).alias("sample_size"))
    return tracks.unit_clocks(e, "user_id", "event_id", "size", "sample_size").select("event_id", "time")


@_query(
    "avi_units",
    """WITH e AS (SELECT event_id, CAST(event_id * 1000 AS HUGEINT) AS s, CAST(greatest(event_id % 5, 1) AS HUGEINT) AS r, CAST(greatest(event_id % 3, 1) AS HUGEINT) AS c, CAST(greatest(event_id % 2 * 8000, 1) AS HUGEINT) AS h, event_id % 4 * 50000 AS n FROM events),
    u AS (SELECT *, s * r // (c * h) AS lo, (s * r + c * h - 1) // (c * h) AS hi FROM e)
    SELECT event_id, CAST(CASE WHEN n = 0 THEN lo ELSE least(lo, n) END AS BIGINT) AS low, CAST(CASE WHEN n = 0 THEN hi ELSE least(hi, n) END AS BIGINT) AS high, CAST(s * c * h // r AS BIGINT) AS samples FROM u""",
)
def _avi_units(spark, sf_dir):
    e = F.col("event_id")
    s, r, c, h, n = e * 1000, e % 5, e % 3, e % 2 * 8000, e % 4 * 50_000
    return _table(spark, sf_dir, "events").select("event_id", units.avi_units(s, r, c, h, n).alias("low"), units.avi_units(s, r, c, h, n, up=True).alias("high"), units.avi_samples(s, r, c, h).alias("samples"))


_CODECS, _SCALES, _HERTZ = ("opus", "aac", "mp3"), (1_000_000, 0, 250_000), (0, 44_100, 48_000)


@_query(
    "matroska_packet_ticks",
    f"""WITH e AS (SELECT event_id, event_id % 256 AS toc, event_id // 256 % 64 AS c, {_pick_sql(_CODECS, "event_id % 3")} AS codec, greatest({_pick_sql(_SCALES, "user_id % 3")}, 1) AS scale, {_pick_sql(_HERTZ, "user_id % 3")} AS rate FROM events),
    u AS (SELECT *, CASE WHEN toc // 8 < 12 THEN ([10000, 20000, 40000, 60000])[toc // 8 % 4 + 1] WHEN toc // 8 < 16 THEN ([10000, 20000])[toc // 8 % 2 + 1] ELSE ([2500, 5000, 10000, 20000])[toc // 8 % 4 + 1] END AS us, CASE WHEN toc % 4 = 0 THEN 1 WHEN toc % 4 < 3 THEN 2 ELSE c END AS frames FROM e),
    n AS (SELECT *, CASE codec WHEN 'opus' THEN us * frames * 1000 WHEN 'aac' THEN CASE WHEN rate > 0 THEN 1024000000000 // rate END END AS ns FROM u)
    SELECT event_id, CAST(CASE WHEN ns IS NOT NULL THEN greatest(ns // scale, 1) END AS BIGINT) AS ticks FROM n""",
)
def _packet_ticks(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    return _table(spark, sf_dir, "events").select("event_id", units.packet_ticks(_pick(_CODECS, e % 3), (e % 256).cast("int"), (F.floor(e / 256) % 64).cast("int"), _pick(_SCALES, u % 3), _pick(_HERTZ, u % 3)).alias("ticks"))


@_query(
    "timestamp_arithmetic",
    f"""WITH e AS (SELECT event_id, CAST(epoch_us(ts) - {_OFFSET} AS HUGEINT) AS a, CAST((event_id - 5000) * 90000000 AS HUGEINT) AS b FROM events)
    SELECT event_id, CAST(sign(a * 9 - b * 100) AS INT) AS compared, CAST(a - (b * 100 // 9 + CASE WHEN abs(b * 100 % 9) * 2 >= 9 THEN sign(b) ELSE 0 END) AS BIGINT) AS diff,
    CASE WHEN a + {timebase.MOST} <= {timebase.MOST} THEN CAST(a + {timebase.MOST} AS BIGINT) END AS later FROM e""",
)
def _arithmetic(spark, sf_dir):
    a, b = timebase.micros("ts") - F.lit(_OFFSET), (F.col("event_id") - 5000) * 90_000_000
    micros, mpeg = (1, 1_000_000), (1, 90_000)
    e = _table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"))
    return e.select("event_id", timebase.compare(F.col("a"), micros, F.col("b"), mpeg).alias("compared"), timebase.diff(F.col("a"), micros, F.col("b"), mpeg).alias("diff"), timebase.advance(F.col("a"), F.lit(timebase.MOST)).alias("later"))


@_query(
    "rescale_bounds",
    f"""WITH e AS (SELECT event_id, CAST(event_id - 5000 AS HUGEINT) * 18446744073709 * 1000 AS x FROM events)
    SELECT event_id, CAST(greatest(least(x, {timebase.MOST}), {-timebase.MOST - 1}) AS BIGINT) AS saturated, CASE WHEN x BETWEEN {-timebase.MOST - 1} AND {timebase.MOST} THEN CAST(x AS BIGINT) END AS checked FROM e""",
)
def _bounds(spark, sf_dir):
    x, base = F.col("event_id") - 5000, (18446744073709, 1)  # the factor is in the time base: x times it need not fit 64 bits
    return _table(spark, sf_dir, "events").select("event_id", timebase.rescale(x, base, (1, 1000)).alias("saturated"), timebase.checked_rescale(x, base, (1, 1000)).alias("checked"))


_FORMATS = ("u8", "s16", "s32", "f32", "f64", "s24")
_BITS = (8, 12, 16, 24, 32)


@_query("sample_sizes", f"SELECT p_partkey, CAST({_pick_sql((1, 2, 4, 4, 8, None), 'p_partkey % 6')} * (p_size % 8 + 1) AS BIGINT) AS bytes, CAST(({_pick_sql(_BITS, 'p_partkey % 5')} + 7) // 8 * (p_size % 8 + 1) AS BIGINT) AS align FROM part")
def _sample_sizes(spark, sf_dir):
    k, channels = F.col("p_partkey"), F.col("p_size") % 8 + 1
    return _table(spark, sf_dir, "part").select("p_partkey", units.sample_bytes(_pick(_FORMATS, k % 6), channels).cast("bigint").alias("bytes"), units.block_align(_pick(_BITS, k % 5), channels).cast("bigint").alias("align"))


# Streams and files ----------------------------------------------------------------------------


@_query(
    "longest_stream",
    f"""WITH {_S}, t AS (SELECT track, n, p AS duration, CASE n % 3 WHEN 0 THEN 1000 WHEN 1 THEN 90000 ELSE 44100 END AS den, CASE WHEN n % 2 = 1 THEN q ELSE 0 END AS padding FROM s WHERE p % 4 <> 0),
    x AS (SELECT track, n, (duration - CASE WHEN padding > 0 THEN padding * den // 48000 ELSE 0 END) * (CAST(1 AS DOUBLE) / den) AS seconds FROM t)
    SELECT track, n, round(seconds, 9) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY seconds DESC, n DESC) AS k FROM x) WHERE k = 1""",
)
def _longest(spark, sf_dir):
    n = F.col("n")
    s = _samples(spark, sf_dir).select("track", "n", F.when(F.col("p") % 4 != 0, F.col("p")).alias("duration"), F.lit(1).alias("num"), F.when(n % 3 == 0, 1000).when(n % 3 == 1, 90000).otherwise(44100).alias("den"), F.when(n % 2 == 1, F.col("q")).otherwise(0).alias("padding"), F.lit(48000).alias("sample_rate"))
    return tracks.longest(s, "track", "n").select("track", "n", F.round("seconds", 9).alias("seconds"))


_KINDS, _NAMES, _DECODED = ("audio", "video", "subtitle"), ("aac", "dts", "opus", "flac", "mlp", "pcm", "wma"), ("aac", "opus", "flac", "pcm")


@_query("unsupported_streams", f"SELECT p_partkey, {_pick_sql(_NAMES, 'p_partkey % 7')} AS codec FROM part WHERE {_pick_sql(_KINDS, 'p_size % 3')} = 'audio' AND {_pick_sql(_NAMES, 'p_partkey % 7')} NOT IN {_DECODED}")
def _unsupported(spark, sf_dir):
    streams = _table(spark, sf_dir, "part").select("p_partkey", _pick(_KINDS, F.col("p_size") % 3).alias("kind"), _pick(_NAMES, F.col("p_partkey") % 7).alias("codec"))
    decoders = spark.createDataFrame([(c,) for c in _DECODED], "codec string")
    return tracks.unsupported(streams, decoders, "kind", "codec").select("p_partkey", "codec")


@_query("ogg_last_granule", "SELECT user_id, arg_max(event_id * 960, event_id) AS granule FROM events WHERE event_id % 5 <> 0 GROUP BY user_id")
def _last_granule(spark, sf_dir):
    pages = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, -1).otherwise(F.col("event_id") * 960).alias("granule"))
    return tracks.last_granules(pages, "user_id", "granule", "event_id")


@_query("cue_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) // 60000000, event_id) AS place FROM events")
def _cue_index(spark, sf_dir):
    cues = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("file"), F.floor(timebase.micros("ts") / 60_000_000).alias("time"))
    return tracks.cue_index(cues, "file", "time", "event_id").select("event_id", "place")


@_query("picture_quality", f"WITH {_S} SELECT track, count(*) AS frames, round(avg(CASE WHEN q <> 10 THEN 30 + q / 4.0 END), 9) AS mean_psnr, min(CASE WHEN q <> 10 THEN 30 + q / 4.0::DOUBLE END) AS min_psnr FROM s GROUP BY track")
def _picture_quality(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumn("psnr", F.when(F.col("q") != 10, 30 + F.col("q") / 4.0))
    return tracks.picture_quality(s, "track", "psnr").select("track", "frames", F.round("mean_psnr", 9).alias("mean_psnr"), "min_psnr")


@_query("sound_verdict", "SELECT p_partkey, abs(p_size * 10 - p_partkey % 500) * 100 <= greatest(p_size * 10, p_partkey % 500) AND p_partkey % 11 > 1 AND p_partkey % 13 < 12 AS passed FROM part")
def _sound_verdict(spark, sf_dir):
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", tracks.sound_verdict(F.col("p_size") * 10, k % 500, 0.997 + (k % 11) / 1000 + 1e-9, (k % 13) / 12000 + F.when(k % 13 == 12, 1e-5).otherwise(0)).alias("passed"))


@_query("hdr_light", "SELECT p_partkey, coalesce(nullif(p_partkey % 3, 0) * 100, nullif(p_size % 4, 0) * 1000) AS peak, coalesce(nullif(p_partkey % 3, 0) * 100, p_size) AS max_cll, CAST(nullif(p_size % 4, 0) * 1000 AS BIGINT) AS mastering_max FROM part")
def _hdr(spark, sf_dir):
    cll, most = F.nullif(F.col("p_partkey") % 3, F.lit(0)) * 100, F.nullif(F.col("p_size") % 4, F.lit(0)) * 1000
    light = lambda a, b: F.struct(a.alias("max_cll"), F.lit(None).cast("bigint").alias("max_fall"), b.alias("mastering_max"), F.lit(None).cast("bigint").alias("mastering_min"))
    over = units.light_over(light(cll, F.lit(None).cast("bigint")), light(F.col("p_size"), most))
    return _table(spark, sf_dir, "part").select("p_partkey", units.peak_light(cll, most).alias("peak"), over["max_cll"].alias("max_cll"), over["mastering_max"].cast("bigint").alias("mastering_max"))


@_query("preroll_discard", "SELECT event_id, user_id FROM events WHERE event_type <> 'error'")
def _preroll(spark, sf_dir):
    return tracks.discard_preroll(_table(spark, sf_dir, "events").withColumn("discard", F.col("event_type") == "error")).select("event_id", "user_id")


# Words and codes ------------------------------------------------------------------------------

_TAGS, _LEGACY = ("en-US", "fil", "", "de", "xx", "zh-Hant", "a", "PT"), ("", "fra", "und")
_TAG_CODES = ("eng", "fil", None, "deu", None, "zho", None, "por")


@_query("language_tags", f"SELECT event_id, coalesce({_pick_sql(_TAG_CODES, 'event_id % 8')}, nullif({_pick_sql(_LEGACY, 'event_id % 3')}, ''), 'und') AS language FROM events")
def _languages(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", labels.language(_pick(_LEGACY, F.col("event_id") % 3), _pick(_TAGS, F.col("event_id") % 8)).alias("language"))


_KEYS = ("PlayResX", " Wrap Style", "Scaled-Border", "ID3Tag", "already_snake", "Title9Text")


@_query("snake_case", f"WITH k AS (SELECT p_partkey, {_pick_sql(_KEYS, 'p_partkey % 6')} || p_name AS k FROM part) SELECT p_partkey, lower(translate(regexp_replace(trim(k), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), ' -', '__')) AS name FROM k")
def _snake(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", labels.snake_case(F.concat(_pick(_KEYS, F.col("p_partkey") % 6), "p_name")).alias("name"))


@_query("ass_colors", "WITH v AS (SELECT event_id, event_id * 429509 % 4294967296 AS v FROM events), w AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE [CAST(v & 255 AS INT), CAST((v >> 8) & 255 AS INT), CAST((v >> 16) & 255 AS INT), CAST(255 - ((v >> 24) & 255) AS INT)] END AS c FROM v) SELECT event_id, array_to_string(c, ',') AS rgba FROM w")
def _ass_colors(spark, sf_dir):
    v = F.col("event_id") * 429509 % 4294967296
    text = F.when(F.col("event_id") % 9 == 0, F.lit("&H&")).when(F.col("event_id") % 9 == 1, F.concat(F.lit(" &h"), F.lower(F.hex(v)))).otherwise(F.concat(F.lit("&H"), F.hex(v), F.lit("&")))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(labels.ass_color(text), ",").alias("rgba"))


_COLOR_TEXTS = ("#fff", "#12345", "Navy", " magenta ", "none", "#8090A0ff", "#8090a0 x", "")
_COLOR_VALUES = ("[255, 255, 255]", "NULL", "[0, 0, 128]", "[255, 0, 255]", "NULL", "[128, 144, 160]", "[128, 144, 160]", "NULL")


@_query("html_colors", "WITH v AS (SELECT event_id, event_id * 1677 % 16777216 AS v FROM events), w AS (SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_COLOR_VALUES)) + " ELSE [CAST(v >> 16 AS INT), CAST((v >> 8) & 255 AS INT), CAST(v & 255 AS INT)] END AS c FROM v) SELECT event_id, array_to_string(c, ',') AS rgb FROM w")
def _html_colors(spark, sf_dir):
    e = F.col("event_id")
    given = F.concat(F.lit("#"), F.lpad(F.hex(e * 1677 % 16777216), 6, "0"))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(labels.html_color(F.when(e % 9 == 8, given).otherwise(_pick(_COLOR_TEXTS, F.least(e % 9, F.lit(7))))), ",").alias("rgb"))


@_query("track_numbers", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN event_id END AS track FROM events")
def _track_numbers(spark, sf_dir):
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 4
    return _table(spark, sf_dir, "events").select("event_id", labels.track_number(F.when(k == 0, F.concat(e, F.lit("/12"))).when(k == 1, e).when(k == 2, F.concat(e, F.lit(" of 9"))).otherwise(F.concat(F.lit("x"), e))).alias("track"))


@_query("colour_boxes", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(event_id % 300 AS INT) END AS primaries, CASE WHEN event_id % 4 < 3 THEN CAST(event_id % 7 AS INT) END AS matrix, CASE event_id % 4 WHEN 0 THEN CAST(1 + event_id // 4 % 2 AS INT) WHEN 1 THEN 0 WHEN 2 THEN 0 END AS range FROM events")
def _colour_boxes(spark, sf_dir):
    e = F.col("event_id")
    two = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 4, "0"))
    kind = F.when(e % 4 < 2, F.lit(b"nclx")).when(e % 4 == 2, F.lit(b"nclc")).otherwise(F.lit(b"prof"))
    tail = F.when(e % 4 == 0, F.unhex(F.lpad(F.hex(F.floor(e / 4) % 2 * 128), 2, "0"))).when(e % 4 == 2, F.lit(b"\x80")).otherwise(F.lit(b""))
    box = labels.colour_box(F.concat(kind, two(e % 300), two(F.lit(1)), two(e % 7), tail))
    return _table(spark, sf_dir, "events").select("event_id", box.alias("b")).select("event_id", "b.primaries", "b.matrix", "b.range")


# Signals --------------------------------------------------------------------------------------

_INTS = "x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), y AS (SELECT vec_id, CAST(i AS INT) AS i, CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT) AS v FROM x)"


def _ints(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("x"))


@_query("fixed_residual", f"WITH {_INTS} SELECT vec_id, i, CASE WHEN i < 2 THEN v ELSE v - 2 * lag(v) OVER w + lag(v, 2) OVER w END AS residual FROM y WINDOW w AS (PARTITION BY vec_id ORDER BY i)")
def _fixed(spark, sf_dir):
    return _ints(spark, sf_dir).select("vec_id", F.posexplode(units.fixed_residual(F.col("x"), 2)).alias("i", "residual"))


@_query("planes", f"WITH {_INTS} SELECT vec_id, i, CASE WHEN i % 2 = 0 THEN v ELSE 0 END AS even, first_value(v) OVER (PARTITION BY vec_id ORDER BY i) AS head FROM y")
def _planes(spark, sf_dir):
    x = _ints(spark, sf_dir).select("vec_id", "x", units.deinterleave(F.col("x"), 2).alias("c"))
    muted = units.interleave(F.array(F.col("c")[0], F.transform(F.col("c")[1], lambda v: v * 0)))
    rows = x.select("vec_id", F.get("x", F.lit(0)).alias("head"), F.posexplode(muted).alias("i", "even"))
    return rows.select("vec_id", "i", "even", "head")


@_query("nv12_chroma", f"WITH {_INTS} SELECT vec_id, CAST(CASE WHEN i < 32 THEN 2 * i ELSE 2 * (i - 32) + 1 END AS INT) AS i, v FROM y")
def _nv12(spark, sf_dir):
    pairs = units.nv12_chroma(F.slice("x", 1, 32), F.slice("x", 33, 32))
    return _ints(spark, sf_dir).select("vec_id", F.posexplode(pairs).alias("i", "v"))


@_query("overlap_add", f"WITH {_INTS} SELECT vec_id % 20 AS stream, CAST(vec_id // 20 * 32 + i AS BIGINT) AS at, CAST(sum(v) AS BIGINT) AS value FROM y GROUP BY ALL")
def _overlap(spark, sf_dir):
    blocks = _ints(spark, sf_dir).select((F.col("vec_id") % 20).alias("stream"), F.floor(F.col("vec_id") / 20).alias("nth"), "x")
    return tracks.overlap_add(blocks, "stream", "nth", "x", 32)
