"""Every registered query by name, and its SQL.

The supplied tables hold no media, so queries read them as timelines: ``events`` is a packet stream
(user = stream, event type ``purchase`` = keyframe), ``orders`` and ``lineitem`` are chunks and
samples, ``part`` gives picture sizes and codes, ``embeddings`` are signals of 64 samples.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.functions import cues, media, timebase
from lumenflow.operators import signal, timeline

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Time bases -----------------------------------------------------------------------------------

_OFFSET = 1_705_000_000_000_000  # so that ticks of both signs occur


def _rescale(rounding: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ticks = timebase.micros("ts") - F.lit(_OFFSET)
        return _table(spark, sf_dir, "events").select("event_id", ticks.alias("us")).select("event_id", timebase.rescale(F.col("us"), (1, 1_000_000), (1001, 24000), rounding).alias("frames"), timebase.rescale(F.col("us"), (1, 1_000_000), (1, 90_000), rounding).alias("ticks"))

    return run


def _rescale_sql(rounding: str) -> str:
    def div(a: str, d: int) -> str:
        q, r = f"(({a}) // {d})", f"(({a}) % {d})"
        fix = {"zero": "0", "down": f"CASE WHEN {r} < 0 THEN -1 ELSE 0 END", "up": f"CASE WHEN {r} > 0 THEN 1 ELSE 0 END", "nearest": f"CASE WHEN abs({r}) * 2 >= {d} THEN sign({r}) ELSE 0 END"}[rounding]
        return f"CAST({q} + {fix} AS BIGINT)"

    return f"WITH e AS (SELECT event_id, CAST(epoch_us(ts) - {_OFFSET} AS HUGEINT) AS us FROM events) SELECT event_id, {div('us * 3', 125125)} AS frames, {div('us * 9', 100)} AS ticks FROM e"


for _r in timebase.ROUNDINGS:
    _query(f"rescale_{_r}", _rescale_sql(_r))(_rescale(_r))


# Seeks ----------------------------------------------------------------------------------------


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", timebase.rescale(timebase.micros("ts"), (1, 1_000_000), (1, 90_000), "down").alias("pos"))


_PACKETS = "p AS (SELECT event_id, user_id, event_type, CAST(epoch_us(ts) * 9 // 100 AS BIGINT) AS pos, CASE WHEN event_type = 'purchase' THEN CAST(epoch_us(ts) * 9 // 100 AS BIGINT) END AS k FROM events)"


def _sync():
    return F.col("event_type") == "purchase"


_UPTO = "OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FROM = "OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN {} AND UNBOUNDED FOLLOWING)"


@_query("seek_before_raw", f"WITH {_PACKETS} SELECT event_id, user_id, pos, max(k) {_UPTO} AS seek FROM p")
def _seek_before_raw(spark, sf_dir):
    return timeline.seek_before(_packets(spark, sf_dir), "user_id", "pos", _sync()).select("event_id", "user_id", "pos", "seek")


@_query("seek_before_clamped", f"WITH {_PACKETS} SELECT event_id, pos, coalesce(max(k) {_UPTO}, min(k) OVER (PARTITION BY user_id)) AS seek FROM p")
def _seek_before_clamped(spark, sf_dir):
    return timeline.seek_before(_packets(spark, sf_dir), "user_id", "pos", _sync(), clamp=True).select("event_id", "pos", "seek")


@_query("seek_after_indexed", f"WITH {_PACKETS} SELECT event_id, pos, coalesce(min(k) {_FROM.format('CURRENT ROW')}, max(k) OVER (PARTITION BY user_id)) AS seek FROM p")
def _seek_after_indexed(spark, sf_dir):
    return timeline.seek_after(_packets(spark, sf_dir), "user_id", "pos", _sync(), clamp=True).select("event_id", "pos", "seek")


@_query("seek_after_strict", f"WITH {_PACKETS} SELECT event_id, pos, min(k) {_FROM.format('1 FOLLOWING')} AS seek FROM p")
def _seek_after_strict(spark, sf_dir):
    return timeline.seek_after(_packets(spark, sf_dir), "user_id", "pos", _sync(), strict=True).select("event_id", "pos", "seek")


@_query("default_stream", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, event_id) AS n FROM events) WHERE n = 1")
def _default_stream(spark, sf_dir):
    return timeline.default_stream(_table(spark, sf_dir, "events"), ["user_id"], _sync(), "event_id").select("user_id", "event_id", "event_type")


@_query("packet_durations", f"WITH {_PACKETS}, d AS (SELECT event_id, pos, lead(pos) OVER w - pos AS a, pos - lag(pos) OVER w AS b FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)) SELECT event_id, greatest(coalesce(a, b, 0), 0) AS duration FROM d")
def _packet_durations(spark, sf_dir):
    return timeline.durations(_packets(spark, sf_dir), "user_id", "pos").select("event_id", "duration")


# Sample tables --------------------------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("size"))


_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT)"


@_query("sample_offsets", f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS size, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM lineitem")
def _sample_offsets(spark, sf_dir):
    return timeline.decode_times(_samples(spark, sf_dir), "l_orderkey", ["l_linenumber", "l_partkey", "size"], "size", "off")


@_query(
    "rle_encode",
    """WITH e AS (SELECT user_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run""",
)
def _rle_encode(spark, sf_dir):
    return timeline.run_lengths(_table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type")


@_query("rle_expand", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sample, event_type FROM events")
def _rle_expand(spark, sf_dir):
    return timeline.expand_runs(_rle_encode(spark, sf_dir), "user_id", "run", "n", "event_type")


@_query(
    "frame_rate_rational",
    """WITH s AS (SELECT l_orderkey, CAST(count(*) * 90000 AS BIGINT) AS a, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS b FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, a // gcd(a, b) AS num, b // gcd(a, b) AS den FROM s""",
)
def _frame_rate(spark, sf_dir):
    s = _samples(spark, sf_dir).groupBy("l_orderkey").agg((F.count("*") * 90_000).alias("a"), F.sum("size").alias("b"))
    num, den = timeline.reduced_ratio(F.col("a"), F.col("b"))
    return s.select("l_orderkey", num.alias("num"), den.alias("den"))


@_query(
    "track_span",
    f"""WITH {_PACKETS}, d AS (SELECT user_id, pos, k, greatest(coalesce(lead(pos) OVER w - pos, pos - lag(pos) OVER w, 0), 0) AS duration FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos))
    SELECT user_id, CAST(max(pos) + arg_max(duration, pos) - min(pos) AS BIGINT) AS span, count(*) AS packets, count(k) AS syncs FROM d GROUP BY user_id""",
)
def _track_span(spark, sf_dir):
    p = timeline.durations(_packets(spark, sf_dir), "user_id", "pos")
    return p.groupBy("user_id").agg((F.max("pos") + F.max_by("duration", "pos") - F.min("pos")).alias("span"), F.count("*").alias("packets"), F.count_if(_sync()).alias("syncs"))


@_query(
    "seek_sample",
    f"""WITH {_PACKETS}, a AS (SELECT event_id, user_id, pos, max(k) {_UPTO} AS back, max(struct_pack(pos := pos, id := event_id, sync := event_type = 'purchase')) {_UPTO} AS h, min(k) {_FROM.format('1 FOLLOWING')} AS forth, min(pos) OVER (PARTITION BY user_id) AS low, max(pos) OVER (PARTITION BY user_id) AS high FROM p)
    SELECT event_id, coalesce(back, low) AS before, CASE WHEN h.sync THEN h.pos ELSE coalesce(forth, high) END AS after FROM a""",
)
def _seek_sample(spark, sf_dir):
    return timeline.seek_sample(_packets(spark, sf_dir), "user_id", "pos", "event_id", _sync()).select("event_id", "before", "after")


# Pictures, colour, packets --------------------------------------------------------------------

_FORMATS = list(media.PIXEL_FORMATS)
_GEOMETRY = " ".join(f"WHEN {i} THEN (w * h * {pk} + {'2 *' if pl > 1 else '0 *'} ((w + {(1 << sx) - 1}) // {1 << sx}) * ((h + {(1 << sy) - 1}) // {1 << sy})) * {sz}" for i, (pl, sx, sy, sz, pk) in enumerate(media.PIXEL_FORMATS.values()))


@_query("plane_geometry", f"WITH p AS (SELECT p_partkey, p_size * 37 + 1 AS w, p_size * 21 + 1 AS h, p_partkey % {len(_FORMATS)} AS f FROM part) SELECT p_partkey, CAST(CASE f {_GEOMETRY} END AS BIGINT) AS frame_bytes FROM p")
def _plane_geometry(spark, sf_dir):
    fmt = F.element_at(F.array(*map(F.lit, _FORMATS)), (F.col("p_partkey") % len(_FORMATS) + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", media.frame_bytes(fmt, F.col("p_size") * 37 + 1, F.col("p_size") * 21 + 1).alias("frame_bytes"))


@_query("color_resolve", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 <> 2 THEN p_partkey % 4 WHEN p_partkey % 7 <> 2 THEN p_partkey % 7 WHEN p_size * 30 >= 720 THEN 1 ELSE 6 END AS BIGINT) AS matrix FROM part")
def _color_resolve(spark, sf_dir):
    c, b, h = F.col("p_partkey") % 4, F.col("p_partkey") % 7, F.col("p_size") * 30
    return _table(spark, sf_dir, "part").select("p_partkey", media.matrix_of(c, b, h).cast("bigint").alias("matrix"))


_OPUS_SQL = """WITH e AS (SELECT event_id, event_id % 256 AS toc, event_id // 256 % 64 AS n FROM events),
    u AS (SELECT *, toc // 8 AS c, CASE WHEN toc % 4 = 0 THEN 1 WHEN toc % 4 < 3 THEN 2 ELSE n END AS frames FROM e),
    v AS (SELECT *, CASE WHEN c < 12 THEN ([10000, 20000, 40000, 60000])[c % 4 + 1] WHEN c < 16 THEN CASE WHEN c % 2 = 0 THEN 10000 ELSE 20000 END ELSE ([2500, 5000, 10000, 20000])[c % 4 + 1] END AS us FROM u),
    s AS (SELECT *, CAST(frames * us * 48 // 1000 AS BIGINT) AS k FROM v)
    SELECT event_id, CAST(us AS BIGINT) AS frame_us, CASE WHEN k BETWEEN 1 AND 5760 THEN k END AS samples FROM s"""


@_query("opus_toc_duration", _OPUS_SQL)
def _opus(spark, sf_dir):
    toc, n = (F.col("event_id") % 256).cast("int"), (F.floor(F.col("event_id") / 256) % 64).cast("int")
    return _table(spark, sf_dir, "events").select("event_id", media.opus_frame_us(toc).cast("bigint").alias("frame_us"), media.opus_samples(toc, n).alias("samples"))


@_query("mp4_language", "WITH c AS (SELECT event_id, event_id * 37 % 32768 AS v FROM events), l AS (SELECT event_id, chr(CAST(v // 1024 + 96 AS INT)) || chr(CAST(v // 32 % 32 + 96 AS INT)) || chr(CAST(v % 32 + 96 AS INT)) AS s FROM c) SELECT event_id, CASE WHEN regexp_full_match(s, '[a-z]{3}') AND s <> 'und' THEN s END AS language FROM l")
def _mp4_language(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", media.mp4_language((F.col("event_id") * 37 % 32768).cast("int")).alias("language"))


@_query("depth_convert", "SELECT p_partkey, p_size * 257 AS wide, (p_size * 1000 + 128) // 257 AS narrow FROM part")
def _depth(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", media.widen_8_to_16(F.col("p_size")).alias("wide"), media.narrow_16_to_8(F.col("p_size") * 1000).alias("narrow"))


@_query("pcm_to_float", "SELECT p_partkey, round((p_partkey % 65536 - 32768) / 32768.0, 9) AS s16, round((p_size - 128) / 128.0, 9) AS u8 FROM part")
def _pcm(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(media.pcm_to_float(F.col("p_partkey") % 65536 - 32768, 16), 9).alias("s16"), F.round(media.pcm_to_float(F.col("p_size"), 8, unsigned=True), 9).alias("u8"))


@_query("checksum_md5", "SELECT doc_id, md5(text) AS md5, length(text) AS chars FROM documents")
def _md5(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.length("text").cast("bigint").alias("chars"))


#: Heads of files, and what they are.
_HEADS = (
    (b"RIFF....WAVEfmt ", "wav"),
    (b"fLaC....", "flac"),
    (b"OggS....", "ogg"),
    (b"....ftypisom", "mp4"),
    (b"nothing.", None),
    (b"ID3\x04\0\0\0\0\0\x04....fLaC....", "flac"),
    (b"ID3\x04\0\0\0\0\0\x02.." + 3 * (bytes.fromhex("fff15080014000") + bytes(3)), "adts"),
    (b"x" + 3 * (bytes.fromhex("fffb1000") + bytes(100)), "mp3"),
    (bytes.fromhex("fffb1000") + bytes(300), None),
    (bytes.fromhex("1a45dfa3") + b"....", "matroska"),
)


@_query("sniff_magic", f"SELECT event_id, CASE event_id % {len(_HEADS)} " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(_HEADS) if kind) + " END AS container FROM events")
def _sniff(spark, sf_dir):
    head = F.element_at(F.array(*(F.lit(h) for h, _ in _HEADS)), (F.col("event_id") % len(_HEADS) + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", media.sniff(head).alias("container"))


# Cues -----------------------------------------------------------------------------------------


@_query("cue_clock", "SELECT event_id, CAST(epoch_us(ts) % 360000000000 // 1000 * 1000 AS BIGINT) AS start_us FROM events")
def _cue_clock(spark, sf_dir):
    us = timebase.micros("ts") % 360_000_000_000
    return _table(spark, sf_dir, "events").select("event_id", cues.clock_us(cues.srt_clock(us)).alias("start_us"))


@_query("cue_plain_text", "SELECT conv_id, turn, text FROM conversations")
def _cue_plain(spark, sf_dir):
    marked = F.concat(F.lit("<i>{\\an8}"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</i>"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", cues.plain_text(marked).alias("text"))


# Signals --------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(nxt, "vec_id")


_PAIR_SQL = "p AS (SELECT a.vec_id, list_transform(a.embedding, lambda v: CAST(v AS DOUBLE)) AS x, list_transform(b.embedding, lambda v: CAST(v AS DOUBLE)) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@_query(
    "signal_metrics",
    f"""WITH {_PAIR_SQL}, u AS (SELECT vec_id, unnest(x) AS x, unnest(y) AS y FROM p)
    SELECT vec_id, round(corr(x, y), 6) AS corr, round(sqrt(avg((x - y) * (x - y))), 6) AS rms, round(max(abs(x - y)), 6) AS peak, round(20 * log10(1 / sqrt(avg((x - y) * (x - y)))), 6) AS psnr FROM u GROUP BY vec_id""",
)
def _metrics(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return _pairs(spark, sf_dir).select("vec_id", F.round(signal.correlation(x, y), 6).alias("corr"), F.round(signal.rms_delta(x, y), 6).alias("rms"), F.round(signal.peak_delta(x, y), 6).alias("peak"), F.round(signal.psnr(x, y, 1.0), 6).alias("psnr"))


def _long(column: str, n: int, name: str) -> list:
    return ["vec_id", F.posexplode(column).alias(name, "v")]


@_query("dft_power", "WITH u AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), k AS (SELECT unnest(range(33)) AS bin), s AS (SELECT vec_id, bin, sum(v * cos(2 * pi() * bin * i / 64)) AS a, sum(v * sin(2 * pi() * bin * i / 64)) AS b FROM u, k GROUP BY vec_id, bin) SELECT vec_id, CAST(bin AS INT) AS bin, round(a * a + b * b, 4) AS power FROM s")
def _dft(spark, sf_dir):
    re, im = signal.dft_rows(64)
    e = _table(spark, sf_dir, "embeddings").select("vec_id", signal.linear(F.col("embedding"), re).alias("a"), signal.linear(F.col("embedding"), im).alias("b"))
    return e.select(*_long(F.zip_with("a", "b", lambda a, b: F.round(a * a + b * b, 4)), 33, "bin")).withColumnRenamed("v", "power")


@_query("dct2", "WITH u AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), k AS (SELECT unnest(range(64)) AS bin) SELECT vec_id, CAST(bin AS INT) AS bin, round(sum(v * cos(pi() / 64 * (i + 0.5) * bin)), 5) AS coefficient FROM u, k GROUP BY vec_id, bin")
def _dct(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", signal.linear(F.col("embedding"), signal.dct2_rows(64)).alias("c"))
    return e.select(*_long(F.transform("c", lambda x: F.round(x, 5)), 64, "bin")).withColumnRenamed("v", "coefficient")


@_query("window_vorbis", f"WITH u AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, round(CAST(v AS DOUBLE) * sin({math.pi / 2} * pow(sin({math.pi / 64} * (i + 0.5)), 2)), 6) + 0.0 AS value FROM u")
def _window(spark, sf_dir):
    w = F.array(*map(F.lit, signal.vorbis_window(64)))
    return _table(spark, sf_dir, "embeddings").select(*_long(F.zip_with("embedding", w, lambda a, b: F.round(a.cast("double") * b, 6)), 64, "i")).withColumnRenamed("v", "value")


@_query("mdct", f"WITH u AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), k AS (SELECT unnest(range(32)) AS bin) SELECT vec_id, CAST(bin AS INT) AS bin, round(sum(v * sin({math.pi / 64} * (i + 0.5)) * cos(pi() / 32 * (i + 16.5) * (bin + 0.5))), 5) AS coefficient FROM u, k GROUP BY vec_id, bin")
def _mdct(spark, sf_dir):
    w = F.array(*map(F.lit, signal.sine_window(64)))
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.zip_with("embedding", w, lambda a, b: a.cast("double") * b).alias("x"))
    e = e.select("vec_id", signal.linear(F.col("x"), signal.mdct_rows(32)).alias("c"))
    return e.select(*_long(F.transform("c", lambda x: F.round(x, 5)), 32, "bin")).withColumnRenamed("v", "coefficient")
