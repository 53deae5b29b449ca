"""Queries over subtitles, headers, checksums, container files and streams; see :mod:`registry`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from lumenflow.functions import checksums, headers, timebase
from lumenflow.operators import clusters, signal, subtitles, timeline
from lumenflow.plans import tracks
from lumenflow.plans.registry import _PACKETS, _packets, _query, _table
from lumenflow.sources import containers
from lumenflow.streaming import packets as streams

# Subtitles ------------------------------------------------------------------------------------

_TURNS = "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL AND regexp_matches(text, '\\S')"
_CUES_SQL = f"SELECT conv_id, turn, CAST(turn * 2500 * 1000 AS BIGINT) AS start_us, CAST((turn * 2500 + 2000) * 1000 AS BIGINT) AS end_us, rtrim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM ({_TURNS})"


def _documents(spark, sf_dir, clock):
    """A conversation as one document; ``clock`` makes a turn a block of text."""
    start = F.col("turn") * 2_500_000
    turns = _table(spark, sf_dir, "conversations").filter(F.col("text").rlike(r"\S"))
    blocks = turns.select("conv_id", "turn", clock(F.col("turn"), start, start + 2_000_000, F.regexp_replace("text", r"\s+", " ")).alias("block"))
    return blocks.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "").alias("doc"))


def _cue_rows(docs, cues, body=lambda c: c):
    c = docs.select("conv_id", F.explode(cues(F.col("doc"))).alias("c"))
    return c.select("conv_id", F.col("c.name").cast("bigint").alias("turn"), "c.start_us", "c.end_us", body(F.col("c.body")).alias("body"))


@_query("srt_parse", _CUES_SQL)
def _srt(spark, sf_dir):
    return _cue_rows(_documents(spark, sf_dir, subtitles.srt_block), subtitles.srt_cues)


@_query("webvtt_parse", _CUES_SQL)
def _webvtt(spark, sf_dir):
    docs = _documents(spark, sf_dir, subtitles.srt_block).select("conv_id", F.concat(F.lit("WEBVTT kind\n\nNOTE no cue\n\n"), "doc").alias("doc"))
    return _cue_rows(docs, subtitles.webvtt_cues)


@_query("ass_parse", _CUES_SQL.replace("rtrim(regexp_replace(text, '\\s+', ' ', 'g'))", "regexp_replace(text, '\\s+', ' ', 'g')"))
def _ass(spark, sf_dir):
    clock = lambda us: F.regexp_replace(subtitles.srt_clock(us), ",", ".")
    row = lambda n, a, b, body: F.concat(F.lit("Dialogue: 0,"), clock(a), F.lit(","), clock(b), F.lit(",Default,"), n.cast("string"), F.lit(",0,0,0,,{\\i1}"), body, F.lit("\n"))
    docs = _documents(spark, sf_dir, row).select("conv_id", F.concat(F.lit("[Script Info]\nWrapStyle: 0\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"), "doc").alias("doc"))
    return _cue_rows(docs, subtitles.ass_cues, subtitles.ass_text)


@_query(
    "cues_visible",
    f"""WITH {_PACKETS}, c AS (SELECT user_id, event_id AS cue, pos AS start, pos + 90000 * (600 + event_id % 3600) AS stop FROM p WHERE event_type = 'purchase')
    SELECT p.event_id, c.cue FROM p JOIN c ON p.user_id = c.user_id AND p.pos >= c.start AND p.pos < c.stop""",
)
def _visible(spark, sf_dir):
    p = _packets(spark, sf_dir)
    c = p.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("cue"), F.col("pos").alias("start"), (F.col("pos") + 90_000 * (600 + F.col("event_id") % 3600)).alias("stop"))
    return timeline.visible(p, c, "user_id", "pos", "start", "stop", 90_000 * 2400).select("event_id", "cue")


# Headers and checksums ------------------------------------------------------------------------


@_query("adts_header", "SELECT event_id, CAST(([96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350])[event_id % 13 + 1] AS INT) AS rate, CAST(event_id % 8 AS BIGINT) AS channels, CAST(7 + event_id % 8000 AS BIGINT) AS frame_bytes FROM events")
def _adts(spark, sf_dir):
    e, size = F.col("event_id"), 7 + F.col("event_id") % 8000
    word = F.lit(0xFFF14000) + (e % 13) * 1024 + (e % 8) * 64 + F.floor(size / 2048)
    head = F.unhex(F.concat(F.lpad(F.hex(word.cast("bigint")), 8, "0"), F.lpad(F.hex(((size % 2048) * 8192 + 0x1FFC).cast("bigint")), 6, "0")))
    return _table(spark, sf_dir, "events").select("event_id", headers.adts(head).alias("h")).select("event_id", "h.rate", "h.channels", "h.frame_bytes")


_KBPS = headers.MPEG1_LAYER3[1:]


@_query("mp3_header", f"WITH e AS (SELECT event_id, ({_KBPS})[event_id % 14 + 1] AS kbps, ([44100, 48000, 32000])[event_id % 3 + 1] AS rate, event_id // 3 % 2 AS pad FROM events) SELECT event_id, CAST(kbps AS INT) AS kbps, CAST(rate AS INT) AS rate, CAST(144000 * kbps // rate + pad AS BIGINT) AS frame_bytes FROM e")
def _mp3(spark, sf_dir):
    e = F.col("event_id")
    word = F.lit(0xFFFB0000) + (e % 14 + 1) * 4096 + (e % 3) * 1024 + (F.floor(e / 3) % 2) * 512
    return _table(spark, sf_dir, "events").select("event_id", headers.mpeg_audio(F.unhex(F.hex(word.cast("bigint")))).alias("h")).select("event_id", "h.kbps", "h.rate", "h.frame_bytes")


def _checksums_sql() -> str:
    """Table-driven checksums folded over the bytes of a text."""
    lists = {"c8": checksums.table(0x07, 8), "c16": checksums.table(0x8005, 16), "ogg": checksums.table(0x04C11DB7, 32)}
    zlib = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        zlib.append(byte)
    tables = ", ".join(f"{v}::BIGINT[] AS {k}" for k, v in (lists | {"z": zlib}).items())
    fold = lambda start, step: f"list_reduce(list_prepend({start}::BIGINT, b), lambda v, x: {step})"
    return f"""WITH t AS MATERIALIZED (SELECT {tables}),
    d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
    e AS (SELECT doc_id, list_transform(range(1, CAST(length(h) // 2 + 1 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)) AS b FROM d)
    SELECT doc_id, xor({fold(4294967295, "xor(v >> 8, z[(xor(v, x) & 255) + 1])")}, 4294967295) AS crc32, {fold(0, "c8[xor(v, x) + 1]")} AS crc8, {fold(0, "xor((v << 8) & 65535, c16[xor(v >> 8, x) + 1])")} AS crc16,
    {fold(0, "xor((v << 8) & 4294967295, ogg[xor(v >> 24, x) + 1])")} AS ogg_crc32,
    CAST((1 + list_sum(b)) % 65521 + 65536 * ((len(b) + list_sum(list_transform(b, lambda x, i: x * (len(b) - i + 1)))) % 65521) AS BIGINT) AS adler32 FROM e, t"""


@_query("checksums", _checksums_sql())
def _checksums(spark, sf_dir):
    data = F.col("text").cast("binary")
    return _table(spark, sf_dir, "documents").select("doc_id", F.crc32(data).alias("crc32"), checksums.crc8(data).alias("crc8"), checksums.crc16(data).alias("crc16"), checksums.ogg_crc32(data).alias("ogg_crc32"), checksums.adler32(data).alias("adler32"))


# Containers, clusters, pictures ---------------------------------------------------------------


@_query("wav_round_trip", "WITH u AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, CAST(floor(greatest(-1, least(1, CAST(v AS DOUBLE))) * 32767 + 0.5) AS INT) AS sample FROM u")
def _wav(spark, sf_dir):
    files = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), containers.wav_writer(48000)(F.col("embedding")).alias("content"))
    found = containers.read_wav(files).select(F.col("path").cast("bigint").alias("vec_id"), F.posexplode("samples").alias("i", "v"))
    return found.select("vec_id", "i", (F.col("v") * 32768).cast("int").alias("sample"))


_WAV = list(containers.WAV_FORMATS)


@_query(
    "wav_formats",
    """WITH u AS (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings), v AS (SELECT vec_id, i, e, greatest(-1, least(1, CAST(e AS DOUBLE))) AS x FROM u)
    SELECT vec_id, CAST(i AS INT) AS i, round(CASE vec_id % 5 WHEN 0 THEN floor(x * 127 + 0.5) / 128 WHEN 1 THEN floor(x * 32767 + 0.5) / 32768 WHEN 2 THEN floor(x * 8388607 + 0.5) / 8388608 WHEN 3 THEN floor(x * 2147483647 + 0.5) / 2147483648 ELSE CAST(e AS DOUBLE) END, 8) + 0.0 AS value FROM v""",
)
def _wav_formats(spark, sf_dir):
    e, k = _table(spark, sf_dir, "embeddings"), F.col("vec_id") % len(_WAV)
    files = None
    for i, fmt in enumerate(_WAV):
        part = e.filter(k == i).select(F.col("vec_id").cast("string").alias("path"), containers.wav_writer(48000, 2, fmt)(F.col("embedding")).alias("content"))
        files = part if files is None else files.unionAll(part)
    found = containers.read_wav(files).select(F.col("path").cast("bigint").alias("vec_id"), F.posexplode("samples").alias("i", "v"))
    return found.select("vec_id", "i", (F.round("v", 8) + 0.0).alias("value"))


@_query(
    "mp4_sample_index",
    f"""WITH {tracks._S}, a AS (SELECT track, n, q, CAST(p % 50 + 1 AS BIGINT) AS d, CASE WHEN track % 3 = 0 THEN 0 ELSE p % 9 - 3 * (track % 2) END AS c FROM s)
    SELECT track, n - 1 AS sample, q AS size, d AS duration, CAST(coalesce(sum(d) {tracks._BEFORE}, 0) AS BIGINT) AS dts, CAST(coalesce(sum(d) {tracks._BEFORE}, 0) + c AS BIGINT) AS cts, CAST(coalesce(sum(q) {tracks._BEFORE}, 0) AS BIGINT) AS at, track % 5 = 0 OR n % 4 = 1 AS sync FROM a""",
)
def _mp4_index(spark, sf_dir):
    t, n, p = F.col("track"), F.col("n"), F.col("p")
    shift = F.when(t % 3 == 0, 0).otherwise(p % 9 - 3 * (t % 2))
    sample = F.struct("n", F.col("q").alias("size"), (p % 50 + 1).alias("duration"), shift.alias("shift"), ((t % 5 == 0) | (n % 4 == 1)).alias("sync"))
    files = tracks._samples(spark, sf_dir).groupBy("track").agg(F.sort_array(F.collect_list(sample)).alias("samples"))
    files = files.select(F.col("track").cast("string").alias("path"), containers.mp4_writer(F.col("samples")).alias("content"))
    rows = containers.scan(files, "mp4_samples")
    return rows.select(F.col("path").cast("bigint").alias("track"), "sample", "size", "duration", "dts", "cts", (F.col("at") - F.col("media")).alias("at"), "sync")


@_query("matroska_frames", f"WITH {tracks._S} SELECT track AS path, p % 3 + 1 AS track, n * 700 AS time, n % 4 = 1 AS key, q AS size FROM s")
def _matroska(spark, sf_dir):
    n, p = F.col("n"), F.col("p")
    frame = F.struct("n", (p % 3 + 1).alias("track"), (n * 700).alias("time"), (n % 4 == 1).alias("key"), F.repeat(F.lit("x"), F.col("q").cast("int")).cast("binary").alias("data"))
    files = tracks._samples(spark, sf_dir).groupBy("track").agg(F.sort_array(F.collect_list(frame)).alias("frames"))
    files = files.select(F.col("track").cast("string").alias("path"), containers.matroska_writer(F.col("frames")).alias("content"))
    return containers.scan(files, "matroska_frames").select(F.col("path").cast("bigint").alias("path"), "track", "time", "key", "size")


@_query("ogg_packets", "WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS packet FROM conversations WHERE text IS NOT NULL) SELECT conv_id, CAST(packet AS BIGINT) AS packet, CAST(strlen(text) * 7 AS BIGINT) AS size FROM t")
def _ogg(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    packets = F.transform("t", lambda x: F.repeat(x["text"], 7).cast("binary"))
    files = turns.select(F.col("conv_id").cast("string").alias("path"), containers.ogg_writer(packets).alias("content"))
    return containers.scan(files, "ogg_packets").select(F.col("path").cast("bigint").alias("conv_id"), "packet", "size")


@_query(
    "cluster_assign",
    f"""WITH RECURSIVE {_PACKETS}, e AS (SELECT event_id, user_id, pos // 90000 AS ms, k IS NOT NULL AS key, row_number() OVER (PARTITION BY user_id ORDER BY pos // 90000, event_id) AS n FROM p),
    c AS (SELECT event_id, user_id, n, ms AS began, 1500000 AS held, 0 AS cluster FROM e WHERE n = 1
    UNION ALL SELECT event_id, user_id, n, CASE WHEN cut THEN ms ELSE began END, CASE WHEN cut THEN 0 ELSE held END + 1500000, cluster + CAST(cut AS INT) FROM (
    SELECT e.event_id, e.user_id, e.n, e.ms, c.began, c.held, c.cluster, e.key OR c.held >= 4194304 OR abs(e.ms - c.began) >= 30000 AS cut FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1))
    SELECT event_id, user_id, CAST(cluster AS BIGINT) AS cluster FROM c""",
)
def _clusters(spark, sf_dir):
    p = _packets(spark, sf_dir).select("event_id", "user_id", F.floor(F.col("pos") / 90_000).cast("bigint").alias("ms"), F.lit(1_500_000).cast("bigint").alias("bytes"), (F.col("event_type") == "purchase").alias("key"))
    return clusters.assign_clusters(p, "user_id", ["ms", "event_id"], "ms", "bytes", "key").select("event_id", "user_id", "cluster")


@_query("display_reorder", "WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n // 16, n + 1 - 2 * (n % 2)) - 1 AS BIGINT) AS shown FROM e")
def _reorder(spark, sf_dir):
    n = F.row_number().over(timeline.Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", n.alias("n"))
    e = e.select("event_id", "user_id", (F.col("n") % 16 + 1 - 2 * (F.col("n") % 2)).alias("poc"), (F.col("n") % 16 == 0).alias("idr"))
    return clusters.reorder(e, "user_id", "event_id", "poc", "idr", 2).select("event_id", "user_id", "shown")


def _remap_sql() -> str:
    (yb, yr), (ub, ur), (vb, vr) = signal.REMAP["bt601", "bt709"]
    part = lambda b, r: f"CAST(floor(({b} * d + {r} * e + 128) / 256.0) AS INT)"
    code = lambda x: f"greatest(0, least(255, {x}))"
    return f"WITH c AS (SELECT p_partkey, CAST(p_partkey % 256 AS INT) AS y, CAST(p_partkey * 7 % 256 - 128 AS INT) AS d, CAST(p_size * 5 % 256 - 128 AS INT) AS e FROM part) SELECT p_partkey, {code('y + ' + part(yb, yr))} AS y, {code('128 + ' + part(ub, ur))} AS u, {code('128 + ' + part(vb, vr))} AS v FROM c"


@_query("remap_601_709", _remap_sql())
def _remap(spark, sf_dir):
    code = lambda c: F.pmod(c, F.lit(256)).cast("int")
    y, u, v = signal.remap(code(F.col("p_partkey")), code(F.col("p_partkey") * 7), code(F.col("p_size") * 5), "bt601", "bt709")
    return _table(spark, sf_dir, "part").select("p_partkey", y.alias("y"), u.alias("u"), v.alias("v"))


@_query("dct4", "WITH u AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), k AS (SELECT unnest(range(64)) AS bin) SELECT vec_id, CAST(bin AS INT) AS bin, round(sum(v * cos(pi() / 64 * (i + 0.5) * (bin + 0.5))), 5) AS coefficient FROM u, k GROUP BY vec_id, bin")
def _dct4(spark, sf_dir):
    c = signal.linear(F.col("embedding"), signal.dct4_rows(64))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(c, lambda x: F.round(x, 5))).alias("bin", "coefficient"))


# Streams --------------------------------------------------------------------------------------


def _shared(spark, tag: str) -> str:
    """A fresh path in the cluster's shared folder; a temporary one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='lumenflow-')}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@_query("stream_window_counts", "SELECT CAST(epoch_us(date_trunc('hour', ts)) // 3600000000 AS BIGINT) AS hour, event_type, count(*) AS packets FROM events GROUP BY ALL")
def _stream(spark, sf_dir):
    schema = _table(spark, sf_dir, "events").schema
    hour = timebase.micros("ts")
    e = streams.packet_source(spark, sf_dir, schema, "events.parquet").select("event_type", F.timestamp_micros(hour).alias("at"))
    out = streams.window_counts(e, "at", ["event_type"], "1 hour", "1 day")
    done = streams.drain(out, _shared(spark, "windows"), _shared(spark, "windows-log"), "update", ["start", "event_type"])
    return done.select(F.floor(F.unix_micros("start") / 3_600_000_000).alias("hour"), "event_type", "packets")
