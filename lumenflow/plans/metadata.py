"""Queries over file tags and bit codes: rows are rendered as bytes and read back; see :mod:`registry`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenflow.functions import bits, tags
from lumenflow.plans.registry import _query, _table


def _bytes(number: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * n, "0"))


def _seven_bits(number: Column) -> Column:
    parts = [F.shiftleft(F.shiftright(number, 7 * i).bitwiseAND(127).cast("bigint"), 8 * i) for i in range(4)]
    return _bytes(parts[0] + parts[1] + parts[2] + parts[3], 4)


def _text(value: Column, kind: Column) -> Column:
    """A text frame's body in encoding 0 to 3, or 4 for UTF-16 with a mark of the other order."""
    value = F.concat(F.lit(" "), value, F.lit(" "))
    return (
        F.when(kind == 0, F.concat(F.lit(b"\0"), F.encode(value, "ISO-8859-1"), F.lit(b"\0")))
        .when(kind == 1, F.concat(F.lit(b"\1\xff\xfe"), F.encode(value, "UTF-16LE"), F.lit(b"\0\0")))
        .when(kind == 2, F.concat(F.lit(b"\2"), F.encode(value, "UTF-16BE")))
        .when(kind == 3, F.concat(F.lit(b"\3"), F.encode(value, "UTF-8")))
        .otherwise(F.concat(F.lit(b"\1\xfe\xff"), F.encode(value, "UTF-16BE")))
    )


def _frame(version: Column, short: str, long: str, body: Column) -> Column:
    size = F.length(body).cast("bigint")
    old = F.concat(F.lit(short.encode()), _bytes(size, 3), body)
    new = lambda s: F.concat(F.lit(long.encode()), s, F.lit(b"\0\0"), body)
    return F.when(version == 2, old).when(version == 3, new(_bytes(size, 4))).otherwise(new(_seven_bits(size)))


def _padded(value: Column, n: int) -> Column:
    cut = F.substring(F.encode(value, "ISO-8859-1"), 1, n)
    return F.concat(cut, F.substring(F.lit(bytes(n)), 1, F.lit(n) - F.length(cut)))


# The head states no album; a repeated title and an empty date are passed over; every 11th head is
# unsynchronised and every 13th file has no tail.
@_query(
    "id3_tags",
    """WITH p AS (SELECT *, p_partkey % 11 <> 0 AS head, p_partkey % 13 <> 0 AS tail FROM part)
    SELECT p_partkey, CASE WHEN head THEN p_name WHEN tail THEN trim(substr('v1 ' || p_name, 1, 30)) END AS title,
           CASE WHEN head THEN p_type WHEN tail THEN trim(substr(p_brand, 1, 30)) END AS artist, CASE WHEN tail THEN trim(substr(p_brand, 1, 30)) END AS album,
           CASE WHEN tail THEN CAST(1900 + p_size AS VARCHAR) END AS date,
           CASE WHEN head AND p_size % 4 <> 0 THEN p_size WHEN tail AND p_size % 3 <> 0 THEN p_size END::BIGINT AS track FROM p""",
)
def _id3(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").withColumn("version", F.col("p_partkey") % 3 + 2).withColumn("kind", F.col("p_partkey") % 5)
    version, kind, size = F.col("version"), F.col("kind"), F.col("p_size")
    number = F.when(size % 4 != 0, F.concat(size.cast("string"), F.lit("/99"))).otherwise("none")
    fields = (("TT2", "TIT2", F.col("p_name")), ("TP1", "TPE1", F.col("p_type")), ("TT2", "TIT2", F.lit("again")), ("TYE", "TYER", F.lit("")), ("TRK", "TRCK", number), ("COM", "COMM", F.lit("TALB")))
    frames = F.concat(*(_frame(version, short, long, _text(value, kind)) for short, long, value in fields), F.lit(bytes(12)))
    flags = F.when(F.col("p_partkey") % 11 == 0, F.lit(b"\x80")).otherwise(F.lit(b"\0"))
    head = F.concat(F.lit(b"ID3"), _bytes(version, 1), F.lit(b"\0"), flags, _seven_bits(F.length(frames).cast("bigint")), frames)
    track = F.when(size % 3 != 0, F.concat(F.lit(b"\0"), _bytes(size, 1))).otherwise(F.lit(b"\0\0"))
    old = F.concat(F.lit(b"TAG"), _padded(F.concat(F.lit("v1 "), "p_name"), 30), _padded(F.col("p_brand"), 30), _padded(F.col("p_brand"), 30), (1900 + size).cast("string").cast("binary"), F.lit(bytes(28)), track, F.lit(b"\x0c"))
    tail = F.when(F.col("p_partkey") % 13 != 0, old).otherwise(F.lit(b"no tag"))
    return parts.select("p_partkey", F.concat(head, F.lit(b"\xff\xfb\x90\0" * 40), tail).alias("file")).select("p_partkey", tags.file_tags(F.col("file")).alias("t")).select("p_partkey", "t.*")


# Names are in any case; every 7th block ends within its date, which is the last but one.
@_query(
    "vorbis_tags",
    """SELECT p_partkey, p_name AS title, p_brand || '=' || p_type AS artist, CAST(NULL AS VARCHAR) AS album, CASE WHEN p_partkey % 7 <> 0 THEN '1999-01-02' END AS date,
              CASE WHEN p_partkey % 7 <> 0 THEN p_size END::BIGINT AS track FROM part""",
)
def _vorbis(spark, sf_dir):
    little = lambda n: F.reverse(F.array(*(_bytes(F.shiftright(n, 8 * (3 - i)).bitwiseAND(255), 1) for i in range(4))))
    counted = lambda s: F.concat(F.array_join(F.transform(little(F.length(s)), lambda b: F.decode(b, "ISO-8859-1")), "").cast("string"), F.decode(s, "ISO-8859-1"))
    entries = [F.encode(F.lit("maker"), "UTF-8"), *(F.encode(F.concat(F.lit(k), v), "UTF-8") for k, v in (("Title=", F.col("p_name")), ("no equals", F.lit("")), ("ARTIST=", F.concat("p_brand", F.lit("="), "p_type")), ("title=", F.lit("again")), ("album=", F.lit("")), ("date=", F.lit("1999-01-02")), ("TrackNumber=", F.concat(F.col("p_size").cast("string"), F.lit(" of 9")))))]
    texts = [counted(e) for e in entries]
    block = F.encode(F.concat(texts[0], F.lit("\x07\0\0\0"), *texts[1:]), "ISO-8859-1")
    short = F.length(block) - F.length(F.encode(texts[-1], "ISO-8859-1")) - 3
    cut = F.when(F.col("p_partkey") % 7 == 0, F.substring(block, F.lit(1), short)).otherwise(block)
    return _table(spark, sf_dir, "part").select("p_partkey", tags.vorbis(cut).alias("t")).select("p_partkey", "t.*")


@_query(
    "exp_golomb",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_suppkey * 1000003 % 4294967295 AS b, CASE WHEN l_partkey % 2 = 0 THEN -l_suppkey ELSE l_suppkey END AS c FROM lineitem),
    n AS (SELECT *, 2 * length(bin(a + 1)) + 2 * length(bin(b + 1)) + 2 * length(bin(CASE WHEN c > 0 THEN 2 * c ELSE 1 - 2 * c END)) - 3 AS used FROM v)
    SELECT l_orderkey, l_linenumber, a, b, c, used, (used + 7) // 8 AS bytes FROM n""",
)
def _codes(spark, sf_dir):
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    written = bits.packed(F.concat(bits.code(part), bits.code(supplier * 1000003 % 4294967295), bits.signed_code(F.when(part % 2 == 0, -supplier).otherwise(supplier))))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", written.alias("data"))
    read = lines.select("l_orderkey", "l_linenumber", F.length("data").cast("bigint").alias("bytes"), bits.codes(bits.bit_string(F.col("data")), 3).alias("r"))
    value = lambda i: F.get("r.values", F.lit(i))
    return read.select("l_orderkey", "l_linenumber", value(0).alias("a"), value(1).alias("b"), bits.signed(value(2)).alias("c"), F.col("r.used").cast("bigint").alias("used"), "bytes")
