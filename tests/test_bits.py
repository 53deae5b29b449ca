"""Exponential Golomb codes at their edges."""

from pyspark.sql import functions as F

from lumenflow.functions import bits


def test_codes(spark):
    rows = [("1",), ("010011",), ("0" * 31 + "1" + "0" * 31,), ("0" * 31 + "1" * 32,), ("0" * 32 + "1" * 33,), ("0001",), ("",), (None,)]
    got = spark.createDataFrame(rows, "b string").select("b", bits.codes(F.col("b"), 2).alias("r")).collect()
    want = [([0, None], None), ([1, 2], 6), ([2**31 - 1, None], None), ([2**32 - 2, None], None), ([None, None], None), ([None, None], None), ([None, None], None), ([None, None], None)]
    assert [(r.r["values"], r.r.used) for r in got] == want


def test_writing(spark):
    rows = [(0,), (2,), (255,), (2**32 - 2,), (2**32 - 1,), (-1,), (None,)]
    got = spark.createDataFrame(rows, "v long").select(bits.code(F.col("v")).alias("c")).collect()
    assert [r.c for r in got] == ["1", "011", "0" * 8 + "1" + "0" * 8, "0" * 31 + "1" * 32, None, None, None]
    got = spark.createDataFrame([("101",), ("",), (None,)], "b string").select(bits.packed(F.col("b")).alias("p")).select("p", bits.bit_string(F.col("p")).alias("b")).collect()
    assert [(r.p and bytes(r.p), r.b) for r in got] == [(b"\xa0", "10100000"), (b"", ""), (None, None)]


def test_bits_of_long_runs(spark):
    """Across the parts of 7 bytes, all ones too, which a conversion of 8 bytes takes for an overflow; each part of a code is worked out once."""
    data = [b"\xff" * 20, b"\x00" * 15, bytes(range(250)), b"\x80" * 7, b"\x01" * 8]
    got = spark.createDataFrame([(d,) for d in data], "d binary").select("d", bits.bit_string(F.col("d")).alias("b")).select("d", "b", bits.packed(F.col("b")).alias("p"), bits.packed(F.substring("b", 1, 61)).alias("q")).collect()
    for r in got:
        text = "".join(f"{x:08b}" for x in r.d)
        assert r.b == text and r.p == r.d
        text = text[:61] + "0" * (-len(text[:61]) % 8)
        assert bytes(r.q) == int(text, 2).to_bytes(len(text) // 8, "big")
    plan = spark.range(1).select(bits.codes(F.lit("1").cast("string"), 2).alias("r"), bits.codes(F.col("id").cast("string"), 2).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("instr(") == 2
