"""Fields of binary columns as Column expressions; null where the bytes end before the field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big(data: Column, at: int, n: int) -> Column:
    """The unsigned big-endian number of ``n`` (at most 7) bytes at offset ``at``."""
    return F.when(F.length(data) >= at + n, F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("bigint"))


def little(data: Column, at: int, n: int) -> Column:
    """The unsigned little-endian number of ``n`` (at most 7) bytes at offset ``at``."""
    out = big(data, at, 1)
    for i in range(1, n):
        out = out + big(data, at + i, 1) * F.lit(1 << 8 * i)
    return out


def field(word: Column, shift: int, bits: int) -> Column:
    """``bits`` bits of a number, from bit ``shift`` up."""
    return F.shiftright(word, shift).bitwiseAND(F.lit((1 << bits) - 1))


def pick(index: Column, values: list) -> Column:
    """The value at a number from 0; null beyond the list."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Bytes that one conversion of base takes; the largest number of 8 is its mark of an overflow.
_BYTES = 7


def bit_string(data: Column) -> Column:
    """The bits of some bytes as zeros and ones."""
    bits = lambda h: F.lpad(F.conv(h, 16, 2), 4 * F.length(h), F.lit("0"))
    part = lambda h, i: _once(F.substring(h, i, F.lit(2 * _BYTES)), bits)
    joined = lambda h: F.when(F.length(h) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2 * _BYTES)), lambda i: part(h, i)), "")).otherwise(h)
    return _once(F.hex(data), joined)


def packed(bits: Column) -> Column:
    """Zeros and ones as bytes, the last filled up with zeros."""
    digits = lambda s: F.lpad(F.conv(s, 2, 16), F.shiftright(F.length(s), 2), F.lit("0"))
    part = lambda s, i: _once(F.substring(s, i, F.lit(8 * _BYTES)), digits)
    filled = lambda s: F.rpad(s, F.shiftright(F.length(s) + 7, 3) * 8, F.lit("0"))
    joined = lambda s: F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s), F.lit(8 * _BYTES)), lambda i: part(s, i)), "")).otherwise(s)
    return F.unhex(_once(_once(bits, filled), joined))


def code(value: Column) -> Column:
    """The exponential Golomb code of a number below 2**32 - 1 as zeros and ones; null for others."""
    digits = F.bin(value + 1)
    return F.when(value.between(0, (1 << 32) - 2), F.concat(F.repeat(F.lit("0"), F.length(digits) - 1), digits))


def signed_code(value: Column) -> Column:
    """The code of a signed number: positive ones are odd."""
    value = value.cast("bigint")
    return code(F.when(value > 0, 2 * value - 1).otherwise(-2 * value))


def codes(bits: Column, n: int) -> Column:
    """``values``, the first ``n`` code numbers, and ``used``, the bits they take. From the first that is cut short or has 32 zeros on, values and ``used`` are null."""

    def read(state: Column, rest: Column, zeros: Column) -> Column:
        value = lambda whole: F.when(whole, F.conv(F.substring(rest, zeros + 1, zeros + 1), 2, 10).cast("bigint") - 1)
        ends = zeros.between(0, 31) & (F.length(rest) >= 2 * zeros + 1)
        return _once(ends, lambda whole: F.struct(F.concat(state["values"], F.array(value(whole))).alias("values"), F.when(whole, state["used"] + 2 * zeros + 1).otherwise(-1).alias("used")))

    def step(given: Column, state: Column) -> Column:
        rest = F.when(state["used"] >= 0, F.substring(given, state["used"] + 1, F.lit(64))).otherwise("")  # "" has no code
        return _once(rest, lambda rest: _once(F.instr(rest, "1") - 1, lambda zeros: read(state, rest, zeros)))

    start = F.struct(F.array().cast("array<bigint>").alias("values"), F.lit(0).alias("used"))
    end = lambda s: F.struct(s["values"], F.when(s["used"] >= 0, s["used"]).alias("used"))
    # -1 is the end: a start that cannot be null stays so
    return _once(bits, lambda given: F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda state, _: step(given, state), end))


def signed(number: Column) -> Column:
    """The signed number of a code number, which has to fit 32 bits."""
    half = F.shiftright(number + 1, 1)
    return F.when(number % 2 == 1, half).otherwise(-half)
