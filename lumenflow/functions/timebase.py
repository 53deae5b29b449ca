"""Exact rational time: ticks of num/den seconds, as Column expressions.

Products are DECIMAL(38,0), so a rescale of 64-bit ticks with factors up to 9 digits is exact.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest 64-bit number.
MOST = (1 << 63) - 1
ROUNDINGS = ("down", "up", "zero", "nearest")


def div_round(a: Column, d: int, rounding: str) -> Column:
    """``a / d`` for a whole DECIMAL or BIGINT ``a`` and a positive ``d``, as DECIMAL(38,0)."""
    r = a % F.lit(d)
    q = ((a - r) / F.lit(d)).cast("decimal(38,0)")
    if rounding == "down":
        q = q - F.when(r < 0, 1).otherwise(0)
    elif rounding == "up":
        q = q + F.when(r > 0, 1).otherwise(0)
    elif rounding == "nearest":  # half away from zero
        q = q + F.when(F.abs(r) * 2 >= d, F.sign(r).cast("int")).otherwise(0)
    elif rounding != "zero":
        raise ValueError(f"rounding is one of {ROUNDINGS}, not {rounding}")
    return q


def _rescaled(ticks: Column, base: tuple[int, int], to: tuple[int, int], rounding: str) -> Column:
    f = Fraction(*base) / Fraction(*to)
    return div_round(ticks.cast("decimal(19,0)") * F.lit(f.numerator).cast("decimal(18,0)"), f.denominator, rounding)


def rescale(ticks: Column, base: tuple[int, int], to: tuple[int, int], rounding: str = "nearest") -> Column:
    """Ticks of ``base`` seconds as ticks of ``to`` seconds, rounded once; the nearest 64-bit number where the result does not fit."""
    end = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    q = _rescaled(ticks, base, to, rounding)
    return F.when(q.isNotNull(), F.greatest(F.least(q, end(MOST)), end(-MOST - 1))).cast("bigint")


def checked_rescale(ticks: Column, base: tuple[int, int], to: tuple[int, int], rounding: str = "nearest") -> Column:
    """As :func:`rescale`, but null where the result does not fit."""
    return _rescaled(ticks, base, to, rounding).try_cast("bigint")


def compare(a: Column, a_base: tuple[int, int], b: Column, b_base: tuple[int, int]) -> Column:
    """-1, 0 or 1 as instant ``a`` is before, at or after ``b``, exactly."""
    f = Fraction(*a_base) / Fraction(*b_base)
    product = lambda c, n: c.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)")
    x, y = product(a, f.numerator), product(b, f.denominator)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def diff(a: Column, a_base: tuple[int, int], b: Column, b_base: tuple[int, int]) -> Column:
    """``a - b`` in ticks of ``a``; null where it does not fit."""
    return F.try_subtract(a.cast("bigint"), checked_rescale(b, b_base, a_base))


def advance(ticks: Column, by: Column) -> Column:
    """The instant so many ticks of its own base later; null where it does not fit."""
    return F.try_add(ticks.cast("bigint"), by.cast("bigint"))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"cast(datediff(cast({ts} AS date), date'1970-01-01') AS bigint) * 86400000000 + hour({ts}) * 3600000000 + minute({ts}) * 60000000L + cast(extract(SECOND FROM {ts}) * 1000000L AS bigint)")
