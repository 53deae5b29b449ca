"""Signals held as arrays: comparison, windows, transforms, colour matrices."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; 1 if both are constant and equal, 0 if only one is constant or there is nothing."""
    n = F.size(a)
    sa, sb = _sum(F.transform(a, lambda x: x.cast("double"))), _sum(F.transform(b, lambda x: x.cast("double")))
    cov, va, vb = n * dot(a, b) - sa * sb, n * dot(a, a) - sa * sa, n * dot(b, b) - sb * sb
    flat = F.when((n > 0) & (dot(a, a) + dot(b, b) - 2 * dot(a, b) == 0), 1.0).otherwise(0.0)
    return F.when((n == 0) | (va <= 0) | (vb <= 0), flat).otherwise(cov / F.sqrt(va * vb))


def rms_delta(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(d, d) / F.nullif(F.size(a), F.lit(0)))


def peak_delta(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def psnr(a: Column, b: Column, peak: float) -> Column:
    """Peak signal-to-noise ratio in dB; null where the signals are equal."""
    r = rms_delta(a, b)
    return F.when(r > 0, 20 * F.log10(F.lit(peak) / r))


def sine_window(n: int) -> list[float]:
    return [math.sin(math.pi / n * (i + 0.5)) for i in range(n)]


def vorbis_window(n: int) -> list[float]:
    return [math.sin(math.pi / 2 * s * s) for s in sine_window(n)]


def linear(a: Column, rows: list[list[float]]) -> Column:
    """A matrix times the array, by batches in numpy; null for a null array, one of another length or with nulls."""
    matrix = np.array(rows, dtype=np.float64)

    @arrow_udf(ArrayType(DoubleType()))
    def product(values: pa.Array) -> pa.Array:
        lists = values.to_pylist()
        good = [v is not None and len(v) == matrix.shape[1] and None not in v for v in lists]
        out = np.array([v for v, ok in zip(lists, good, strict=True) if ok], dtype=np.float64).reshape(-1, matrix.shape[1]) @ matrix.T
        found = iter(out.tolist())
        return pa.array([next(found) if ok else None for ok in good], pa.list_(pa.float64()))

    return product(a)


def dft_rows(n: int) -> tuple[list[list[float]], list[list[float]]]:
    """Real and imaginary rows of the real transform: n / 2 + 1 bins, forward sign negative."""
    angle = lambda k, i: 2 * math.pi * (k * i % n) / n
    return [[math.cos(angle(k, i)) for i in range(n)] for k in range(n // 2 + 1)], [[-math.sin(angle(k, i)) for i in range(n)] for k in range(n // 2 + 1)]


def dct2_rows(n: int) -> list[list[float]]:
    return [[math.cos(math.pi / n * (i + 0.5) * k) for i in range(n)] for k in range(n)]


def mdct_rows(n: int) -> list[list[float]]:
    """2n samples to n coefficients."""
    return [[math.cos(math.pi / n * (i + 0.5 + n / 2) * (k + 0.5)) for i in range(2 * n)] for k in range(n)]


def imdct_rows(n: int) -> list[list[float]]:
    """n coefficients to 2n samples, scaled by 2 / n: overlap-add of windowed halves gives the signal back."""
    return [[2 / n * r[i] for r in mdct_rows(n)] for i in range(2 * n)]


def dct3_rows(n: int) -> list[list[float]]:
    """Half the first value plus cosines: after :func:`dct2_rows` it gives n / 2 times the signal."""
    return [[0.5 if k == 0 else math.cos(math.pi / n * k * (i + 0.5)) for k in range(n)] for i in range(n)]


def dct4_rows(n: int) -> list[list[float]]:
    return [[math.cos(math.pi / n * (i + 0.5) * (k + 0.5)) for i in range(n)] for k in range(n)]


def kbd_window(n: int, alpha: float) -> list[float]:
    """Kaiser-Bessel derived window of ``n`` values (a multiple of 4)."""
    if n % 4:
        raise ValueError("the length is a multiple of 4")
    import numpy as np

    half = np.cumsum(np.kaiser(n // 2 + 1, math.pi * alpha))
    rising = np.sqrt(half[:-1] / half[-1])
    return [*rising.tolist(), *rising[::-1].tolist()]


#: Factors (of 256) of blue and red difference in luma, blue difference, red difference.
REMAP = {("bt601", "bt709"): ((-30, -53), (261, 29), (19, 262)), ("bt709", "bt601"): ((25, 49), (253, -28), (-19, 252))}


def remap(y: Column, u: Column, v: Column, source: str, target: str) -> tuple[Column, Column, Column]:
    """Codes of 8 bits from one matrix to the other; any other pair of matrices leaves them alone."""
    if (source, target) not in REMAP:
        return y, u, v
    part = lambda f: F.shiftright((f[0] * (u - 128) + f[1] * (v - 128) + 128).cast("int"), 8)
    code = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(255))
    luma, blue, red = REMAP[source, target]
    return code(y + part(luma)), code(128 + part(blue)), code(128 + part(red))
