"""Checksums that Spark lacks, as Arrow functions over binary columns (null stays null)."""

from __future__ import annotations

import sys
import zlib

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def table(polynomial: int, bits: int) -> list[int]:
    """What each byte adds to a checksum that shifts its highest bit out first."""
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for byte in range(256):
        v = byte << bits - 8
        for _ in range(8):
            v = (v << 1 ^ polynomial) & mask if v & top else v << 1 & mask
        out.append(v)
    return out


_CRC8, _CRC16 = table(0x07, 8), table(0x8005, 16)


def crc8_of(data: bytes) -> int:
    v = 0
    for b in data:
        v = _CRC8[v ^ b]
    return v


def crc16_of(data: bytes, start: int = 0) -> int:
    v = start
    for b in data:
        v = (v << 8 & 0xFFFF) ^ _CRC16[v >> 8 ^ b]
    return v


def ogg_crc_of(data: bytes) -> int:
    """Polynomial 04C11DB7, highest bit first, nothing inverted: zlib's on mirrored bits without its inversions."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _over(column: pa.Array, f) -> pa.Array:
    return pa.array([None if v is None else f(v) for v in column.to_pylist()], pa.int64())


@arrow_udf(LongType())
def crc8(data: pa.Array) -> pa.Array:
    """FLAC frame headers."""
    return _over(data, crc8_of)


@arrow_udf(LongType())
def crc16(data: pa.Array) -> pa.Array:
    """FLAC frames."""
    return _over(data, crc16_of)


@arrow_udf(LongType())
def crc16_mpeg(data: pa.Array) -> pa.Array:
    """MPEG audio: as :func:`crc16`, from all ones."""
    return _over(data, lambda d: crc16_of(d, 0xFFFF))


@arrow_udf(LongType())
def ogg_crc32(data: pa.Array) -> pa.Array:
    """Ogg pages (with their checksum field zeroed)."""
    return _over(data, ogg_crc_of)


@arrow_udf(LongType())
def adler32(data: pa.Array) -> pa.Array:
    """The checksum of zlib streams."""
    return _over(data, zlib.adler32)
