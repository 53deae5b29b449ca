"""Framed formats without a magic number: whichever starts first where three frames chain."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Bytes that are searched for a first frame, and frames that must follow one another.
SCAN, CHAIN = 8 << 10, 3
#: Bit rates (kbit/s) of MPEG-1 layers I, II, III and of MPEG-2 layer I and layers II, III; rates of MPEG-1.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


def mpeg_audio_bytes(data: bytes, at: int) -> int:
    """Bytes of the MPEG audio frame at ``at``; 0 if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return 0
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    index, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return 0
    family = 1 if version == 3 else 2
    hertz = RATES[rate] // (1 if version == 3 else 2 if version == 2 else 4)
    bits, pad = KBPS[family, layer][index] * 1000, data[at + 2] >> 1 & 1
    if layer == 1:
        return (12 * bits // hertz + pad) * 4
    return (72 if layer == 3 and family == 2 else 144) * bits // hertz + pad


def adts_bytes(data: bytes, at: int) -> int:
    """Bytes of the ADTS frame at ``at``; 0 if there is none."""
    if at + 7 > len(data) or data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0 or data[at + 2] >> 2 & 15 > 12:
        return 0
    size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
    return size if size >= 7 else 0


def chains(data: bytes, at: int, size_at) -> bool:
    """Whether CHAIN frames follow one another from ``at``, or the data ends behind fewer."""
    for _ in range(CHAIN):
        size = size_at(data, at)
        if not size:
            return False
        at += size
        if at >= len(data):
            return True
    return True


def framed_format(data: bytes) -> str | None:
    end = min(max(len(data) - 8, 0), SCAN)
    at = data.find(b"\xff", 0, end)
    while at >= 0:
        for name, size_at in (("adts", adts_bytes), ("mp3", mpeg_audio_bytes)):
            if chains(data, at, size_at):
                return name
        at = data.find(b"\xff", at + 1, end)
    return None


@arrow_udf(StringType())
def framed(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else framed_format(d) for d in data.to_pylist()], pa.string())
