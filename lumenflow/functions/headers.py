"""Headers of audio frames and pictures as structs: Column expressions over binary columns.

Every function gives null where the bytes are no such header, so a damaged packet is a row without
a header and never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenflow.functions.bits import big, field, little, pick

#: Sampling rates by index of AAC; of MPEG-1 audio; bit rates in kbit/s of MPEG-1 layers
#: 1, 2, 3, of MPEG-2 layer 1 and of MPEG-2 layers 2 and 3; bit rates of AC-3 and its sampling rates.
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
MPEG_RATES = [44100, 48000, 32000]
MPEG1_LAYER1 = [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448]
MPEG1_LAYER2 = [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]
MPEG1_LAYER3 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
MPEG2_LAYER1 = [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256]
MPEG2_LAYER23 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
AC3_KBPS = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
AC3_RATES = [48000, 44100, 32000]


def adts(data: Column) -> Column:
    """AAC in ADTS: object_type, rate, channels, frame_bytes, header_bytes."""
    word, tail = big(data, 0, 4), big(data, 3, 3)
    rate = pick(field(word, 10, 4), AAC_RATES)
    size = field(word, 0, 2) * 2048 + field(tail, 5, 11)
    header = F.when(field(word, 16, 1) == 1, 7).otherwise(9)
    ok = (field(word, 20, 12) == 0xFFF) & (field(word, 17, 2) == 0) & rate.isNotNull() & (size >= header)
    return F.when(ok, F.struct((field(word, 14, 2) + 1).alias("object_type"), rate.alias("rate"), field(word, 6, 3).alias("channels"), size.alias("frame_bytes"), header.alias("header_bytes")))


def mpeg_audio(data: Column) -> Column:
    """MPEG audio: version (1, 2, 25), layer, kbps, rate, channels, samples, frame_bytes; free format is null."""
    word = big(data, 0, 4)
    code, layer, rate_index = field(word, 19, 2), F.lit(4) - field(word, 17, 2), field(word, 10, 2)
    first, version = code == 3, F.when(code == 3, 1).when(code == 2, 2).otherwise(25)
    index = field(word, 12, 4)
    kbps = F.when(first & (layer == 1), pick(index, MPEG1_LAYER1)).when(first & (layer == 2), pick(index, MPEG1_LAYER2)).when(first, pick(index, MPEG1_LAYER3)).when(layer == 1, pick(index, MPEG2_LAYER1)).otherwise(pick(index, MPEG2_LAYER23))
    rate = (pick(rate_index, MPEG_RATES) / F.when(first, 1).when(code == 2, 2).otherwise(4)).cast("int")
    samples = F.when(layer == 1, 384).when((layer == 3) & ~first, 576).otherwise(1152)
    padding = field(word, 9, 1)
    slots = F.when(layer == 1, (F.floor(kbps * 12000 / rate) + padding) * 4).otherwise(F.floor(samples / 8 * kbps * 1000 / rate) + padding)
    ok = (field(word, 21, 11) == 0x7FF) & (code != 1) & (layer != 4) & (kbps > 0) & rate.isNotNull()
    return F.when(ok, F.struct(version.alias("version"), layer.cast("int").alias("layer"), kbps.alias("kbps"), rate.alias("rate"), F.when(field(word, 6, 2) == 3, 1).otherwise(2).alias("channels"), samples.alias("samples"), slots.cast("bigint").alias("frame_bytes")))


def ac3(data: Column) -> Column:
    """AC-3 sync information: rate, kbps, frame_bytes."""
    code = big(data, 4, 1)
    rate, size = pick(field(code, 6, 2), AC3_RATES), field(code, 0, 6)
    kbps = pick(F.shiftright(size, 1), AC3_KBPS)
    words = F.when(rate == 48000, kbps * 2).when(rate == 32000, kbps * 3).otherwise(F.floor(kbps * 320 / 147) + field(size, 0, 1))
    return F.when((big(data, 0, 2) == 0x0B77) & rate.isNotNull() & kbps.isNotNull(), F.struct(rate.alias("rate"), kbps.alias("kbps"), (words * 2).cast("bigint").alias("frame_bytes")))


def flac_stream_info(data: Column) -> Column:
    """The 34 bytes of STREAMINFO: block and frame bounds, rate, channels, bits, samples, md5."""
    word = big(data, 10, 4)
    rate = field(word, 12, 20)
    out = F.struct(
        big(data, 0, 2).alias("min_block"), big(data, 2, 2).alias("max_block"), big(data, 4, 3).alias("min_frame"), big(data, 7, 3).alias("max_frame"), rate.alias("rate"),
        (field(word, 9, 3) + 1).alias("channels"), (field(word, 4, 5) + 1).alias("bits"), (field(word, 0, 4) * F.lit(1 << 32) + big(data, 14, 4)).alias("samples"), F.lower(F.hex(F.substring(data, 19, 16))).alias("md5"),
    )
    return F.when((F.length(data) >= 34) & (rate > 0), out)


def opus_head(data: Column) -> Column:
    """OpusHead: channels, pre_skip, input_rate, gain (Q7.8 dB), mapping."""
    gain = little(data, 16, 2)
    out = F.struct(big(data, 9, 1).alias("channels"), little(data, 10, 2).alias("pre_skip"), little(data, 12, 4).alias("input_rate"), F.when(gain >= 32768, gain - 65536).otherwise(gain).alias("gain"), big(data, 18, 1).alias("mapping"))
    return F.when((F.substring(data, 1, 8) == F.lit(b"OpusHead")) & (F.length(data) >= 19) & (big(data, 8, 1) < 16) & (big(data, 9, 1) > 0), out)


def png(data: Column) -> Column:
    """PNG: width, height, depth, colour type, interlaced."""
    ok = (F.substring(data, 1, 8) == F.lit(b"\x89PNG\r\n\x1a\n")) & (F.substring(data, 13, 4) == F.lit(b"IHDR")) & (F.length(data) >= 29)
    return F.when(ok, F.struct(big(data, 16, 4).alias("width"), big(data, 20, 4).alias("height"), big(data, 24, 1).alias("depth"), big(data, 25, 1).alias("color_type"), (big(data, 28, 1) == 1).alias("interlaced")))


def gapless(frames: Column, samples: Column, delay: Column, padding: Column) -> Column:
    """MP3 with an encoder's tag: samples to drop in front and samples in all; the decoder itself delays 529."""
    total = F.greatest(frames * samples - F.greatest(padding - 529, F.lit(0)), F.lit(0))
    return F.struct((delay + 529).cast("bigint").alias("skip"), total.cast("bigint").alias("total"))
