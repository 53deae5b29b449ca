"""Picture and packet arithmetic as Column expressions: geometry, colour, matrices, packet durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixel formats: planes, chroma shifts (x, y), bytes a sample, samples a pixel in the first plane.
PIXEL_FORMATS = {
    "gray8": (1, 0, 0, 1, 1),
    "yuv420p": (3, 1, 1, 1, 1),
    "yuv422p": (3, 1, 0, 1, 1),
    "yuv444p": (3, 0, 0, 1, 1),
    "yuv420p10le": (3, 1, 1, 2, 1),
    "nv12": (2, 1, 1, 1, 1),
    "p010le": (2, 1, 1, 2, 1),
    "rgb24": (1, 0, 0, 1, 3),
    "rgba": (1, 0, 0, 1, 4),
}


def frame_bytes(fmt: Column, width: Column, height: Column) -> Column:
    """Bytes of a picture without padding; odd sizes round chroma up; null for unknown formats."""
    out = None
    for name, (planes, sx, sy, size, packed) in PIXEL_FORMATS.items():
        cw, ch = F.ceil(width / (1 << sx)), F.ceil(height / (1 << sy))
        chroma = cw * ch * (2 if planes > 1 else 0)
        value = ((width * height * packed + chroma) * size).cast("bigint")
        out = F.when(fmt == name, value) if out is None else out.when(fmt == name, value)
    return out


def matrix_of(container: Column, stream: Column, height: Column) -> Column:
    """Matrix code: the container's, else the bitstream's, else by size (1 for HD, 6 below); 2 says nothing."""
    told = lambda c: F.when(c != 2, c)
    return F.coalesce(told(container), told(stream), F.when(height >= 720, 1).otherwise(6))


def opus_frame_us(toc: Column) -> Column:
    """Microseconds of one frame by the configuration in an Opus TOC byte."""
    config = F.shiftright(toc, 3)
    speech = F.element_at(F.array(*map(F.lit, (10000, 20000, 40000, 60000))), (config % 4 + 1).cast("int"))
    hybrid = F.when(config % 2 == 0, 10000).otherwise(20000)
    music = F.element_at(F.array(*map(F.lit, (2500, 5000, 10000, 20000))), (config % 4 + 1).cast("int"))
    return F.when(config < 12, speech).when(config < 16, hybrid).otherwise(music)


def opus_frames(toc: Column, count: Column) -> Column:
    """Frames in a packet: 1, 2, 2, or the low six bits of the byte after the TOC."""
    code = toc.bitwiseAND(3)
    return F.when(code == 0, 1).when(code < 3, 2).otherwise(count.bitwiseAND(63))


def opus_samples(toc: Column, count: Column) -> Column:
    """Samples at 48 kHz of a packet; null if there are none or more than 120 ms."""
    n = (opus_frames(toc, count) * opus_frame_us(toc) * 48 / 1000).cast("bigint")
    return F.when((n > 0) & (n <= 5760), n)


def pcm_to_float(value: Column, bits: int, unsigned: bool = False) -> Column:
    """Integer PCM as a number from -1 to 1."""
    return (value - (1 << bits - 1) if unsigned else value) / F.lit(float(1 << bits - 1))


def mp4_language(code: Column) -> Column:
    """Three letters of five bits each; null for ``und`` and for anything but lower-case letters."""
    letters = F.concat(*(F.chr(F.shiftright(code, s).bitwiseAND(31) + 96) for s in (10, 5, 0)))
    return F.when(letters.rlike("^[a-z]{3}$") & (letters != "und"), letters)


def widen_8_to_16(v: Column) -> Column:
    return v * 257


def narrow_16_to_8(v: Column) -> Column:
    return ((v + 128 - (v + 128) % 257) / 257).cast("int")


def codec_kind(codec: Column) -> Column:
    """Whether a codec's streams are video, audio or subtitles; null if unknown."""
    video = ("h264", "hevc", "vp8", "vp9", "av1", "mpeg2video", "mpeg4", "mjpeg")
    audio = ("aac", "mp3", "opus", "vorbis", "flac", "alac", "ac3", "eac3", "truehd", "dts", "pcm")
    text = ("srt", "webvtt", "ass", "pgs")
    return F.when(codec.isin(*video), "video").when(codec.isin(*audio), "audio").when(codec.isin(*text), "subtitle")


def after_id3(head: Column) -> Column:
    """What follows an ID3v2 tag at the start; the whole where there is none, or nothing after it."""
    byte = lambda i: F.conv(F.hex(F.substring(head, i, 1)), 16, 10).cast("int")
    size = ((byte(7) * 128 + byte(8)) * 128 + byte(9)) * 128 + byte(10) + 10 + F.when(byte(6).bitwiseAND(16) != 0, 10).otherwise(0)
    tagged = (F.substring(head, 1, 3) == F.lit(b"ID3")) & (F.length(head) >= 10)
    rest = F.substring(head, size + 1, F.length(head))
    return F.when(tagged & (F.length(rest) > 0), rest).otherwise(head)


def sniff(head: Column) -> Column:
    """Container by content: magic numbers behind an ID3v2 tag, else the framed format of which three frames chain first; null if none is known."""
    from lumenflow.functions.sniffing import framed

    data = after_id3(head)
    at = lambda i, n: F.substring(data, i, n)
    is_ = lambda c, text: c == F.lit(text.encode("latin-1"))
    return (
        F.when(is_(at(1, 4), "RIFF") & is_(at(9, 4), "WAVE"), "wav")
        .when(is_(at(1, 4), "RIFF") & is_(at(9, 4), "AVI "), "avi")
        .when(is_(at(1, 4), "RIFF") & is_(at(9, 4), "WEBP"), "webp")
        .when(is_(at(1, 4), "fLaC"), "flac")
        .when(is_(at(1, 4), "OggS"), "ogg")
        .when(is_(at(1, 4), "\x1a\x45\xdf\xa3"), "matroska")
        .when(is_(at(5, 4), "ftyp"), "mp4")
        .when(is_(at(1, 8), "\x89PNG\r\n\x1a\n"), "png")
        .when(is_(at(1, 3), "\xff\xd8\xff"), "jpeg")
        .otherwise(framed(data))
    )
