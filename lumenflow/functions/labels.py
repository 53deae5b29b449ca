"""Words and codes of media metadata as Column expressions: names, languages, colours, track numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 639-1 codes with their ISO 639-2 codes.
ISO_639 = (
    "aa aar ab abk af afr am amh ar ara as asm az aze ba bak be bel bg bul bn ben bo bod br bre bs bos ca cat cs ces cy cym da dan de deu el ell en eng eo epo es spa et est eu eus fa fas fi fin fo fao fr fra "
    "ga gle gl glg gu guj he heb hi hin hr hrv ht hat hu hun hy hye id ind is isl it ita ja jpn ka kat kk kaz km khm kn kan ko kor ku kur ky kir la lat lb ltz lo lao lt lit lv lav mk mkd ml mal mn mon mr mar ms msa mt mlt my mya "
    "ne nep nl nld no nor pa pan pl pol ps pus pt por ro ron ru rus sa san si sin sk slk sl slv sq sqi sr srp sv swe sw swa ta tam te tel tg tgk th tha tk tuk tl tgl tr tur tt tat uk ukr ur urd uz uzb vi vie yi yid zh zho zu zul"
).split()
#: Names of colours, as red, green and blue.
COLORS = {
    "black": (0, 0, 0),
    "silver": (192, 192, 192),
    "gray": (128, 128, 128),
    "grey": (128, 128, 128),
    "white": (255, 255, 255),
    "maroon": (128, 0, 0),
    "red": (255, 0, 0),
    "purple": (128, 0, 128),
    "fuchsia": (255, 0, 255),
    "green": (0, 128, 0),
    "lime": (0, 255, 0),
    "olive": (128, 128, 0),
    "yellow": (255, 255, 0),
    "navy": (0, 0, 128),
    "blue": (0, 0, 255),
    "teal": (0, 128, 128),
    "aqua": (0, 255, 255),
    "cyan": (0, 255, 255),
    "magenta": (255, 0, 255),
}


def snake_case(key: Column) -> Column:
    """``PlayResX`` as ``play_res_x``: spaces and hyphens are underscores, and one stands between a small letter or digit and a capital."""
    cut = F.regexp_replace(F.trim(key), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.translate(cut, " -", "__"))


def language(legacy: Column, tag: Column) -> Column:
    """Three letters of a language tag's first part, else the older element, else ``und``."""
    primary = F.lower(F.element_at(F.split(F.coalesce(tag, F.lit("")), "-"), 1))
    known = F.create_map(*(F.lit(x) for x in ISO_639))
    mapped = F.when(F.length(primary) == 2, F.try_element_at(known, primary)).when(F.length(primary) == 3, primary)
    return F.coalesce(mapped, F.nullif(legacy, F.lit("")), F.lit("und"))


def _channels(value: Column, *shifts: int) -> list[Column]:
    return [F.shiftright(value, s).bitwiseAND(255).cast("int") for s in shifts]


def ass_color(text: Column) -> Column:
    """Red, green, blue and alpha of ``&HAABBGGRR&``, whose AA is how transparent it is; null without hexadecimal digits or with more than 32 bits."""
    digits = F.regexp_extract(F.trim(text), "^[&Hh]*([0-9A-Fa-f]*)", 1)
    value = F.when(F.ltrim(digits, F.lit("0")).rlike("^.{0,8}$") & (digits != ""), F.conv(digits, 16, 10).cast("bigint"))
    red, green, blue, clear = _channels(value, 0, 8, 16, 24)
    return F.when(value.isNotNull(), F.array(red, green, blue, 255 - clear))


def html_color(text: Column) -> Column:
    """Red, green and blue of ``#rgb``, ``#rrggbb``, ``#rrggbbaa`` or a name; null for anything else."""
    value = F.lower(F.trim(text))
    digits = F.regexp_extract(value, "^#([0-9a-f]*)", 1)
    wide = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).when(F.length(digits).isin(6, 8), F.substring(digits, 1, 6))
    number = F.conv(wide, 16, 10).cast("bigint")
    named = F.create_map(*(x for name, rgb in COLORS.items() for x in (F.lit(name), F.array(*map(F.lit, rgb)))))
    return F.when(value.startswith("#"), F.when(number.isNotNull(), F.array(*_channels(number, 16, 8, 0)))).otherwise(F.try_element_at(named, value))


def track_number(text: Column) -> Column:
    """The number before a slash or a space; null if it is none of 32 bits."""
    number = F.element_at(F.split(text, "[/ ]"), 1)
    return F.when(F.trim(number).rlike(r"^\+?\d{1,10}$"), F.nullif(F.least(F.trim(number).cast("bigint"), F.lit(1 << 32)), F.lit(1 << 32)))


def colour_box(body: Column) -> Column:
    """primaries, transfer, matrix and range (0 says nothing, 1 limited, 2 full) of a colour box's bytes; null for other kinds or too few bytes."""
    number = lambda at, n: F.conv(F.hex(F.substring(body, at, n)), 16, 10).cast("int")
    kind = F.substring(body, 1, 4)
    said = F.when((kind == F.lit(b"nclx")) & (F.length(body) > 10), 1 + F.shiftright(number(11, 1), 7)).otherwise(0)
    return F.when(kind.isin(F.lit(b"nclx"), F.lit(b"nclc")) & (F.length(body) >= 10), F.struct(number(5, 2).alias("primaries"), number(7, 2).alias("transfer"), number(9, 2).alias("matrix"), said.alias("range")))
