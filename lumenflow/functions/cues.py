"""Subtitle clocks and plain text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of up to nine digits, so that their sum in microseconds fits 64 bits.
CLOCK = r"(?s)^\s*(-?)(?:(?:\s*\+?(\d{1,9})\s*:)?\s*\+?(\d{1,9})\s*:)?\s*\+?(\d{1,9})\s*(?:[.,](\d{0,6}).*)?$"


def clock_us(text: Column) -> Column:
    """Microseconds of ``[-][[h:]m:]s[.,fraction]``; null where the text is no clock. Of the fraction six digits count."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, CLOCK, i), F.lit("")), F.lit("0"))
    whole = (part(2).cast("bigint") * 60 + part(3).cast("bigint")) * 60 + part(4).cast("bigint")
    us = whole * 1_000_000 + F.rpad(part(5), 6, "0").cast("bigint")
    return F.when(text.rlike(CLOCK), F.when(F.regexp_extract(text, CLOCK, 1) == "-", -us).otherwise(us))


def srt_clock(us: Column) -> Column:
    """``hh:mm:ss,mmm`` of microseconds."""
    part = lambda div, mod, n: F.lpad(F.pmod(F.floor(us / div), F.lit(mod)).cast("string"), n, "0")
    return F.concat(part(3_600_000_000, 100, 2), F.lit(":"), part(60_000_000, 60, 2), F.lit(":"), part(1_000_000, 60, 2), F.lit(","), part(1000, 1000, 3))


def plain_text(text: Column) -> Column:
    """Words only: tags and ASS overrides dropped, hard breaks as line feeds, the named entities decoded."""
    out = F.regexp_replace(F.regexp_replace(text, r"\\N", "\n"), r"\{\\[^}]*\}|<[^>]*>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out
