"""SubRip, WebVTT and ASS documents as arrays of cues, and back: Column expressions without UDFs.

A cue is a struct of start_us, end_us (never before start_us), name, style, settings and body, in
file order; use ``posexplode`` for rows. A null document has no cues (null); a document without
timing lines has an empty array. ``skipped_*`` count the blocks without a timing line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenflow.functions.cues import clock_us, srt_clock

_TIMING = r"^(.*?)-->\s*(\S+)"


def normal_lines(text: Column) -> Column:
    """Without a byte-order mark and with line feeds only."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")


def _filled(block: Column) -> Column:
    return F.filter(F.split(block, "\n"), lambda line: line.rlike(r"\S"))


def _timing(line: Column, i: Column) -> Column:
    start, end = clock_us(F.trim(F.regexp_extract(line, _TIMING, 1))), clock_us(F.regexp_extract(line, _TIMING, 2))
    return F.struct(i.alias("at"), start.alias("start"), end.alias("end"))


def _timed(lines: Column) -> Column:
    """The lines of a block with its first timing line; its ``t`` is null without one."""
    timings = F.filter(F.transform(lines, _timing), lambda t: t["start"].isNotNull() & t["end"].isNotNull())
    return F.struct(lines.alias("lines"), F.get(timings, F.lit(0)).alias("t"))


def _cue(block: Column) -> Column:
    lines, t = block["lines"], block["t"]
    body = F.slice(lines, t["at"] + 2, F.size(lines))
    name = F.when(t["at"] > 0, F.get(lines, t["at"] - 1))
    settings = F.nullif(F.trim(F.regexp_replace(F.get(lines, t["at"]), r"^.*?-->\s*\S+", "")), F.lit(""))
    return _struct(t["start"], t["end"], name, F.lit(None).cast("string"), settings, F.rtrim(F.array_join(body, "\n")))


def _struct(start: Column, end: Column, name: Column, style: Column, settings: Column, body: Column) -> Column:
    return F.struct(start.alias("start_us"), F.greatest(start, end).alias("end_us"), name.alias("name"), style.alias("style"), settings.alias("settings"), body.alias("body"))


def _srt_blocks(text: Column) -> Column:
    blocks = F.split(F.concat(F.lit("\n"), normal_lines(text), F.lit("\n")), r"\n(?:[^\S\n]*\n)+")
    return F.transform(F.filter(blocks, lambda b: b.rlike(r"\S")), lambda b: _timed(_filled(b)))


def _vtt_blocks(text: Column) -> Column:
    text = F.regexp_replace(normal_lines(text), r"^\s*WEBVTT[\s\S]*?(?:\n\n|$)", "")
    blocks = F.filter(F.split(text, "\n\n"), lambda b: b.rlike(r"\S") & ~b.rlike(r"^\s*(?:NOTE|STYLE|REGION)(?:\s|$)"))
    return F.transform(blocks, lambda b: _timed(_filled(b)))


def _cues(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["t"].isNotNull()), _cue)


def _skipped(blocks: Column) -> Column:
    return F.size(F.filter(blocks, lambda b: b["t"].isNull()))


def srt_cues(text: Column) -> Column:
    return _cues(_srt_blocks(text))


def skipped_srt(text: Column) -> Column:
    return _skipped(_srt_blocks(text))


def webvtt_cues(text: Column) -> Column:
    return _cues(_vtt_blocks(text))


def skipped_webvtt(text: Column) -> Column:
    return _skipped(_vtt_blocks(text))


def webvtt_setting(settings: Column, name: str) -> Column:
    """``align``, ``position``, ``line`` or ``size`` of a cue's settings; null where it is not told."""
    return F.nullif(F.regexp_extract(settings, rf"(?:^|\s){name}:(\S+)", 1), F.lit(""))


ASS_COLUMNS = "Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ass_cues(text: Column) -> Column:
    """Dialogue rows of the events section, by the columns it declares; the last column keeps its commas."""

    def parts(section: Column) -> Column:
        declared = F.coalesce(F.nullif(F.trim(F.regexp_extract(section, r"(?im)^Format:(.*)$", 1)), F.lit("")), F.lit(ASS_COLUMNS))
        columns = F.transform(F.split(declared, ","), lambda c: F.lower(F.trim(c)))
        rows = F.filter(F.split(section, "\n"), lambda line: line.startswith("Dialogue:"))
        return F.struct(columns.alias("columns"), rows.alias("rows"))

    def cues(p: Column) -> Column:
        # A column that is not declared has position 0, so index -1: null.
        value = lambda values, name: F.get(values, F.array_position(p["columns"], name).cast("int") - 1)
        told = lambda values, name: F.nullif(F.trim(value(values, name)), F.lit(""))
        clock = lambda values, name: clock_us(F.trim(value(values, name)))
        row = lambda v: _struct(clock(v, "start"), clock(v, "end"), told(v, "name"), told(v, "style"), F.lit(None).cast("string"), F.coalesce(value(v, "text"), F.lit("")))
        split = F.transform(p["rows"], lambda line: F.split(F.regexp_replace(line, r"^Dialogue:\s*", ""), ",", F.size(p["columns"])))
        return F.filter(F.transform(split, row), lambda c: c["start_us"].isNotNull() & c["end_us"].isNotNull())

    section = F.regexp_extract(normal_lines(text), r"(?is)(?:^|\n)\[events\][^\n]*\n(.*?)(?=\n\[|$)", 1)
    return F.when(text.isNotNull(), _let(_let(section, parts), cues))


def ass_text(body: Column, wrap_style: int = 0) -> Column:
    """A row's text without overrides: hard breaks, soft breaks (a break only in wrap style 2) and hard spaces resolved."""
    out = F.regexp_replace(body, r"\{[^}]*\}", "")
    for mark, char in (("\\N", "\n"), ("\\n", "\n" if wrap_style == 2 else " "), ("\\h", " ")):
        out = F.replace(out, F.lit(mark), F.lit(char))
    return out


def srt_block(ordinal: Column, start_us: Column, end_us: Column, body: Column) -> Column:
    """One cue as SubRip text, with the blank line after it."""
    return F.concat(ordinal.cast("string"), F.lit("\n"), srt_clock(start_us), F.lit(" --> "), srt_clock(end_us), F.lit("\n"), body, F.lit("\n\n"))
