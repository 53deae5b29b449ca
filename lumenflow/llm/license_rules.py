"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences at stops and blank lines; the wrapped lines of a paragraph are joined, and
a line feed or semicolon ends a sentence only where a known one begins behind it or a short known one is
complete, and a long known one begins a sentence wherever it stands. Sentences are normalised (lower case, each run of anything but letters, digits and dots becomes
one space). A table of known licence sentences maps them to identifiers by
equality or by start; a text's identifiers in order are its sequence. Ordered licence rules are then
matched against the sequence: a rule names a run of identifiers that must follow one another; the
first rule that matches takes them, and later rules see only what is left. Sentences that look like
licence talk but are not in the table get the identifier ``unknown``.

Everything happens within a row: no shuffle, no broadcast, no Python. The tables are small fixed
parameters.

Defined cases: a null or empty text has no sentences and the verdict ``none``. Rows that repeat a
``doc_id``, or have none, are scanned each. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The licences of one family of notices: (identifier, name in the notice, versions).
FAMILIES = (("gpl", "general", ("2", "3")), ("lgpl", "lesser general", ("2.1", "3")), ("lgpl", "library general", ("2",)), ("agpl", "affero general", ("3",)))
#: Identifiers that a line ``SPDX-License-Identifier:`` names.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "0BSD", "Unlicense", "BSL-1.0", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
#: The GNU licences there: families, versions and tails.
SPDX_GNU = tuple(f"{f}-{v}{tail}" for f, versions in (("GPL", ("1.0", "2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("3.0",))) for v in versions for tail in ("-or-later", "-only", ""))


def _words(s: str) -> str:
    """A sentence as the scan normalises it."""
    return re.sub(r"[^a-z0-9.]+", " ", s.lower()).strip()


def _gnu(head: str, kind: str) -> str:
    return f"this {head} is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license"


def _version(v: str) -> str:
    return v if "." in v else f"{v}.0"


_HEADS = ("program", "library")
#: Known licence sentences, normalised: (identifier, kind of match, sentence).
SENTENCES = (
    ("mit_grant", "is", "released under the mit license"),
    ("mit_grant", "is", "licensed under the mit license"),
    ("mit_grant", "starts", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", "starts", "the above copyright notice and this permission notice shall be included"),
    ("as_is", "starts", "the software is provided as is without warranty of any kind"),
    ("mit_liability", "starts", "in no event shall the authors or copyright holders be liable"),
    ("apache2_grant", "is", "licensed under the apache license version 2.0"),
    ("apache2_grant", "starts", "licensed under the apache license version 2.0 the license"),
    ("apache2_grant", "starts", "the asf licenses this file to you under the apache license version 2.0"),
    ("apache2_use", "starts", "you may not use this file except in compliance with the license"),
    ("apache2_copy", "starts", "you may obtain a copy of the license at"),
    ("apache2_warranty", "starts", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache2_see", "starts", "see the license for the specific language governing permissions"),
    ("gpl3_grant", "is", "this work is licensed under the gnu general public license version 3"),
    ("gpl2_grant", "is", "this work is licensed under the gnu general public license version 2"),
    *((f"{f}{v}_free", "starts", f"{_gnu(h, kind)} as published by the free software foundation either version {v} of the license or at your option any later version") for f, kind, versions in FAMILIES for v in versions for h in _HEADS),
    *((f"{f}{v}_only", "starts", f"{_gnu(h, kind)} {x}") for f, kind, versions in FAMILIES for v in versions for h in _HEADS for x in (f"as published by the free software foundation version {v} of the license", f"version {v} as published by the free software foundation")),
    ("gpl_free", "starts", _gnu("program", "general")),
    *(("gpl_warranty", "starts", f"this {h} is distributed in the hope that it will be useful") for h in _HEADS),
    *((f"{f}_see", "starts", f"see the gnu {kind} public license for more details") for f, kind, _ in FAMILIES),
    *((f"{f}_copy", "starts", f"you should have received a copy of the gnu {kind} public license") for f, kind, _ in FAMILIES),
    ("gpl_write", "starts", "if not write to the free software foundation"),
    ("gpl_write", "starts", "if not see http www.gnu.org licenses"),
    ("gpl_write", "starts", "if not see https www.gnu.org licenses"),
    ("mpl2_grant", "starts", "this source code form is subject to the terms of the mozilla public license"),
    ("epl2_grant", "starts", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("epl2_grant", "starts", "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0"),
    ("isc_grant", "starts", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc_grant", "starts", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd_grant", "is", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_as_is", "starts", "the software is provided as is and the author disclaims all warranties"),
    ("zlib_as_is", "starts", "this software is provided as is without any express or implied warranty"),
    ("zlib_grant", "starts", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", "starts", "this is free and unencumbered software released into the public domain"),
    ("boost_grant", "starts", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost_notice", "starts", "the copyright notices in the software and this entire statement"),
    ("boost_short", "starts", "distributed under the boost software license version 1.0"),
    *((f"spdx_{x}", "is", f"spdx license identifier {_words(x)}") for x in (*SPDX, *SPDX_GNU)),
    ("bsd_grant", "starts", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", "starts", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "starts", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_names", "starts", "neither the name of"),
    ("bsd_as_is", "starts", "this software is provided by"),
    *(("bsd_liability", "starts", f"in no event shall the copyright {x} or contributors be liable") for x in ("holder", "holders", "owner", "owners")),
    ("cc_by_nc_4", "is", "licensed under cc by nc 4.0"),
    ("cc_by_sa_4", "is", "licensed under cc by sa 4.0"),
    ("cc_by_4", "is", "licensed under cc by 4.0"),
    ("cc0", "starts", "to the extent possible under law the author has waived all copyright"),
    ("reserved", "is", "all rights reserved"),
)
#: Ordered rules: (licence, identifiers in a row). Earlier rules take their sentences first.
RULES = (
    ("MIT", "mit_grant,mit_notice,as_is,mit_liability"),
    ("MIT", "mit_grant,mit_notice,as_is"),
    ("Apache-2.0", "apache2_grant,apache2_use,apache2_copy,apache2_warranty,apache2_see"),
    ("Apache-2.0", "apache2_grant,apache2_use,apache2_copy,apache2_warranty"),
    *((name, f"{head}bsd_grant,bsd_source,bsd_binary{names}{tail}") for name, names in (("BSD-3-Clause", ",bsd_names"), ("BSD-2-Clause", "")) for tail in (",bsd_as_is,bsd_liability", ",bsd_as_is", "") for head in ("reserved,", "")),
    *(
        (f"{f.upper()}-{_version(v)}{later}", f"{f}{v}_{kind},gpl_warranty{tail}")
        for f, v in dict.fromkeys((f, v) for f, _, versions in FAMILIES for v in versions)
        for kind, later in (("free", "-or-later"), ("only", ""))
        for tail in (f",{f}_see,{f}_copy,gpl_write", f",{f}_see,{f}_copy", f",{f}_copy,gpl_write", f",{f}_copy")
    ),
    *(("GPL-1.0-or-later", f"gpl_free,gpl_warranty{tail}") for tail in (",gpl_see,gpl_copy,gpl_write", ",gpl_see,gpl_copy", ",gpl_copy,gpl_write", ",gpl_copy")),
    ("MPL-2.0", "mpl2_grant"),
    ("EPL-2.0", "epl2_grant"),
    ("ISC", "isc_grant,isc_as_is"),
    ("0BSD", "0bsd_grant,isc_as_is"),
    ("Zlib", "zlib_as_is,zlib_grant"),
    ("Unlicense", "unlicense"),
    ("BSL-1.0", "boost_grant,boost_notice,as_is"),
    ("BSL-1.0", "boost_short"),
    *((x.removesuffix("-only"), f"spdx_{x}") for x in (*SPDX, *SPDX_GNU)),
    ("GPL-3.0", "gpl3_grant"),
    ("GPL-2.0", "gpl2_grant"),
    ("Apache-2.0", "apache2_grant"),
    ("MIT", "mit_grant"),
    ("CC-BY-NC-4.0", "cc_by_nc_4"),
    ("CC-BY-SA-4.0", "cc_by_sa_4"),
    ("CC-BY-4.0", "cc_by_4"),
    ("CC0-1.0", "cc0"),
    ("Proprietary", "reserved"),
)
#: A sentence with one of these, known or not, is licence talk; texts without any are not cut up.
TALK = r"(?i)licen[sc]|copyright|rights reserved|warrant|redistribut|permission is|permission notice|free software|general public|hope that it|neither the name|hereby granted|unencumbered software"
_GAP = r"[^\p{L}\p{N}.]"
_NO_WORD = r"[^\p{L}\p{N}]"


def _either(sentences: list[list[str]], gap: str, whole: bool) -> str:
    """A pattern for any of some sentences, common starts written once; ``whole`` says whether what follows a shorter one is matched too."""
    tails: dict[str, list[list[str]]] = {}
    for first, *rest in sentences:
        tails.setdefault(first, []).append(rest)
    out = []
    for first, rests in tails.items():
        more, ends = [r for r in rests if r], [] in rests
        tail = f"{gap}{_either(more, gap, whole)}" if more and (whole or not ends) else ""
        out.append(re.escape(first) + (f"(?:{tail})?" if tail and ends else tail))
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


_CUT = [(kind, t.split()) for _, kind, t in SENTENCES]
_ANY = _either([w for _, w in _CUT], f"{_GAP}{{1,20}}", False)
_SHORT = _either([w for kind, w in _CUT if kind == "is"], f"{_GAP}{{1,4}}", True)
_LONG = _either([w for kind, w in _CUT if kind == "starts" and len(w) > 5], f"{_GAP}{{1,20}}", False)
_BULLET = rf"(?:\(?[0-9a-z]{{1,3}}[.)]{_NO_WORD}{{1,20}})?"
#: Sentences end before a known one on a new line or behind a colon or semicolon, before a known one of six
#: words and more anywhere; behind a short known one at a line feed or semicolon; at blank lines (not before
#: an address); at a stop before white space or the end.
END = (
    rf"(?i)(?:\n|[;:][ \t\r\n]){_NO_WORD}{{0,20}}{_BULLET}(?={_ANY})"
    rf"|[ \t]{_NO_WORD}{{0,20}}(?={_LONG})"
    rf"|[;\n](?<=(?:{_SHORT}){_GAP}{{0,4}}[;\n])(?!{_NO_WORD}{{0,20}}the{_GAP}{{1,4}}licen)"
    rf"|\n(?:[^\p{{L}}\p{{N}}\n]*+\n)++(?![^\p{{L}}\p{{N}}\n]*+https?:)"
    rf"|[.!?]+(?=[ \t\r\n]|$)[ \t\r]*(?:{_BULLET}(?={_ANY}))?"
)


def _known(sentence: Column) -> Column:
    """The identifier of a normalised sentence, ``unknown`` for other licence talk, else null."""
    out = None
    for name, kind, text in SENTENCES:
        test = sentence == text if kind == "is" else sentence.startswith(text)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(sentence.rlike(TALK), "unknown")


def sequence(text: Column) -> Column:
    """The identifiers of a text's licence sentences, in order."""
    tidy = lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}.]+", " "))
    cut = F.filter(F.split(text, END), lambda s: s.rlike(TALK))
    return F.filter(F.transform(F.transform(cut, tidy), _known), lambda x: x.isNotNull())


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_sentences, sequence, licenses, n_unmatched, verdict."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.when(text.rlike(TALK), F.array_join(sequence(text), ",")).otherwise("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("sequence"))
    left = F.concat(F.lit(","), F.regexp_replace("sequence", ",", ",,"), F.lit(","))
    rules = F.array(*(F.struct(F.lit("," + ids.replace(",", ",,") + ",").alias("run"), F.lit(f"{name},").alias("name")) for name, ids in RULES))
    take = lambda a, r: F.struct(F.replace(a.left, r.run, F.lit("")).alias("left"), F.when(F.contains(a.left, r.run), F.concat(a.names, r["name"])).otherwise(a.names).alias("names"))
    none = F.struct(F.lit("").alias("left"), F.lit("").alias("names"))
    rows = rows.withColumn("end", F.when(F.col("sequence") == "", none).otherwise(F.aggregate(rules, F.struct(left.alias("left"), F.lit("").alias("names")), take)))
    rows = rows.select("doc_id", "sequence", "end.left", "end.names")
    count = lambda c: F.when(F.col(c) == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))).cast("long")
    names = F.array_sort(F.array_distinct(F.filter(F.split("names", ","), lambda x: x != "")))
    n = F.size(names)
    verdict = F.when(n == 1, names[0]).when(n > 1, "multiple").when(F.col("sequence") != "", "unknown").otherwise("none")
    return rows.select("doc_id", F.when(F.col("sequence") == "", 0).otherwise(count("sequence") + 1).cast("long").alias("n_sentences"), "sequence", F.array_join(names, ",").alias("licenses"), (count("left") / 2).cast("long").alias("n_unmatched"), verdict.alias("verdict"))


def oracle_sql(table: str = "documents") -> str:
    """The same result in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    case = " ".join(f"WHEN {'s = ' + quote(t) if kind == 'is' else f'starts_with(s, {quote(t)})'} THEN {quote(name)}" for name, kind, t in SENTENCES)
    steps, last = [], "q"
    for i, (name, ids) in enumerate(RULES):
        run = quote("," + ids.replace(",", ",,") + ",")
        steps.append(f"r{i} AS (SELECT doc_id, sequence, replace(rest, {run}, '') AS rest, CASE WHEN contains(rest, {run}) THEN names || {quote(name + ',')} ELSE names END AS names FROM {last})")
        last = f"r{i}"
    return f"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM {table}),
             c AS (SELECT r, string_split_regex(regexp_replace(t, '\\n+|[.;!?]+([ \\t\\r\\n]|$)', e'\\n', 'g'), '\\n') AS a FROM t WHERE regexp_matches(t, {quote(TALK)})),
             n AS (SELECT r, i, trim(regexp_replace(lower(a[i]), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g')) AS s FROM c, range(1, len(a) + 1) AS u(i) WHERE regexp_matches(a[i], {quote(TALK)})),
             k AS (SELECT r, i, CASE {case} WHEN regexp_matches(s, {quote(TALK)}) THEN 'unknown' END AS id FROM n),
             g AS (SELECT r, string_agg(id, ',' ORDER BY i) AS sequence FROM k WHERE id IS NOT NULL GROUP BY r),
             q AS (SELECT doc_id, coalesce(sequence, '') AS sequence, CASE WHEN sequence IS NULL THEN '' ELSE ',' || replace(sequence, ',', ',,') || ',' END AS rest, '' AS names FROM t LEFT JOIN g USING (r)),
             {", ".join(steps)},
             z AS (SELECT *, list_sort(list_distinct(list_filter(string_split(names, ','), lambda x: x <> ''))) AS l FROM {last})
        SELECT doc_id, CASE WHEN sequence = '' THEN 0 ELSE length(sequence) - length(replace(sequence, ',', '')) + 1 END AS n_sentences,
               sequence, array_to_string(l, ',') AS licenses, CAST((length(rest) - length(replace(rest, ',', ''))) // 2 AS BIGINT) AS n_unmatched,
               CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) > 1 THEN 'multiple' WHEN sequence <> '' THEN 'unknown' ELSE 'none' END AS verdict
        FROM z"""
