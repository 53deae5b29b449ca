"""Personal data: base patterns, and candidate spans judged by gradient-boosted trees.

Base spans (email, ip, card, phone) are what their fixed patterns find, and always stay. Beside
them, high-recall generators propose looser spans, which may overlap: addresses written with (at)
and (dot), telephone numbers without a plus sign, cards with other separators, IPv6 addresses. Each
candidate becomes a row of format and context features; boosted trees, trained on the driver on
seeded synthetic lines, score it; a threshold for each kind, set on lines that training did not see
so that 99.5 % of what passes is right, selects. Of overlapping selected candidates the best score
stays, and candidates that overlap a base span are left to it.

All scans are linear in the text. The model is a few kilobytes whatever the corpus.

The looser generators stop at what the formats themselves allow: 64 characters of a local part, 15
digits of a telephone number, 19 of a card.

Defined cases: a null text counts as empty and has no spans. Rows that repeat a ``doc_id``, or have
none, are searched each. An empty table gives an empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import common
from lumenflow.llm.boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Generators of looser candidates.
_AT = re.compile(r"[(\[{<] ?(?:at|AT|At) ?[)\]}>]")
_LOOSE_DOMAIN = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{<] ?(?:dot|DOT|Dot) ?[)\]}>]) ?[A-Za-z0-9-]++)++")
_SAID_AT = re.compile(r"(?<= )(?:at|AT) ([A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)++)")
_NUMBER = re.compile(r"(?<![\w+.-])\(?[0-9](?:[ ()./-]{0,2}+[0-9])+(?![\w])")
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![\w:])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @ sign outwards."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def _local_start(text: str, end: int) -> int:
    """Where the characters of a local part that end at ``end`` begin; 64 at most, as in mail."""
    start = end
    while start > 0 and end - start < 64 and text[start - 1] in _LOCAL:
        start -= 1
    return start


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data beyond the fixed patterns; they may overlap."""
    out = []
    for m in _AT.finditer(text):
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        end, start = start, start
        start = _local_start(text, start)
        d = _LOOSE_DOMAIN.match(text, m.end()) if start < end else None
        if d:
            out.append(("email", start, d.end()))
    for m in _SAID_AT.finditer(text):
        start = _local_start(text, m.start() - 1)
        if start < m.start() - 1:
            out.append(("email", start, m.end()))
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if 7 <= n <= 15:
                out.append(("phone", *m.span()))
            if 12 <= n <= 19:
                out.append(("card", *m.span()))
        if ":" in text:
            out += [("ip", *m.span()) for m in _IP6.finditer(text)]
    return out


#: Words that often stand before each kind.
CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "mastercard", "amex", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell"),
}
_BEFORE = 32


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    span, before, after = text[start:end], text[max(0, start - _BEFORE) : start].lower(), text[end : end + 12].lower()
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", span) if g]
    digits = [c for c in span if "0" <= c <= "9"]
    number = "".join(digits)
    seps = {c for c in span if not c.isalnum()}
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        len(groups),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        max(groups, default=0),
        min(groups, default=0),
        len(seps),
        span.count("-"),
        span.count("."),
        span.count(" "),
        span.count("/"),
        span.count(":"),
        float("(" in span and ")" in span),
        float(groups[-3:] == [3, 3, 4]),
        float(groups == [4, 4, 4, 4] or groups == [4, 6, 5]),
        float(bool(number) and luhn(number)),
        float(number[:2] in ("19", "20")),
        float(number[:3] in ("978", "979")),
        float(number[:1] == "0"),
        len(set(number)),
        float(any(c in before for c in CUES[kind])),
        float(before.rstrip()[-1:] in (":", "=")),
        float(before[-1:] in ("#", "$", "€", "£", "%", "=", "/", "_", ".", ",", "x", "v")),
        float(after[:1] in ("%", "$", "€", "/", "_", ",", "x") or after.lstrip()[:2] in ("km", "kg", "eu", "us", "mb", "gb", "ms")),
        float("dot" in span.lower()),
        float(bool(re.search(r"(no|nr|id|order|isbn|pages?|pp|version|ref)[ .:#]*$", before))),
    ]


def _lines(rng: np.random.Generator, n: int) -> Iterator[tuple[str, str, int, int, int]]:
    """Seeded synthetic examples: text, kind, span, and whether it is personal data."""
    d = lambda k, first=0: "".join([str(rng.integers(first, 10)), *map(str, rng.integers(0, 10, k - 1))]) if k else ""
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def card(sep: str) -> str:
        body = pick("3456") + d(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        full = body + last
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    for _ in range(n):
        cue, kind, yes = "", "phone", 1
        match int(rng.integers(0, 18)):
            case 0:
                span = pick(["({}) {}-{}", "({}){}-{}", "({}) {} {}"]).format(d(3, 2), d(3, 2), d(4))
            case 1:
                span = pick(["{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(d(3, 2), d(3, 2), d(4))
                cue = pick(["", "tel ", "call ", "phone: ", "fax "])
            case 2:
                span, cue = pick(["0{} {}", "0{}/{}", "00{} {}"]).format(d(pick([2, 3]), 1), d(7)), pick(["tel ", "phone: ", "mobile ", "call "])
            case 3:
                span, yes = f"{pick([19, 20])}{d(2)}-{pick(['01', '07', '11'])}-{pick(['03', '15', '28'])}", 0
            case 4:
                span, yes = f"{pick([19, 20])}{d(2)}-{pick([19, 20])}{d(2)}", 0
            case 5:
                span, yes, cue = d(int(rng.integers(7, 16)), 1), 0, pick(["", "", "no. ", "id ", "order ", "#", "ref: "])
            case 6:
                span, yes, cue = f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", 0, pick(["", "isbn "])
            case 7:
                span, yes = pick(["{}.{}", "{} - {}", "{} {}", "{}/{}"]).format(d(int(rng.integers(1, 6)), 1), d(int(rng.integers(6, 9)))), 0
            case 8:
                span, yes = " ".join(d(int(rng.integers(1, 4)), 1) for _ in range(int(rng.integers(4, 8)))), 0
            case 9:
                span, yes = ".".join(d(int(rng.integers(1, 3)), 1) for _ in range(int(rng.integers(5, 8)))), 0
            case 10:
                kind, span, cue = "card", card(pick([".", "/", "  "])), pick(["", "card ", "visa: ", "payment "])
            case 11:
                kind, yes, cue = "card", 0, pick(["", "no. ", "id ", "#"])
                span = pick([d(int(rng.integers(12, 20)), 1), ".".join(d(4) for _ in range(4)), "/".join(d(4) for _ in range(3))])
                if luhn("".join(c for c in span if c.isdigit())):
                    span = span[:-1] + str((int(span[-1]) + 1) % 10)
            case 12:
                kind, cue = "email", pick(["", "mail ", "contact: ", "write to "])
                at, dot = pick(["(at)", "[at]", " (at) ", " [at] ", "{at}"]), pick([".", "(dot)", " [dot] ", "[dot]"])
                span = f"{word()}.{word()}{at}{word()}{dot}{pick(['com', 'org', 'net', 'de', 'example'])}"
            case 13:
                kind, yes = "email", 0
                span = f"{word()} [at] {word()} . {word()} {word()}"[: int(rng.integers(16, 30))]
            case 14:
                span, yes, cue = pick(["{}-{}-{}", "{}.{}.{}"]).format(d(3, 2), d(3, 2), d(4)), 0, pick(["pages ", "page ", "pp. ", "no. ", "id ", "order ", "ref: ", "version "])
            case 15:
                kind, yes = "email", int(rng.integers(2))
                span = f"{word()}.{word()} at {word()} dot {pick(['com', 'org', 'net', 'de'])}" if yes else f"{word()} at {word()} dot {word()}"
                cue = pick(["mail ", "contact: ", "write to ", "reach me: "]) if yes else ""
            case 16:
                kind, cue = "ip", pick(["", "host ", "ip ", "from "])
                span = ":".join(f"{x:x}" for x in rng.integers(256, 65536, 8))
            case _:
                kind, yes = "ip", 0
                span = pick([":".join(d(2) for _ in range(int(rng.integers(2, 5)))), f"{d(1)}:{d(2)}:{d(2)}:{d(2)}"])
        before = " ".join(word() for _ in range(int(rng.integers(0, 4)))) + " " + cue
        text = before + span + pick([" ", ". ", ", ", "\n", ""]) + " ".join(word() for _ in range(int(rng.integers(0, 4))))
        yield text, kind, len(before), len(before) + len(span), yes


@lru_cache(maxsize=1)
def model() -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees, and the calibrated threshold of each kind."""
    rng = np.random.default_rng(7)
    rows = [(features(t, k, s, e), KINDS.index(k), yes) for t, k, s, e, yes in _lines(rng, 6000)]
    x, kind, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    fit, rest = slice(0, 4000), slice(4000, None)
    trees = BoostedTrees().fit(x[fit], y[fit])
    p, least = trees.score(x[rest]), []
    for k in range(len(KINDS)):
        at = kind[rest] == k
        order = np.argsort(-p[at], kind="stable")
        right = np.cumsum(y[rest][at][order]) / np.arange(1, at.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        least.append(max(0.5, float(p[at][order][good[-1]])) if len(good) else 2.0)
    return trees, tuple(least)


def find_spans(text: str, trees: BoostedTrees, thresholds: tuple[float, ...]) -> tuple[list, list]:
    """Base spans, and all spans, each by start and kind."""
    base = base_spans(text)
    more = _apart(candidates(text), base)
    if not more:
        return base, base
    p = trees.score(np.array([features(text, *c) for c in more]))
    chosen: list[tuple[str, int, int]] = []
    for i in np.argsort(-p, kind="stable"):
        c = more[i]
        if p[i] >= thresholds[KINDS.index(c[0])]:
            chosen.append(c)
    kept = _disjoint(chosen)
    return base, sorted([*base, *kept], key=lambda x: (x[1], KINDS.index(x[0])))


def _apart(spans: list, base: list) -> list:
    """Those of ``spans`` that overlap none of ``base`` (by start)."""
    starts, reach, top = [s for _, s, _ in base], [], 0
    for _, _, e in base:
        top = max(top, e)
        reach.append(top)  # the furthest end so far
    return [c for c in spans if not (k := bisect_left(starts, c[2])) or reach[k - 1] <= c[1]]


def _disjoint(spans: list) -> list:
    """Best first: drop what overlaps a better one."""
    taken: dict[int, list] = {}
    out = []
    for kind, s, e in spans:
        cells = range(s >> 7, (e >> 7) + 1)
        if not any(s < f and b < e for c in cells for b, f in taken.get(c, ())):
            out.append((kind, s, e))
            for c in cells:
                taken.setdefault(c, []).append((s, e))
    return out


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(trees: BoostedTrees, thresholds: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, spans = [], [], []
            for text in b.column(1).to_pylist():
                base, every = find_spans(text or "", trees, thresholds)
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *n, pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts and digest of the base spans, all spans."""
    common.ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_find(*model()), _FOUND)


def redact(text: str | None, trees: BoostedTrees, thresholds: tuple[float, ...]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in find_spans(text, trees, thresholds)[1]:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def redact_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; the other columns as they were."""
    common.ship(docs.sparkSession)
    trees, thresholds = model()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([redact(t, trees, thresholds) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)
