"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. Text lengths are summed over a sliding
window of ``WINDOW`` lines. A *surge* is where the sum reaches ``SURGE`` characters; around it a
passage reaches as far as the sums stay at ``DIVE`` or more, and the *dive* is where they fall below.
The passages are the main text, on every page.

What a page says of itself is evidence that weighs its lines. A line in an article counts
``ARTICLE`` times and never dives. Lines of menus, headers, footers, sidebars, notices, adverts,
forms (but those around an article) and comments are summed on their own, by what is not in links, and need ``MARK`` times the
density. A line of links only counts as blank outside an article and once in it. Scripts, styles and
what is not displayed are no lines. If nothing surges, the text of articles is kept, or else the
densest stretch of unmarked lines.

Defined cases: a null, empty or text-free page gives an empty text. Unclosed and stray tags are
tolerated. Rows that repeat a ``page_id``, or have none, are read each. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import common

WINDOW = 3
SURGE = 86
DIVE = 30
ARTICLE = 16
MARK = 8

#: What HTML elements mean here.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NOT_TEXT = frozenset("aside dialog footer form header label menu nav".split())
UNSEEN = frozenset("button datalist head input noscript option select template textarea title".split())
RAW = frozenset("script style iframe noembed noframes svg math object canvas audio video".split())
WALLS = frozenset("article main body td table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|copyright|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|outbrain|pager|pagination|popup|promo|promoted|related|replies|respond|share|sharing|sidebar|sidebars|signup|skip|social|sponsor|sponsored|subscribe|taboola|teaser|toolbar|widget|widgets)(?:$|[\s_-])")
ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content)(?:[\s_-]?(?:body|content|text))?(?:$|[\s_-])")
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: End tags of these are optional: a new one of the group closes the last.
_PEERS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<(?![A-Za-z/])", re.S)
_CUT_TAG = re.compile(r"<(/?)([A-Za-z]*)([^>]*)>")
#: A header by this name is the article's own.
OWN_HEADER = re.compile(r"(?:^|\s)(?:article|post|entry|story|content)[_-]+header(?=$|\s)")
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")


def _marks(name: str, rest: str) -> tuple[bool, bool, bool]:
    """Whether an element is not displayed as text, says that it is no text, and holds the article."""
    if name in ("html", "body"):
        return False, False, False
    attributes = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    role = attributes.get("role", "")
    article = name in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articlebody"
    unseen = name in UNSEEN or ("hidden" in rest.lower() and "hidden" in _ATTRIBUTE.sub(" ", rest).lower().split()) or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
    no_text = name in NOT_TEXT or role in ROLES or (not article and bool(MARKED.search(OWN_HEADER.sub(" ", named))))
    article = article or (name in ("div", "section", "td") and bool(ARTICLE_NAME.search(named)))
    return unseen, no_text, article


def lines_of(page: str) -> list[tuple[str, bool, bool, int]]:
    """The blocks of a page in order: text (blank at the edges of articles and marked elements), whether in the article, whether in an element marked as no text, characters outside links."""
    out: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, unseen, no text, article
    where: dict[str, list[int]] = defaultdict(list)  # of each name: its places in the stack
    blocks: list[int] = []  # places of blocks that are no paragraphs
    walls: list[int] = []  # places of what an inline end tag does not reach across
    words: list[str] = []
    plain = 0
    unseen = mute = deep = links = 0
    at, n = 0, len(page)

    def close_block() -> None:
        nonlocal plain
        text = " ".join("".join(words).split())
        if text:
            out.append((text, deep > 0, mute > 0, plain))
        words.clear()
        plain = 0

    def leave(k: int) -> None:
        nonlocal unseen, mute, deep, links
        for name, hidden, no_text, article in stack[k:]:
            unseen -= hidden
            mute -= no_text
            deep -= article
            links -= name == "a"
            where[name].pop()
        del stack[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()
        while walls and walls[-1] >= k:
            walls.pop()

    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag with an open quote ends at the next >; without one the rest is markup
            m = _CUT_TAG.match(page, at) if page.find(">", at) >= 0 else None
            if m is None:
                break
        at = m.end()
        name = m.group(2)
        if not name:
            token = m.group()
            if token[0] != "<" or token == "<":
                if not unseen:
                    text = entities.unescape(token)
                    words.append(text)
                    plain += len(text.strip()) * (links == 0)
            continue
        name, rest = name.lower(), m.group(3)
        if not m.group(1):
            if name in RAW:
                end = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
                if not rest.endswith("/") or name in ("script", "style"):
                    at = page.find(">", end.end() - 1) + 1 if end else n
                    at = at or n
                continue
            if name in VOID:
                if name == "hr":
                    close_block()
                elif name in ("br", "wbr"):
                    words.append(" " if name == "br" else "")
                continue
            if name in BLOCK or name in _PEERS:
                close_block()
            peers = _PEERS.get(name)
            if peers:
                k = max(where[x][-1] if where[x] else -1 for x in peers)
                if k >= 0 and (not blocks or k >= blocks[-1]):
                    leave(k)
            hidden, no_text, article = _marks(name, rest)
            if no_text and not mute:
                close_block()
                out.append(("", deep > 0, False, 0))
            if article and not deep:
                close_block()
                out.append(("", False, False, 0))
            if article and name in ("article", "main"):  # a form around the article is no form of the page
                for k in where["form"]:
                    mute -= stack[k][2]
                    stack[k] = ("form", stack[k][1], False, stack[k][3])
            where[name].append(len(stack))
            if name in BLOCK and name != "p":
                blocks.append(len(stack))
            if name in WALLS:
                walls.append(len(stack))
            stack.append((name, hidden, no_text, article))
            unseen += hidden
            mute += no_text
            deep += article
            links += name == "a"
        else:
            k = where[name][-1] if where[name] else -1
            if k >= 0 and (name in BLOCK or not walls or k > walls[-1]):
                if name in BLOCK or any(x[2] or x[3] for x in stack[k:]):
                    close_block()
                was = deep
                leave(k)
                if was and not deep:
                    out.append(("", False, False, 0))
            elif k < 0 and name in BLOCK:
                close_block()
    close_block()
    return out


def passages(lengths: list[int], surge: int = SURGE, dive: int = DIVE) -> list[tuple[int, int]]:
    """Ranges of lines in which windows of WINDOW lines hold at least ``dive`` and one of them ``surge``."""
    out, start, end, top = [], 0, 0, 0
    total = sum(lengths[: WINDOW - 1])
    for i in range(len(lengths)):  # windows that begin at i; blank lines after the last are implied
        total += lengths[i + WINDOW - 1] if i + WINDOW <= len(lengths) else 0
        if total >= dive:
            if i >= end:
                if top >= surge:
                    out.append((start, end))
                start, top = i, 0
            end, top = min(i + WINDOW, len(lengths)), max(top, total)
        total -= lengths[i]
    return [*out, (start, end)] if top >= surge else out


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by a line feed."""
    lines = lines_of(page or "")
    gap = [(-1, 0)] * (2 * WINDOW)  # blank lines, so that no windows of both sides touch
    free: list[tuple[int, int]] = []  # number of a line, its weight
    marked: list[tuple[int, int]] = []
    for i, (text, article, mark, plain) in enumerate(lines):
        if mark:
            marked.append((i, plain))
            continue
        if marked and marked[-1][0] >= 0:
            marked += gap
        if not text or (not plain and not article):
            free += [] if article else gap
        elif article:
            free.append((i, max(len(text) * (ARTICLE if plain else 1), DIVE)))
        else:
            free.append((i, len(text)))
    weights = [w for _, w in free]
    kept = [i for s, e in passages(weights) for i, _ in free[s:e]]
    kept += [i for s, e in passages([w for _, w in marked], SURGE * MARK, DIVE * MARK) for i, _ in marked[s:e]]
    if not kept:
        kept = [i for i, _ in free if i >= 0 and lines[i][1]]
    if not kept:
        runs = passages(weights, 1, 1)
        kept = [i for i, _ in free[slice(*max(runs, key=lambda r: sum(weights[r[0] : r[1]])))]] if runs else []
    return "\n".join(lines[i][0] for i in sorted(set(kept)) if i >= 0)


_OUT = "page_id long, url string, text string, n_chars long"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars."""
    common.ship(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(_run, _OUT)
