"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block. A line's length counts only
where it can be article text: inside the page's article or main element if it
has one, and outside menus, headers, footers, asides, forms, scripts, hidden
parts and elements named as adverts, notices, comments and the like; outside
of articles a line that is nothing but a link in a list counts as empty too.
Lengths are summed over sliding windows of the lines that hold text. Where the
sums rise from zero is a surge, where they fall back to zero a dive; a stretch
runs from the first line that counts after the surge to the last one before
the dive. All countable lines are kept, however short. Lines of links in a list
are kept where they lie inside a stretch with running text on both sides, as
sources between two paragraphs do; a longer list makes the sums fall to zero
and is a menu, as is one at the end of a stretch or below a mere title.

A class or id names an element as an advert, menu and so on only as a whole:
each of its words is such a name or says no more than a place or a part
(`sidebar-left`, `site-header`, not `has-sidebar`, `legal-history`). Articles,
main elements, paragraphs and headings are never left out by name.

Defined cases: null or empty html and pages without article text give an empty
string; unclosed elements end with the page; an unclosed script, style or
comment swallows the rest; texts of any length are whole; repeated rows are extracted again; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
# Characters in a window on either side of a few links that make them part of the text: about a sentence.
RUNNING_TEXT = 80

# Elements by what they mean for extraction.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas")
LEFT_OUT = ("head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset")
MAIN = ("article", "main")
BLOCKS = (
    *LEFT_OUT, *MAIN, "html", "body", "div", "section", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl",
    "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure",
    "figcaption", "address", "hr", "br", "center", "details", "summary", "option", "hgroup", "search",
)
VOID = ("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr")
SELF_CLOSING = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
NAMED_OUT = (
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal",
    "overlay", "paywall", "subscribe", "subscription", "newsletter", "signup", "login", "comment", "comments",
    "disqus", "replies", "respond", "sidebar", "side", "rail", "widget", "widgets", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "toolbar", "topbar", "share", "sharing",
    "social", "related", "recommended", "recommendations", "pagination", "pager", "skip", "copyright", "legal",
    "disclaimer",
)
# Words beside a name that leave its meaning as it is, and elements that names never leave out.
PARTS = (
    "site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "upper", "lower", "inner",
    "outer", "post", "entry", "user", "reader", "area", "bar", "block", "box", "button", "buttons", "column", "container",
    "content", "form", "group", "icons", "inline", "item", "items", "links", "list", "panel", "region", "row", "section",
    "slot", "thread", "unit", "wrap", "wrapper",
)
NEVER_BY_NAME = (*MAIN, "p", "h1", "h2", "h3", "h4", "h5", "h6", "html", "body")
ROLES_OUT = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar")

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_RAW, _LEFT_OUT, _MAIN, _BLOCKS, _VOID = map(frozenset, (RAW, LEFT_OUT, MAIN, BLOCKS, VOID))
_SELF_CLOSING, _NAMED_OUT, _ROLES_OUT = map(frozenset, (SELF_CLOSING, NAMED_OUT, ROLES_OUT))
_NAMES_AND_PARTS, _NEVER_BY_NAME = frozenset((*NAMED_OUT, *PARTS)), frozenset(NEVER_BY_NAME)


def _names_no_text(value: str) -> bool:
    """Whether one of the names in a class or id means menus, adverts and the like as a whole."""
    for name in value.lower().split():
        words = _WORD.findall(name)
        if not _NAMED_OUT.isdisjoint(words) and _NAMES_AND_PARTS.issuperset(words):
            return True
    return False


def _is_left_out(tag: str, attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            if tag not in _NEVER_BY_NAME and _names_no_text(value):
                return True
        elif name == "role":
            if value.strip().lower() in _ROLES_OUT:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and _HIDDEN.search(value):
            return True
    return False


class _Lines:
    """Lines of a page with the place each was found in."""

    def __init__(self) -> None:
        self.found: list[tuple[str, bool, bool, bool]] = []  # text, left out, in main, only links of a list
        self._open: list[tuple[str, bool]] = []
        self._out = self._main = self._lists = self._links = 0
        self._text: list[str] = []
        self._plain = False

    def end_line(self) -> None:
        text = " ".join(html.unescape("".join(self._text)).split())
        listed = bool(self._lists) and not self._plain
        if text:
            self.found.append((text, self._out > 0, self._main > 0, listed))
        self._text, self._plain = [], False

    def text(self, piece: str) -> None:
        if piece:
            self._text.append(piece)
            self._plain |= not self._links and not piece.isspace()

    def _count(self, tag: str, out: bool, by: int) -> None:
        self._out += by * out
        self._main += by * (tag in _MAIN and not out)
        self._lists += by * (tag in ("ul", "ol"))
        self._links += by * (tag == "a")

    def _pop(self) -> None:
        self._count(*self._open.pop(), -1)

    def start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            self.end_line()
            while self._open and self._open[-1][0] in ("a", *(_SELF_CLOSING if tag != "br" else ())) and tag != "br":
                self._pop()
        if tag in _VOID or attributes.endswith("/"):
            return
        if tag == "body":
            while any(t == "head" for t, _ in self._open):
                self._pop()
        if tag in _MAIN:  # an article is never part of a menu or header that was left open
            while self._open and self._open[-1][0] in ("nav", "header", "ul", "ol", "menu"):
                self._pop()
        out = tag in _LEFT_OUT or ("=" in attributes or "hidden" in attributes) and tag not in ("html", "body") and _is_left_out(tag, attributes)
        if out or tag in _MAIN or tag in ("ul", "ol", "a") or (tag in _BLOCKS and tag not in _SELF_CLOSING):
            self._open.append((tag, out))
            self._count(tag, out, 1)

    def end(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.end_line()
        if any(t == tag for t, _ in self._open):
            while self._open[-1][0] != tag:
                self._pop()
            self._pop()


def page_lines(page: str) -> list[tuple[str, bool, bool, bool]]:
    lines, at = _Lines(), 0
    while True:
        mark = _MARKUP.search(page, at)
        if mark is None:
            break
        lines.text(page[at : mark.start()])
        at = mark.end()
        if mark[0].startswith("<![CDATA["):
            lines.text(html.escape(mark[0][9:].removesuffix("]]>"), quote=False))
        elif mark[2]:
            tag = mark[2].lower()
            if mark[1]:
                lines.end(tag)
            elif tag in _RAW:
                close = _RAW_END[tag].search(page, at)
                at = close.end() if close else len(page)
            else:
                lines.start(tag, mark[3])
    lines.text(page[at:])
    lines.end_line()
    return lines.found


def main_text(page: str, window: int = WINDOW) -> str:
    lines = page_lines(page)
    framed = any(main and not out for _, out, main, _ in lines)
    counts = [0 if out or (listed and not main) or (framed and not main) else len(text) for text, out, main, listed in lines]
    half = window // 2
    sums = [sum(counts[max(0, i - half) : i + half + 1]) for i in range(len(counts))]
    kept, links, first, between = [], [], 0, False
    for i, ((text, out, _, listed), count, total) in enumerate(zip(lines, counts, sums)):
        if not total:  # a dive
            links, between = [], False
        elif count:
            if links and min(sum(counts[max(0, first - window) : first]), sum(counts[i : i + window])) >= RUNNING_TEXT:
                kept += links
            kept.append(text)
            links, between = [], True
        elif between and listed and not out and not framed:
            first = first if links else i
            links.append(text)
    return " ".join(kept)


def _extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in parts:
        yield pd.Series([main_text(p) for p in pages], dtype=object)


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`."""
    extract = F.pandas_udf(_extract, "string")
    found = pages.select("page_id", "url", extract(F.coalesce("html", F.lit(""))).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
