"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line weighs as many characters as it has outside links, times
a factor for where it stands: nothing in elements that HTML itself sets apart (menus, page headers, footers, asides, forms)
or hides, next to nothing under names that say only such things (`site-footer`, `comment-list`), half under names that
mention one (`header-text`), more inside an article. The weights of a sliding window of lines are summed. Text surges at a heading
or a line of some length where a window's sum passes a threshold, and dives where the sum falls below half of it. What stands between
is kept, and so are the other lines of its container, the box that holds it: the article or main element, or else the nearest
div, section, list or table. Only lines of no or next to no factor stay out, and links at the ends of a container other than an article. No tag
decides by itself that a page's text is here or there, so that pages with and without an article element are read alike.
"""

from __future__ import annotations

import functools
import html
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
SURGE = 80  # characters in a window; less on pages that have no such window
NAMED, MENTIONED, ARTICLE = 0.05, 0.5, 1.5  # factors

# One scan: possessive groups that can't give back, so that no text is read twice.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|style|aria-hidden|hidden)\b(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?+""", re.I)
_PIECES, _HIDDEN = re.compile("[^a-z0-9]+"), re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden")
_NOT, _WHOLE = {"has", "no", "with", "without"}, {"article", "main"}
_RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas", "math")}
_ENDLESS = {"script", "style", "textarea", "title"}  # without an end they go on to the end of the page
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_APART = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "head"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_BOXES = {"html", "body", "article", "main", "section", "div", "ul", "ol", "dl", "table", "td", "th", "blockquote", "fieldset", "figure", "details", "center"}
_SAYS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "form", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted",
    "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
_BESIDE = {"area", "bar", "block", "body", "bottom", "box", "buttons", "container", "content", "global", "group", "inner", "item", "items", "left", "links", "list", "main", "page", "right", "section", "site", "thread", "top", "wrap", "wrapper"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class Line(NamedTuple):
    text: str
    factor: float
    container: int  # number of the box that holds it
    heading: bool
    links: int  # characters inside links
    fixed: bool  # in an article or main element


class _Open(NamedTuple):
    tag: str
    factor: float
    container: int
    heading: bool
    fixed: bool  # in an article or main element, which is the container of all inside
    link: bool


@functools.lru_cache(1 << 12)
def _named(value: str) -> float:
    """The factor of a class or id."""
    out = 1.0
    for one in value.split():
        pieces = [x.rstrip("0123456789") or x for x in _PIECES.split(one) if x]
        words = []
        for k, w in enumerate(pieces):
            # `no-sidebar`, `ad-free`: names that say what isn't there
            if (k and pieces[k - 1] in _NOT) or (k + 1 < len(pieces) and pieces[k + 1] == "free") or w in _NOT or w == "free" or not w.isalpha():
                continue
            words.append(w)
        says = [w for w in words if w in _SAYS]
        if says:
            out = min(out, NAMED if all(w in _SAYS or w in _BESIDE for w in words) else MENTIONED)
    return out


def _factor(tag: str, attrs: str, inside: bool) -> float:
    """How much of a line's weight an element leaves. Inside an article only boxes are judged by their names, and the article itself never is."""
    if tag in _APART or tag == "header" and not inside:
        return 0.0
    out = 1.0
    by_name = tag not in _WHOLE and (not inside or tag in _BOXES)
    for name, value in _ATTR.findall(attrs) if attrs and tag not in ("html", "body") else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES or name == "style" and _HIDDEN.search(value):
            return 0.0
        if name in ("class", "id") and by_name:
            out = min(out, _named(value) if len(value) < 200 else _named.__wrapped__(value))
    return out


def lines(page: str) -> list[Line]:
    """The block elements of a page that have text, in order. Time is linear in the page, whatever its markup."""
    out: list[Line] = []
    root = _Open("", 1.0, 0, False, False, False)
    stack, blocks, count = [root], [0], {}  # blocks: places of elements that are not inline
    held: list[str] = []
    links = boxes = at = 0
    endless: set[str] = set()
    last = page.rfind(">")

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            top = stack[-1]
            out.append(Line(text, top.factor, top.container, top.heading, min(links, len(text)), top.fixed))
        links = 0

    def close(k: int) -> None:
        if blocks[-1] >= k:
            flush()
        while blocks[-1] >= k:
            blocks.pop()
        for e in stack[k:]:
            count[e.tag] -= 1
        del stack[k:]

    def take(end: int) -> None:
        nonlocal links
        held.append(page[at:end])
        if stack[-1].link:
            links += end - at

    while 0 <= (lt := page.find("<", at)) < last:
        m = None
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            after = end + 3 if end >= 0 else len(page)
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            after = end + 3 if end >= 0 else len(page)
        elif page.startswith(("<!", "<?"), lt):
            after = page.find(">", lt) + 1
        elif m := _TAG.match(page, lt):
            after = m.end()
        else:  # no tag
            take(lt + 1)
            at = lt + 1
            continue
        take(lt)
        at = after
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if count.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            elif tag not in _INLINE:
                flush()
            continue
        if tag in _RAW and tag not in endless:
            end = _RAW[tag].search(page, at)
            if end or tag in _ENDLESS:
                at = end.end() if end else len(page)
                held.append(" ")
                continue
            endless.add(tag)
        if tag in _VOID:
            if tag in ("br", "hr"):
                held.append(" ")
            continue
        if tag in _INLINE:
            if not m[3].rstrip().endswith("/"):
                top = stack[-1]
                own = top.factor * _factor(tag, m[3], top.fixed) if m[3] else top.factor
                stack.append(top._replace(tag=tag, factor=min(top.factor, own), link=top.link or tag == "a"))
                count[tag] = count.get(tag, 0) + 1
            continue
        flush()
        if stack[blocks[-1]].tag in _CLOSES.get(tag, ()) or tag in _BLOCK_ENDS_P and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        top = stack[-1]
        factor, container, fixed = top.factor * _factor(tag, m[3], top.fixed), top.container, top.fixed
        if tag in _BOXES and not fixed:
            boxes += 1
            container = boxes
            if tag in ("article", "main"):
                fixed = True
                factor *= ARTICLE
        blocks.append(len(stack))
        stack.append(_Open(tag, factor, container, top.heading or re.fullmatch("h[1-6]", tag) is not None, fixed, top.link))
        count[tag] = count.get(tag, 0) + 1
    take(len(page))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The text between surges and dives and of their containers, blocks joined by one space; empty for null pages and pages without any."""
    blocks = lines(page or "")
    n = len(blocks)
    good = [b.factor > NAMED * ARTICLE for b in blocks]
    # In an article links count half; outside they are no text.
    weight = [(len(b.text) - (b.links / 2 if b.fixed else b.links)) * b.factor if g else 0.0 for b, g in zip(blocks, good, strict=True)]
    sums = [sum(weight[i : i + WINDOW]) for i in range(n)]
    need = min(SURGE, max(sums, default=0))
    if not need:
        return ""
    kept = [False] * n
    i = 0
    while i < n:
        if not weight[i] or sums[i] < need or not (blocks[i].heading or WINDOW * weight[i] >= need):
            i += 1
            continue
        while i < n and sums[i] >= need / 2:  # until the dive
            kept[i] = good[i]
            i += 1
    # A gap shorter than a window between two pieces of text is no dive.
    at = [i for i in range(n) if kept[i]]
    for i, j in zip(at, at[1:], strict=False):
        for g in range(i + 1, j if j - i <= WINDOW else i + 1):
            kept[g] = good[g] and weight[g] > 0
    # A container's other lines belong to its text; outside articles, links only between its lines or as headings.
    ends: dict[int, list[int]] = {}
    for i in range(n):
        if kept[i] and weight[i]:
            ends.setdefault(blocks[i].container, [i, i])[1] = i
    for i in range(n):
        span = ends.get(blocks[i].container)
        if span and good[i] and (weight[i] or blocks[i].heading or span[0] < i < span[1]):
            kept[i] = True
    return " ".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` and `text`, one row for each row of `pages`. One pass, no shuffle.

    Null and empty pages, and pages without text, give the empty string; repeated rows give repeated results. A page of any
    length and markup takes time in proportion to its length, and a task holds it whole. Null `keep` columns stay null;
    other columns are ignored, whatever their names. An empty table gives an empty one.
    """

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns=["__sx_html"]).assign(text=pd.Series([main_text(x) for x in pdf["__sx_html"]], dtype=object, index=pdf.index))

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return pages.select(*keep, F.col(html_col).alias("__sx_html")).mapInPandas(run, f"{schema}, text string")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page, with its length in code points. Awkward rows: see extract."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
