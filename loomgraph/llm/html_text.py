"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass judges each block by where it stands,
its length, the share of its characters inside links and the share of stop words; short blocks and
those in between stay open. In the second pass these take the judgement of their nearest decided
neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import pieces

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>script|style|noscript|template|svg|math|iframe|object|select|textarea|title|canvas)\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<[/!?a-zA-Z](?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>|<[/!?a-zA-Z][^<>]*+>?",
    re.S | re.I,
)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s>/])|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^a-z0-9]+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
WRAPPERS = frozenset("div section center table tbody tr td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and names (class, id or role, whole or as an end part) of what surrounds an article.
FRAME_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo masthead complementary search dialog alert "
    "share sharing social related recommended widget toolbar pagination pager skip toc comment comments disqus reply replies respond feedback".split()
)
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond feedback".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts before a name, and last parts of one, that tell how a wrapper is set, not what it holds.
LACKS = frozenset("has no with without not is hide show".split())
STATES = frozenset("on off open opened closed enabled disabled active inactive visible hidden none accepted dismissed".split())
#: Frequent function words of the four languages.
STOP = frozenset(
    "the of and to in is was that it for as with on by be are this from at or an a not but have he his they which you "
    "der die das und ist in zu den von mit für auf ein eine dem des sich nicht auch als an es im wie so "
    "le la les des et est en un une du que qui dans pour pas sur au avec ce il par plus ne se "
    "el los las y que se del por con para una su lo como más o pero sus al de".split()
)


@dataclass
class Block:
    text: str
    linked: int
    frame: bool
    article: int
    verdict: bool | None = None
    listed: bool = False
    links: int = 0


class _Element:
    """wrapper: the plain element whose name alone makes this a frame, which an article inside can lift."""

    __slots__ = ("tag", "frame", "article", "link", "listed", "wrapper", "lifted")

    def __init__(self, tag: str, frame: bool, article: int, link: bool, listed: bool = False, wrapper: "_Element | None" = None):
        self.tag, self.frame, self.article, self.link, self.listed, self.wrapper, self.lifted = tag, frame, article, link, listed, wrapper, False


def _frames(tag: str, token: str, inside: bool) -> bool:
    """Whether an element starts a part that is not the article, by its tag or names.

    A name counts whole or at either end of a class, id or role (comment-list, site-footer), but not in what tells how a
    wrapper is set (has-sidebar, cookie-consent-off). A heading belongs to the text around it.
    """
    if tag in ("html", "body", "main"):
        return False
    if tag in FRAME_TAGS or tag == "header" and not inside or _HIDDEN.search(token):
        return True
    if tag in HEADINGS or "=" not in token:
        return False
    wanted = COMMENT_NAMES if tag == "article" else FRAME_NAMES
    for m in _NAMES.finditer(token):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [p for p in _PARTS.split(name) if p]
            if parts and (parts[0] in wanted or parts[-1] in wanted) and parts[-1] not in STATES and LACKS.isdisjoint(parts):
                return True
    return False


def blocks(html: str) -> list[Block]:
    """Blocks with text, in page order. Unclosed, misnested and cut off markup is taken as far as it goes."""
    out: list[Block] = []
    stack = [_Element("", False, 0, False)]
    parts: list[str] = []
    linked = links = articles = 0
    open_article = False
    begin = stack[0]

    def close():
        nonlocal linked, links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, begin.frame, begin.article, listed=begin.listed, links=links))
            parts.clear()
        linked = links = 0

    def text(piece: str):
        nonlocal linked, begin
        if piece:
            if not parts:
                begin = stack[-1]
            parts.append(piece)
            if stack[-1].link:
                linked += len("".join(unescape(piece).split()))

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        token = m[0]
        named = _NAME.match(token)
        if m["silent"] or not named:
            continue
        tag = named[1].lower()
        if token[1] == "/":
            if tag not in INLINE:
                close()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # an inline end tag reaches no further than its block
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                close()
            continue
        if tag not in INLINE:
            close()
            while len(stack) > 1 and stack[-1].tag in INLINE:
                stack.pop()
            if tag in ("article", "main"):  # an unclosed menu doesn't swallow the article
                for i in range(1, len(stack)):
                    if stack[i].tag in ("nav", "header", "footer", "aside", "form", "ul", "ol"):
                        del stack[i:]
                        break
            elif stack[-1].tag == tag and tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                stack.pop()
        top = stack[-1]
        article = top.article
        if tag in ("article", "main") and not article:
            articles += 1
            article = articles
        if tag == "a":
            links += 1
        own = tag not in INLINE and _frames(tag, token, article > 0)
        element = _Element(tag, top.frame or own, article, top.link or tag == "a", top.listed or tag in ("ul", "ol", "dl", "menu"), top.wrapper)
        if own and not top.frame and tag in WRAPPERS and not _HIDDEN.search(token) and not _frames("article", token, True):
            element.wrapper = element
        elif own:
            element.wrapper = None
        if tag in ("article", "main"):
            # the first article on a page, and others beside it, stand in a layout wrapper, not in what its name says
            if top.frame and not own and element.wrapper and (element.wrapper.lifted or not open_article):
                element.wrapper.lifted = True
                element.frame, element.wrapper = False, None
            open_article |= not element.frame
        stack.append(element)
    text(html[at:])
    close()
    return out


def judged(found: list[Block], short: int = 70, long: int = 200, links: float = 0.4, stop: float = 0.1) -> list[Block]:
    """Set the verdict of every block (True: main text).

    First pass: parts around the article are out, and so is all that stands outside where the page marks an
    article with text. Else link density over ``links`` is out, in a marked article only for lists of links; from ``long`` characters on, or in a marked article
    from ``short`` on, a block is in if its share of stop words is ``stop`` at least; other blocks stay
    open. Second pass: an open block is in if its nearest decided neighbours (of the same part of the page) are,
    if one of them is and the block isn't short or stands in a marked article, and if there are none.
    """
    marked = any(b.article and not b.frame for b in found)
    for b in found:
        if b.frame or marked and not b.article:
            b.verdict = False
            continue
        n = len(b.text)
        size = len(b.text.replace(" ", ""))
        dense = b.linked > links * size and (not b.article or b.listed or b.links > 2 and b.linked > 0.9 * size)
        if dense or b.text.startswith("©"):
            b.verdict = None if b.article and n < short else False
            continue
        words = _WORDS.findall(b.text.lower())
        density = sum(w in STOP for w in words) / max(1, len(words))
        if n >= (short if b.article else long) and density >= stop:
            b.verdict = True
        elif n >= long and not b.article and density < stop / 2:
            b.verdict = False
    for article in {b.article for b in found}:
        group = [b for b in found if b.article == article and not b.frame]
        first = [b.verdict for b in group]
        # beyond the ends of a page without a marked article stands what is no text, unless nothing is decided at all
        edge = None if article or all(v is None for v in first) else False
        before: list[bool | None] = []
        last = edge
        for v in first:
            before.append(last)
            last = v if v is not None else last
        last = edge
        for i in range(len(group) - 1, -1, -1):
            if first[i] is None:
                sides = {x for x in (before[i], last) if x is not None}
                group[i].verdict = not sides or sides == {True} or len(sides) == 2 and (bool(article) or len(group[i].text) >= short)
            else:
                last = first[i]
    return found


def main_text(html: str) -> str:
    return "\n".join(b.text for b in judged(blocks(html)) if b.verdict)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; a null html counts as empty and has no text.

    Rows that repeat stay; other columns are left aside; nothing is cut at any length.
    """
    source = pages.select("page_id", F.col("url"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                found = [main_text(h) for h in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
