"""Main text of web pages by two-pass block rules.

A page falls into blocks of text at every block-level tag. First pass: a block is decided by where it stands (a
menu, footer, form or comment list is boilerplate whatever it says), then by its length, its density of stop words
and the share of its characters that are links. Blocks that are too short to tell stay open. Second pass: an open
block inherits from the nearest neighbour that was decided by its own text; a tie is decided for text. On a page with
an article only blocks within it are asked, and what has no such neighbour there is text.

An element is judged by its text before its name: a class name, an id or a form marks boilerplate only if the element
does not hold most of the page's prose; names of adverts, notices and comments always do. Names of whole pages and of
articles say nothing. Where articles hold most of the prose, nothing outside them is text. Links in a row are a menu
wherever they stand, with the heading over them. A header's text is none, an article's own header included. If a page
has no text by these rules (its language has no stop words here), long blocks with few links are text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page.
MUTE = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "title", "textarea", "select", "button"}
#: Elements whose text is boilerplate.
SIDE = {"nav", "footer", "aside", "form", "header", "menu", "dialog"}
#: Those of them that may hold a whole page, as some servers write them.
WRAPS = {"form"}
#: Elements within which open blocks are text, and those that end at them if their own end tag is missing.
MAIN, ENDED = {"article", "main"}, {"nav", "header", "aside", "footer", "menu"}
#: Elements that name what follows them.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "dt", "caption", "legend", "summary"}
#: Elements that end a block. Others (b, i, a, span ...) are part of one.
BREAK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose names and ids aren't asked for hints; of nested articles they are, as comments are written so.
WHOLE = {"html", "body", "main", "article"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark boilerplate.
HINTS = {
    *"ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices newsletter subscribe".split(),
    *"popup modal overlay sidebar breadcrumb breadcrumbs menu menubar navbar navigation nav footer toolbar share sharing social related recommended".split(),
    *"comment comments disqus replies reply respond search login signup pagination pager widget complementary contentinfo alert dialog".split(),
}
#: Those of them that no layout is named after: adverts, notices and what readers wrote.
FIRM = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices newsletter "
    "subscribe popup modal overlay comment comments disqus replies reply respond alert dialog".split()
)
#: Frequent words of the languages that pages come in; fixed values.
STOP = frozenset(
    "a an and are as at be by for from has he in is it of on or that the this to was were will with not but they "
    "le la les de des du et en un une est que qui dans pour par sur au aux avec pas ce il elle ne se ou "
    "der die das und ist im in zu den dem des mit von auf für eine ein nicht als auch es an sich "
    "el los las del y que en un una por con para su al lo como es se no más o".split()
)
#: Shorter blocks are open; so are those without enough stop words. Longer ones may hold so many links.
SHORT, STOP_SHARE, LINK_SHARE = 60, 0.12, 0.33
#: What the last line of a page says about rights.
_RIGHTS = re.compile(r"©|\(c\) *\d{4}|\bcopyright +\d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.I)
_SPACE = " \t\n\r\x0b\x0c"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def hinted(attributes: str, hints: set[str] = HINTS) -> bool:
    """Whether a class, id or role has a word that marks boilerplate."""
    for m in _ATTR.finditer(attributes):
        if not hints.isdisjoint(_WORD.findall((m[1] or m[2] or m[3] or "").lower())):
            return True
    return False


class Block(NamedTuple):
    """A non-empty block: its text, its characters in links, whether its place makes it boilerplate, the named elements
    that would (by number), whether it lies within an article, and whether it is a heading."""

    text: str
    linked: int
    side: bool
    named: tuple[int, ...]
    main: bool
    heading: bool


def blocks(html: str) -> list[Block]:
    """The blocks of a page, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked, at, end = 0, 0, len(html)
    stack: list[tuple[str, bool, int]] = []  # open elements that count: name, boilerplate for sure, number if by its name
    opened: dict[str, int] = {}
    unclosed: set[str] = set()
    tags: dict[str, list[list[int]]] = {}
    side = main = link = heading = numbers = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, side > 0, tuple(n for _, _, n in stack if n), main > 0, heading > 0))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if link:
                linked += len(raw.strip(_SPACE))

    def leave() -> str:
        nonlocal side, main, heading
        name, sure, _ = stack.pop()
        opened[name] -= 1
        side -= sure
        main -= name in MAIN
        heading -= name in HEADINGS
        return name

    def ending(name: str) -> int:
        """Where a mute element that begins here ends; without an end tag only code goes on to the page's end."""
        if name not in unclosed:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if stop:
                return stop.end()
            unclosed.add(name)
        return end if name in ("script", "style") else at

    def left_open(name: str) -> bool:
        """Whether fewer elements of a name end from here on than begin, besides the open ones."""
        if name not in tags:
            tags[name] = [[m.start() for m in re.finditer(rf"<{mark}{name}\b", html, re.I)] for mark in ("", "/")]
        begins, ends = (len(x) - bisect_left(x, at) for x in tags[name])
        return ends < begins + opened[name]

    while at < end:
        m = _TAG.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in MUTE and not closing:
            if name in ("script", "style") or not m[3].endswith("/"):
                at = ending(name)
            if name in ("textarea", "select", "button"):
                close()
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name in BREAK:
            close()
            link = link if not closing or name in ("br", "hr") else 0
        if name in VOID:
            continue
        if closing:
            while opened.get(name):
                if leave() == name:
                    break
            continue
        if name in BREAK and stack and stack[-1][0] in ("p", "li") and (stack[-1][0] == "p" or name == "li"):
            leave()  # its end tag may be left out
        if name in MAIN:
            while stack and stack[-1][0] in ENDED and left_open(stack[-1][0]):
                leave()
        asked = "=" in m[3] and (name not in WHOLE or (name == "article" and main))
        sure = (name in SIDE and name not in WRAPS) or (asked and hinted(m[3], FIRM))
        by_name = not sure and (name in WRAPS or (asked and hinted(m[3])))
        if not sure and not by_name and name not in MAIN and name not in HEADINGS and not opened.get(name):
            continue  # nothing hangs on where it ends
        numbers += by_name
        stack.append((name, sure, numbers if by_name else 0))
        opened[name] = opened.get(name, 0) + 1
        side += sure
        main += name in MAIN
        heading += name in HEADINGS
    close()
    return out


def is_prose(text: str) -> bool:
    """Whether a text is long and has the stop words of running text."""
    words = text.lower().split()
    return len(text) >= SHORT and sum(w.strip(".,;:!?") in STOP for w in words) >= STOP_SHARE * len(words)


def is_links(b: Block) -> bool:
    return b.linked > LINK_SHARE * len(b.text)


def placed(found: list[Block], prose: list[bool]) -> list[bool]:
    """Whether each block is boilerplate by its place or by the name of an element that doesn't hold most of the prose."""
    weight = [len(b.text) if p and not b.side and not is_links(b) else 0 for b, p in zip(found, prose)]
    held: dict[int, int] = {}
    for b, w in zip(found, weight):
        for n in b.named:
            held[n] = held.get(n, 0) + w
    most = sum(weight)
    return [b.side or any(2 * held[n] <= most for n in b.named) for b in found]


def nearest(own: list[bool | None]) -> list[bool | None]:
    """The label of the nearest decided block of each, itself included; of two as near, True if one is; else None."""
    best: list[tuple[int, bool] | None] = [None] * len(own)
    for order in (range(len(own)), range(len(own) - 1, -1, -1)):
        last: tuple[int, bool] | None = None
        for k in order:
            if own[k] is not None:
                last = (k, own[k])
            if last:
                far = (abs(k - last[0]), not last[1])
                best[k] = far if best[k] is None else min(best[k], far)
    return [b and not b[1] for b in best]


def verdicts(found: list[Block], lenient: bool = False) -> list[bool]:
    """Whether each block is main text; `lenient`: long blocks with few links are, whatever their words."""
    prose = [is_prose(b.text) or (lenient and len(b.text) >= SHORT) for b in found]
    side = placed(found, prose)
    links = [is_links(b) for b in found]
    inside = [0 if s or k or not p else len(b.text) for b, p, s, k in zip(found, prose, side, links)]
    article = any(b.main for b in found)
    # an article that is but a part of the prose, such as a teaser, says nothing about the rest
    gated = article and 2 * sum(n for b, n in zip(found, inside) if b.main) >= sum(inside)

    def first(k: int) -> bool | None:
        """First pass: whether a block is main text, or None if it is open."""
        b = found[k]
        if side[k] or (gated and not b.main) or (not b.main and len(b.text) < 2 * SHORT and _RIGHTS.search(b.text)):
            return False
        row = any(links[j] and not side[j] for j in (k - 1, k + 1) if 0 <= j < len(found))
        if links[k]:
            return None if prose[k] and b.main and not row else False  # an article's sentence may be a link, a row of them is a menu
        if b.heading and k + 2 < len(found) and links[k + 1] and links[k + 2]:
            return False
        return True if prose[k] else None

    own = [first(k) for k in range(len(found))]
    # who is asked: blocks that their own text decided, on a page with an article those within it
    near = nearest([v if not s and b.main >= gated else None for v, s, b in zip(own, side, found)])
    return [(b.main if n is None else n and b.main >= gated) if v is None else v for v, n, b in zip(own, near, found)]


def main_text(html: str | None) -> str:
    """The blocks of main text in page order, joined by one space."""
    found = blocks(html or "")
    kept = verdicts(found)
    if not any(kept):
        kept = verdicts(found, True)
    return " ".join(b.text for b, v in zip(found, kept) if v)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page, from its whole html.

    A null or empty page has an empty text, and so has one that is boilerplate throughout. Very long pages are read
    whole, unclosed elements do no harm but for scripts and styles, which then reach to the page's end. White space within a block
    is one space, character references are decoded, blocks are joined by one space. Null ids and addresses are kept,
    repeated rows extracted each; other columns are not read; an empty table gives none. No shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string")
