"""Main text of web pages by line-block distribution.

A page's markup is stripped to lines, one a block element. Lines of menus, adverts
and the like, and lines that are mostly links, weigh nothing; every other line weighs
its length. The sums over sliding windows of lines rise from nothing (surge) where a
stretch of text starts and fall to nothing (dive) where it ends. The heaviest
stretch is the article; other stretches are kept if they lie in the same outermost article
element or container, or are themselves heavy. All text between a kept surge and dive stays,
in an article element all between the first surge and the last dive.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements and words of class, id and role attributes.
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg math object select canvas audio video title".split())
_NEVER = frozenset("head button label input select option menu dialog".split())
_ASIDE = frozenset("nav header footer aside form".split())
_HINTS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert
    nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside widget related recommended
    comment comments commentlist disqus reply replies respond discussion share sharing social follow newsletter subscribe signup login popup
    modal overlay search toolbar pagination pager copyright legal disclaimer skip contentinfo complementary toc paywall teaser""".split())  # fmt: skip
_KEEP = frozenset("article main articlebody".split())
_CONTAINERS = frozenset("article body div html main section td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Quotes enclose a value only after an equals sign; one that is never closed ends the tag at the next >, and only the
# last quote of a page can be such a one, so any page costs linear time however long its attributes are.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_CLOSES_P = _BLOCKS - {"body", "html", "title", "option"}

#: Lines of a window on each side of its middle, and empty lines that stand for a stretch left out.
REACH, GAP = 1, 3
#: A stretch outside the article is kept if it weighs this share of the article's, and so many characters.
SHARE, LEAST = 0.35, 120
#: A line with more than this share of its characters in links weighs nothing.
LINKED = 0.5
#: A hint that would leave out more than this share of the page's text is taken as a mistake.
TOO_MUCH = 0.6


@dataclass
class Line:
    text: str
    linked: int
    #: Number of the innermost element left out that holds the line, or -1, and whether the line is a heading.
    out: int
    heading: bool
    article: int
    parent: int
    weight: int = 0


@dataclass
class LeftOut:
    """An element that is left out: the one around it, whether its name says so (else an attribute),
    whether it is the header of an article, and whether an article starts in it."""

    around: int
    named: bool
    title: bool
    holds: bool = False


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    left: list[LeftOut] = field(default_factory=list)


@dataclass
class Open:
    """An open element, with what it has from those around it, so that no line walks up the page."""

    name: str
    number: int
    #: Innermost element left out, outermost article (below body, if any), innermost container, headings open.
    left: int
    article: int
    whole: int
    container: int
    headings: int
    #: Place among the open elements of the innermost block or paragraph.
    block: int


def _attributes(raw: str) -> tuple[set[str], bool]:
    """Words of class, id, role and itemprop; whether the element is hidden."""
    words, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        else:
            words.update(re.findall(r"[a-z]+", value))
    return words, hidden


def parse(source: str) -> Page:
    """Lines of a page in order, each with its links' length and what encloses it."""
    page = Page()
    top = Open("", 0, -1, 0, 0, 0, 0, -1)
    stack: list[Open] = []
    named: Counter = Counter()  # open elements of each name
    parts: dict[tuple[int, str], int] = {}  # article of the elements of one name and parent whose attributes mark them
    text: list[str] = []
    linked = articles = containers = elements = 0

    def end_line() -> None:
        nonlocal linked
        if text:
            s = " ".join(_html.unescape("".join(text)).split())
            if s:
                x = stack[-1] if stack else top
                # the outermost article; a page marked as a whole counts where nothing in it is
                page.lines.append(Line(s, linked, x.left, x.headings > 0, x.article or x.whole, x.container))
        text.clear()
        linked = 0

    def close(i: int) -> None:
        """End the elements from the i-th open one on."""
        for x in stack[i:]:
            named[x.name] -= 1
        del stack[i:]

    at, final = 0, source.rfind(">")  # no tag starts after the last >
    while at < len(source):
        lt = source.find("<", at)
        if lt < 0:
            lt = len(source)
        if lt > at:
            text.append(source[at:lt])
            if named["a"]:
                linked += len(" ".join(_html.unescape(source[at:lt]).split()))
        if lt == len(source):
            break
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = len(source) if end < 0 else end + 3
            continue
        m = _TAG.match(source, lt) if lt < final else None
        if not m:
            if source[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = source.find(">", lt)
                at = len(source) if end < 0 else end + 1
            else:
                text.append("<")
                at = lt + 1
            continue
        at = m.end()
        ends, name, raw = m[1], m[2].lower(), m[3]
        if name == "br" or name in ("td", "th"):
            text.append(" ")
        if ends:
            if name in _BLOCKS:
                end_line()
            if named[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name))
            continue
        if name in _RAW:
            if name == "title":
                end_line()
            if not raw.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = len(source) if not end else end.end()
            continue
        if name in _BLOCKS:
            end_line()
        if name in _CLOSES_P and stack and stack[-1].block >= 0 and stack[stack[-1].block].name == "p":
            close(stack[-1].block)
        if name in ("li", "option") and stack and stack[-1].name == name:
            close(len(stack) - 1)
        if name in _VOID or raw.endswith("/") and name not in _BLOCKS:
            continue
        words, hidden = _attributes(raw) if raw.strip() else (set(), False)
        around = stack[-1] if stack else top
        left, article = around.left, 0
        if name in ("article", "main") or words & _KEEP and not words & _HINTS:
            articles += 1
            article = articles if name in ("article", "main") else parts.setdefault((around.number, name), articles)
            if left >= 0:
                page.left[left].holds = True
        by_name = name in _NEVER or name in _ASIDE or hidden
        if by_name or not article and name not in ("html", "body") and words & _HINTS:
            page.left.append(LeftOut(left, by_name, name == "header" and bool(around.article or around.whole)))
            left = len(page.left) - 1
        containers += name in _CONTAINERS
        elements += 1
        of_page = name in ("html", "body")
        stack.append(Open(
            name, elements, left, around.article or (0 if of_page else article), around.whole or article,
            containers if name in _CONTAINERS else around.container, around.headings + (name in _HEADINGS), len(stack) if name in _BLOCKS else around.block,
        ))
        named[name] += 1
    end_line()
    return page


def weigh(page: Page) -> None:
    """Give each line its weight; cancel elements left out that hold the article or nearly all text.

    A heading in the header of an article is kept. An element's number is above that of the one around it, so
    sums go up, and verdicts down, in one pass each.
    """
    total = sum(len(x.text) for x in page.lines) or 1
    left = page.left
    mass = [0] * len(left)  # text in each, headings in an article's header aside
    headed = [0] * len(left)  # headings' text in each
    for x in page.lines:
        if x.out >= 0:
            (headed if x.heading else mass)[x.out] += len(x.text)
    for k in range(len(left) - 1, -1, -1):
        around = left[k].around
        if around >= 0:
            mass[around] += mass[k]
            headed[around] += headed[k]
            left[around].holds |= left[k].holds
    stands = [not (e.holds or mass[k] + (0 if e.title else headed[k]) > TOO_MUCH * total and not e.named) for k, e in enumerate(left)]
    plain, heading = [False] * len(left), [False] * len(left)  # whether a line, and whether a heading, is left out here
    for k, e in enumerate(left):
        plain[k] = stands[k] or e.around >= 0 and plain[e.around]
        heading[k] = stands[k] and not e.title or e.around >= 0 and heading[e.around]
    for x in page.lines:
        gone = x.out >= 0 and (heading if x.heading else plain)[x.out]
        x.out = 1 if gone else -1
        x.weight = 0 if gone or x.linked > LINKED * len(x.text) else len(x.text)


def stretches(page: Page) -> list[list[Line]]:
    """Lines between each surge and the next dive of the window sums, in an article between its first surge and last dive."""
    row: list[Line | None] = []
    before: Line | None = None
    for x in page.lines:
        if before is not None and (x.article != before.article or x.out != before.out):
            row += [None] * GAP
        row.append(x)
        before = x
    weight = [0 if x is None else x.weight for x in row]
    sums = [sum(weight[max(0, i - REACH) : i + REACH + 1]) for i in range(len(row))]
    found: list[list[Line]] = []
    inside = False
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, (x, s) in enumerate(zip(row, sums, strict=True)):
        if s and x is not None and x.article:
            first.setdefault(x.article, i)
            last[x.article] = i
    for i, (x, s) in enumerate(zip(row, sums, strict=True)):
        on = bool(s) or x is not None and x.article in first and first[x.article] <= i <= last[x.article]
        if on and not inside:
            found.append([])
        inside = on
        if inside and x is not None and x.out < 0 and (x.weight or x.article):
            found[-1].append(x)
    return [x for x in found if x]


def main_text(source: str | None) -> str:
    """The page's main text, blocks joined by line breaks; empty if there is none. Null counts as empty."""
    page = parse(source or "")
    weigh(page)
    parts = stretches(page)
    if not parts:
        return ""
    mass = [sum(x.weight for x in p) for p in parts]
    best = max(range(len(parts)), key=lambda i: (bool(parts[i][0].article), mass[i]))
    article, parents = parts[best][0].article, {x.parent for x in parts[best] if x.weight}
    kept = [p for i, p in enumerate(parts) if i == best or (p[0].article == article if article else parents & {x.parent for x in p if x.weight} or mass[i] >= max(LEAST, SHARE * mass[best]))]
    return "\n".join(x.text for p in kept for x in p)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points). Every page comes back, repeated rows too; only the whole html is read."""

    def run(batches):
        for b in batches:
            out = [main_text(b.column("html")[i].as_py()) for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
