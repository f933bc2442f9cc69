"""Operator 5, HTML extraction by line-block distribution.

A page becomes lines, one per block element, with references decoded and white
space collapsed.  Lines inside boilerplate elements (menus, headers, footers,
sidebars, forms, adverts, notices, comments) weigh nothing; other lines weigh
their length outside links.  The weights of ``WINDOW`` neighbouring lines are
summed; text surges where the sum rises over a threshold and dives where it
falls to nothing.  Weighing lines between a surge and its dive are kept, in
page order.

A class, id or role does not mark a wrapper: on a page with no unmarked article
or main part, an element that holds one with more text than all that is
unmarked, or else most of the page's text outside links.

Where a page names its article or main part, tags change weights and nothing
else: lines inside count twice outside links and once inside them, and lines
outside count for one in ``OUTSIDE``.  If more text lies outside, as with
teasers that are articles, lines outside count in full and links never.  Text
dives at the border of the part, and boilerplate in the part does not part it.

The threshold is ``SURGE`` characters, or less on a page whose largest sum is
small, so short articles are kept.  Null or empty html gives empty text; broken
markup is read to its end; equal rows give equal results; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm.spark_tools import documents, tidied

WINDOW, SURGE, OUTSIDE = 3, 86, 4

_STOP = re.compile(r">|=\s*[\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

#: Contents that are never text, and their ends.
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style title textarea noscript template iframe noembed noframes xmp".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select option svg canvas object audio video map figure-menu fieldset".split())
ARTICLE = frozenset("article main".split())
#: Words of class, id and role names that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion notice notices cookie cookies consent gdpr alert"
    " nav navbar navigation menu menus breadcrumb breadcrumbs header footer sidebar aside widget toolbar topbar masthead pagination pager"
    " comment comments discussion disqus respond replies share sharing social related recommended newsletter subscribe subscription signup login"
    " popup modal overlay search copyright legal contentinfo complementary dialog".split()
)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def _marked(attributes: str) -> bool:
    for found in _ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        if any(x.lower() in MARKS for x in _SPLIT.split(found[1] or found[2] or found[3] or "")):
            return True
    return False


def _hidden(attributes: str) -> bool:
    return ("=" in attributes or "hidden" in attributes.lower()) and bool(_HIDDEN.search(attributes))


def _tags(page: str, skip: list[int]) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag from ``skip[0]`` on; comments and declarations have no name.

    Linear: a tag ends at the first ``>`` outside quoted values.  Once a value
    has no end in the page, quotes count no more.  Where no ``>`` follows, the
    last tag is cut off and goes; a lone ``<`` elsewhere is text.
    """
    size, last, quotes, at = len(page), page.rfind(">"), True, 0
    while (i := page.find("<", max(at, skip[0]))) >= 0:
        at = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = size if end < 0 else end + 3
            yield i, at, False, "", ""
        elif page[at : at + 1] in ("!", "?"):
            at = size if i > last else page.find(">", at) + 1
            yield i, at, False, "", ""
        elif name := _NAME.match(page, at + (page[at : at + 1] == "/")):
            if i > last:
                dropped = re.compile("<[!?]").search(page, at)
                cut = page.rfind("<")
                if dropped:
                    yield dropped.start(), size, False, "", ""
                elif _NAME.match(page, cut + 1 + (page[cut + 1 : cut + 2] == "/")) or cut == size - 1:
                    yield cut, size, False, "", ""
                return
            end, j = 0, at
            while quotes and not end:
                stop = _STOP.search(page, j)
                j = 0 if stop is None else stop.end() if stop[0] == ">" else page.find(stop[0][-1], stop.end()) + 1
                if not j:
                    quotes = False
                elif stop[0] == ">":
                    end = j
            end = end or page.find(">", at) + 1
            attributes = page[min(name.end(), end - 1) : end - 1]
            yield i, end, page[at] == "/", name[0], attributes
            at = end
        elif at == size:
            yield i, size, False, "", ""


def _openers(lines: list[tuple[str, int, bool, bool, int]], parent: list[int]) -> set[int]:
    """Marked elements that hold the page's article or most of its text, outer ones first; 0 is the page.

    ``parent`` has the next outer marked element of each.
    """
    n = len(parent)
    own, own_in, article = [0] * n, [0] * n, [False] * n
    for text, free, bad, inside, mark in lines:
        if not bad:
            own[mark] += free
            own_in[mark] += len(text) if inside else 0
            article[mark] |= inside
    held, held_in, within = own[:], own_in[:], [[] for _ in range(n)]
    for mark in range(n - 1, 0, -1):
        held[parent[mark]] += held[mark]
        held_in[parent[mark]] += held_in[mark]
        within[parent[mark]].append(mark)
    opened, plain, now, by_text, by_article = {0}, 0, 0, [], []
    while not article[now]:
        plain += own[now]
        for mark in within[now]:
            heapq.heappush(by_text, (-held[mark], mark))
            heapq.heappush(by_article, (-held_in[mark], mark))
        for heap in (by_text, by_article):
            while heap and heap[0][1] in opened:
                heapq.heappop(heap)
        if not by_text:
            break
        # teasers in a marked box are articles too, but hold less than the text beside it
        most, now = by_article[0]
        if -most <= plain or not most:
            most, now = by_text[0]
            if -most < SURGE or -2 * most <= held[0]:
                break
        opened.add(now)
    return opened


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters outside links, inside boilerplate, inside an article) of each block line."""
    out: list[tuple[str, int, bool, bool, int]] = []
    open_: list[tuple[str, bool, bool]] = []  # open boilerplate, marked and article elements
    names: Counter[str] = Counter()  # of open_
    parent, mark = [0], 0  # of marked elements; the innermost open one
    parts: list[str] = []
    linked = bad = inside = links = at = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, max(0, len(text) - linked), bad > 0, inside > 0, mark))
        parts, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(" ".join(piece.split()))

    skip = [0]
    for start, end, closing, name, attributes in _tags(page, skip):
        add(page[at:start])
        at = end
        if not name:
            continue
        name = name.lower()
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE:
                close()
                links = 0
                while names[name]:
                    last, kind, marked = open_.pop()
                    names[last] -= 1
                    if marked:
                        mark = parent[mark]
                    elif kind:
                        bad -= 1
                    elif last in ARTICLE:
                        inside -= 1
                    if last == name:
                        break
            continue
        if name in RAW and not attributes.endswith("/"):
            found = RAW[name].search(page, at)
            at = skip[0] = len(page) if found is None else found.end()
            close()
            continue
        if name == "a":
            links += 1
            continue
        if name in INLINE:
            continue
        close()
        if name in VOID or attributes.endswith("/"):
            continue
        boiler = name in BOILERPLATE and not (name == "header" and inside)
        marked = False
        if not boiler and name not in ARTICLE and name not in ("html", "body"):
            boiler = _hidden(attributes)
            marked = not boiler and _marked(attributes)
        # every open block of a name is kept, so that an inner end tag does not close an outer element
        if boiler or marked or name in ARTICLE or names[name]:
            open_.append((name, boiler, marked))
            names[name] += 1
            bad += boiler
            if marked:
                parent.append(mark)
                mark = len(parent) - 1
            inside += name in ARTICLE and not boiler
    add(page[at:])
    close()
    opened = _openers(out, parent)
    return [(text, free, bad or mark not in opened, inside) for text, free, bad, inside, mark in out]


def tags_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(name, attributes, raw contents) of each start tag in turn; contents of raw elements only."""
    skip = [0]
    for _, end, closing, name, attributes in _tags(page, skip):
        if name and not closing:
            raw = RAW.get(name.lower())
            found = raw.search(page, end) if raw else None
            skip[0] = end if raw is None else len(page) if found is None else found.end()
            yield name.lower(), attributes, page[end : skip[0] if found is None else found.start()] if raw else ""


def main_text(page: str | None) -> str:
    """The article of a page."""
    lines = lines_of(page or "")
    framed = any(inside and not bad for _, _, bad, inside in lines)
    rows: list[tuple[int, int]] = []  # (line, weight)
    if framed:
        within = sum(free for _, free, bad, inside in lines if inside and not bad)
        around = sum(free for _, free, bad, inside in lines if not inside and not bad)
        for i, (text, free, bad, inside) in enumerate(lines):
            if i and inside != lines[i - 1][3]:
                rows += [(i, 0)] * WINDOW
            if not inside:
                rows.append((i, 0 if bad else free if around > within else free // OUTSIDE))
            elif not bad:
                rows.append((i, 2 * free if around > within else len(text) + free))
    else:
        rows = [(i, 0 if bad else free) for i, (_, free, bad, _) in enumerate(lines)]
    weights = [weight for _, weight in rows]
    n = len(rows)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    threshold = min(SURGE, max(sums, default=0))
    kept, at = [], 0
    while at < n:
        if weights[at] and sums[at] >= threshold > 0:  # surge
            if framed:
                # a heading or opening line may be short: go back over weighing lines
                while at and weights[at - 1] and (not kept or kept[-1] != at - 1):
                    at -= 1
            while at < n and sums[at]:  # up to the dive
                if weights[at]:
                    kept.append(at)
                at += 1
        else:
            at += 1
    return " ".join(lines[rows[k][0]][0] for k in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [main_text(x.as_py()) for x in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tidied(run), f"page_id {id_type}, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))
