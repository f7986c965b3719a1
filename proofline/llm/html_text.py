"""Operator 13: main text of web pages by text-to-tag ratios.

Method. The standard library's parser reads a page in pieces and gives events. Block elements cut the text into lines; each
line keeps its characters, its tags and the characters inside links, and the element that holds it. A line's ratio is its
text outside links per tag. The ratios are smoothed by a Gaussian along the page and split by a threshold between two
clusters; lines above it are content. The region is then the article (or main) element that holds the content, or else the
deepest element that holds nearly all of it. Within the region every line is kept, however short, but for elements that
say that they are something else: menus, headers, footers, sidebars, notices, adverts, forms, comments, hidden parts.

Character references are decoded, white space inside a block becomes one space, a line break is a space and two of them
end a block, the cells of a table's row make one block. An article's own header keeps its headings.

Defined cases: a null html is an empty page; pages without markup are one block per page; without any content the text is
empty; rows with null or repeated ids or urls are rows of their own; an empty table gives no rows; other columns are not
read. Pages are parsed whole; a page has to fit a worker's memory several times.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm._common import Out, rows_of

# The elements of HTML and the names that sites give their parts.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section"
    " summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
NEVER = frozenset("applet audio button canvas datalist dialog embed fieldset head iframe math menu noscript object option script select style svg template textarea title video".split())
AROUND = frozenset("nav header footer aside form search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright discussion disqus footer gdpr header login masthead"
    " menu menubar modal nav navbar navigation navigator newsletter notice notification overlay pager pagination paywall popup promo promotion recommended recommendations related replies reply respond search share sharing"
    " sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription survey toolbar topbar topnav widget widgets".split()
)
OWN_HEADS = frozenset("entry post story section".split())  # such a header is a part of the article
WHOLE = frozenset("article body col column container content grid has layout main no outer page root row site with without wrap wrapper".split())  # such a name is about the page's form
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "thead": "tr td th", "tbody": "tr td th thead tbody", "tfoot": "tr td th tbody", "option": "option"}
KEEPS_P = frozenset("html body head".split())
SCOPE = frozenset("article aside blockquote body dd details div dl dt fieldset figure footer form header html li main nav ol section table td th tr ul".split())
CHUNK, SIGMA, REACH = 1 << 16, 1.0, 3
NEARLY_ALL, LINKS = 0.9, 0.5

PART = re.compile(r"[a-z0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z0-9]*")


def marked(names: str) -> bool:
    """Whether a class or id names a part that is not the article: one of its names does, and that name is not about the page's form."""
    for name in names.split():
        parts = [p.lower() for p in PART.findall(name)]
        found = {p for p in parts if p in MARKS}
        if found and WHOLE.isdisjoint(parts) and not (found == {"header"} and not OWN_HEADS.isdisjoint(parts)):
            return True
    return False


class Page(HTMLParser):
    """Lines of a page, with the elements that hold them. Elements are numbered; a parent's number is smaller."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parents, self.kinds, self.outs = [0], ["page"], [""]  # of each element: parent, tag, why it is left out
        self.stack: list[tuple[str, int]] = [("page", 0)]  # open elements; inline ones have the number of what holds them
        self.lines: list[tuple[int, str, int, int, str]] = []  # element, text, tags, characters in links, heading's tag
        self.held: list[str] = []
        self.open: Counter[str] = Counter()  # how often each tag is on the stack
        self.headings: list[str] = []
        self.tags = self.linked = self.breaks = 0
        self.ending = False

    # What is still open at the page's end goes with it, as in HTML; the parser would try it again from each later "<".
    def rest(self, k: int) -> int:
        return len(self.rawdata) if k < 0 and self.ending else k

    def parse_starttag(self, i: int) -> int:
        return self.rest(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self.rest(super().parse_endtag(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self.rest(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self.rest(super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        return self.rest(super().parse_html_declaration(i))

    def parse_marked_section(self, i: int, report: int = 1) -> int:  # ends at the next ">", as a comment does
        return self.rest(self.rawdata.find(">", i + 3) + 1 or -1)

    def close(self) -> None:
        self.ending = True
        super().close()

    def cut(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.lines.append((self.stack[-1][1], text, self.tags, self.linked, self.headings[-1] if self.headings else ""))
            self.tags = 0
        self.held.clear()
        self.linked = self.breaks = 0

    def close_to(self, at: int) -> None:
        """Close the open elements from `at` on."""
        gone = [t for t, _ in self.stack[at:]]
        if not BLOCKS.isdisjoint(gone):
            self.cut()
        for tag in reversed(gone):
            self.open[tag] -= 1
            if tag in HEADINGS:
                self.headings.pop()
        del self.stack[at:]

    def push(self, tag: str, element: int) -> None:
        self.stack.append((tag, element))
        self.open[tag] += 1
        if tag in HEADINGS:
            self.headings.append(tag)

    def close_implied(self, tag: str) -> None:
        if tag in BLOCKS and tag not in KEEPS_P and self.open["p"]:
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at][0] == "p":
                    self.close_to(at)
                    break
                if self.stack[at][0] in SCOPE:
                    break
        ends, at = [t for t in CLOSED_BY.get(tag, "").split() if self.open[t]], len(self.stack)
        for i in range(len(self.stack) - 1, 0, -1) if ends else ():
            if self.stack[i][0] in ends:
                at = i
            elif self.stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                break
        if at < len(self.stack):
            self.close_to(at)

    def why_out(self, tag: str, attrs: dict[str, str], parent: int) -> str:
        """Why an element is left out, "" if it is not: "never", "marked", or the tag of a part around the article."""
        above = self.outs[parent]
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        is_whole = tag in ("article", "main", "body", "html")
        own = "never" if tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) else ""
        if not own and tag not in ("main", "body", "html") and (marked(names) or attrs.get("role", "").lower() in ROLES):
            own = "marked"
        if not own and tag in AROUND:
            own = tag
        if is_whole and not own and above in AROUND and above != "aside":
            return ""  # a form or an unclosed menu around the article
        return above or own

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.breaks += 1
            self.held.append(" ")
            if self.breaks > 1:
                self.cut()
            return
        self.close_implied(tag)
        if tag in BLOCKS:
            self.cut()
        elif tag in ("td", "th", "img"):
            self.held.append(" ")
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        parent = self.stack[-1][1]
        why = self.why_out(tag, given, parent)
        if tag in BLOCKS or why != self.outs[parent]:
            self.parents.append(parent)
            self.kinds.append("article" if given.get("itemprop") == "articleBody" or given.get("role") == "article" else "main" if given.get("role") == "main" else tag)
            self.outs.append(why)
            self.push(tag, len(self.parents) - 1)
        else:
            self.push(tag, parent)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no closed start tags but the void ones

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.handle_starttag(tag, [])
            return
        for at in range(len(self.stack) - 1, 0, -1) if self.open[tag] else ():
            if self.stack[at][0] == tag:
                self.close_to(at)
                return
            if tag not in BLOCKS and self.stack[at][0] in SCOPE:
                return
        if tag == "p":
            self.cut()

    def handle_data(self, data: str) -> None:
        tag, element = self.stack[-1]
        if self.outs[element] and tag not in BLOCKS and not self.outs[self.parents[element]]:
            return  # inside an inline part that is left out
        if self.outs[element] in ("never", "marked"):
            return
        self.held.append(data)
        if not data.isspace():
            self.breaks = 0
            if self.open["a"]:
                self.linked += len(data)


def parse(html: str) -> Page:
    page = Page()
    for at in range(0, len(html), CHUNK):
        page.feed(html[at : at + CHUNK])
    page.close()
    page.cut()
    return page


def smoothed(ratios: list[float]) -> list[float]:
    """The ratios averaged with their neighbours by a Gaussian; beyond the page's ends there is nothing to average with."""
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(REACH + 1)]
    out = []
    for i in range(len(ratios)):
        near = range(max(0, i - REACH), min(len(ratios), i + REACH + 1))
        out.append(sum(weights[abs(j - i)] * ratios[j] for j in near) / sum(weights[abs(j - i)] for j in near))
    return out


def threshold(values: list[float]) -> float:
    """The value between two clusters: midway between the means of what lies below and above it."""
    at = sum(values) / len(values) if values else 0.0
    for _ in range(100):
        low, high = [v for v in values if v < at], [v for v in values if v >= at]
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2 if low and high else at
        if abs(new - at) <= 1e-9 * max(1.0, at):
            break
        at = new
    return at


def region(page: Page, weights: list[float]) -> set[int]:
    """The elements whose lines make up the article; weights are the lines' content."""
    n = len(page.parents)
    sums, texts = [0.0] * n, [0] * n
    for (element, text, *_), w in zip(page.lines, weights, strict=True):
        if not page.outs[element]:
            sums[element] += w
            texts[element] += len(text)
    for e in range(n - 1, 0, -1):
        sums[page.parents[e]] += sums[e]
        texts[page.parents[e]] += texts[e]
    for kind in ("article", "main"):
        inside = [False] * n
        found = []
        for e in range(1, n):
            inside[e] = inside[page.parents[e]] or page.kinds[page.parents[e]] == kind and not page.outs[page.parents[e]]
            if page.kinds[e] == kind and not inside[e] and not page.outs[e]:
                found.append(e)
        size = sums if any(sums[e] for e in found) else texts
        most = max((size[e] for e in found), default=0)
        if most:
            return _below(page, {e for e in found if 2 * size[e] >= most})
    at = 0
    for e in range(1, n):  # at most one child of an element holds nearly all
        if page.parents[e] == at and sums[e] and sums[e] >= NEARLY_ALL * sums[0] and page.kinds[e] not in ("p", "li", "tr", "blockquote", "pre", *HEADINGS):
            at = e
    inside = _below(page, {at})
    linked = [0] * n
    for element, _, _, links, _ in page.lines:
        linked[element] += links
    for e in range(n - 1, 0, -1):
        linked[page.parents[e]] += linked[e]
    menus = {e for e in inside if e != at and not sums[e] and texts[e] and linked[e] > LINKS * texts[e]}
    return inside - _below(page, menus)


def _below(page: Page, tops: set[int]) -> set[int]:
    out: set[int] = set()
    for e in range(len(page.parents)):
        if e in tops or e and page.parents[e] in out:
            out.add(e)
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    page = parse(html or "")
    if page.lines and all(page.outs[line[0]] for line in page.lines):  # all of it is inside a form, as on some servers' pages
        page.outs = ["" if why == "form" else why for why in page.outs]
    ratios = [0.0 if page.outs[e] else (len(text) - min(linked, len(text))) / max(1, tags) for e, text, tags, linked, _ in page.lines]
    near = smoothed(ratios)
    at = threshold(near)
    weights = [max(0, len(text) - linked) if ratio >= at and not page.outs[e] else 0.0 for (e, text, _, linked, _), ratio in zip(page.lines, near, strict=True)]
    inside = region(page, weights)
    own = {e for e in inside if page.outs[e] == "header" and _in_article(page, e)}
    kept = [i for i, (e, _, _, _, heading) in enumerate(page.lines) if e in inside and (not page.outs[e] or heading and _header(page, e) in own)]
    if kept:  # headings right before the region belong to it
        while kept[0] > 0 and page.lines[kept[0] - 1][4] in ("h1", "h2") and not page.outs[page.lines[kept[0] - 1][0]]:
            kept.insert(0, kept[0] - 1)
    return "\n".join(page.lines[i][1] for i in kept)


def _header(page: Page, e: int) -> int:
    """The element that is left out as a header, around e or e itself; 0 if none."""
    while e and page.kinds[e] != "header":
        e = page.parents[e]
    return e


def _in_article(page: Page, e: int) -> bool:
    """Whether a header stands inside an article that is not left out."""
    while e:
        e = page.parents[e]
        if page.kinds[e] == "article":
            return not page.outs[e]
        if page.outs[e]:
            return False
    return False


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of the main text of each row of `pages(page_id, url, html)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]), 256)
        for page_id, url, html in rows_of(batches, "page_id", "url", "html"):
            text = main_text(html)
            out.add(page_id, url, text, len(text))
            yield from out.ready()
        yield from out.ready(force=True)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
