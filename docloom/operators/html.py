"""Structure of HTML pages: the content's container, sections, lines, links, titles and dates.

A page is parsed once and laid out as one text in which every element is a span, so that the text of an
element, its length and whether it holds a phrase are slices and searches, however deep elements are
nested.  What follows (numbering, de-duplication, canonical links) is Spark's.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import urls

# What is no content, where the content is looked for, where links are, what dates a page, and what ends a line.
JUNK = frozenset("script style noscript template iframe svg nav header footer".split())
JUNK_ROLES = ("navigation",)
JUNK_NAMES = ("cookie", "banner", "consent")
PREFERRED = (("tag", "main"), ("id", "main-content"), ("class", "main-content"), ("class", "content"), ("class", "field--name-body"), ("role", "main"))
FALLBACK = (("tag", "article"), ("id", "content"), ("class", "container"), ("class", "region-content"))
LEAST_CONTENT = 120
LINKED = (("id", "wb-cont"), ("tag", "main"))
DATED = frozenset("time p div span li strong".split())
DATE_MARK = re.compile(r"date\s+modified|last\s+updated|date\s+updated", re.I)
UNTITLED = "Untitled PDI"
BLOCKS = frozenset("p blockquote li h1 h2 h3 h4 h5 h6 tr table caption ul ol div section article main body".split())
# End of fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DATES = (r"\b(?P<iso>\d{4}-\d{2}-\d{2})\b", r"\b(?P<month>[A-Za-z]{3,9})\s+(?P<day>\d{1,2}),\s*(?P<year>\d{4})\b", r"\b(?P<day>\d{1,2})\s+(?P<month>[A-Za-z]{3,9})\s+(?P<year>\d{4})\b")


class _Node:
    """An element: its children and texts, and where it begins and ends in the page's texts."""

    __slots__ = ("tag", "attrs", "items", "junk", "shown", "bare")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.items = tag, attrs, []
        self.junk = tag in JUNK or attrs.get("role") in JUNK_ROLES or any(name in attrs.get(a, "") for a in ("class", "id") for name in JUNK_NAMES)

    def walk(self, junk: bool = False) -> Iterator[_Node]:
        """The elements within, in the order of their beginnings."""
        stack = [self]
        while stack:
            node = stack.pop()
            if node is not self:
                yield node
            stack += [x for x in reversed(node.items) if isinstance(x, _Node) and (junk or not x.junk)]

    def children(self, *tags: str) -> list[_Node]:
        return [x for x in self.items if isinstance(x, _Node) and x.tag in tags and not x.junk]

    def fits(self, kind: str, value: str) -> bool:
        """Whether a selector of an element's tag, class or other attribute is met."""
        return self.tag == value if kind == "tag" else value in self.attrs.get(kind, "").split() if kind == "class" else self.attrs.get(kind) == value


class _Tree(HTMLParser):
    """A tree that closes what is left open when its parent ends; what follows the body's end belongs to the body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr") and self.open[-1].tag == tag:
            self.open.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in ("body", "html"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class Page:
    """A parsed page.  ``shown`` is its text with spaces between blocks, ``bare`` without; neither has junk."""

    def __init__(self, html: str | None):
        tree = _Tree()
        tree.feed(html or "")
        tree.close()
        self.root = tree.root
        self.shown, self.bare = self._laid_out()
        self.content = self._content()

    def _laid_out(self) -> tuple[str, str]:
        shown, bare, at, plain = [], [], 0, 0
        stack = [(self.root, iter(self.root.items))]
        self.root.shown, self.root.bare = 0, 0
        while stack:
            node, items = stack[-1]
            x = next(items, None)
            if x is None:
                node.shown, node.bare = slice(node.shown, at), slice(node.bare, plain)
                stack.pop()
                continue
            gap = isinstance(x, _Node) and x.junk or node.tag in BLOCKS
            if gap:
                shown.append(" ")
                at += 1
            if isinstance(x, str):
                shown.append(x)
                bare.append(x)
                at, plain = at + len(x), plain + len(x)
            elif not x.junk:
                x.shown, x.bare = at, plain
                stack.append((x, iter(x.items)))
        return "".join(shown), "".join(bare)

    def text(self, node: _Node) -> str:
        return _clean(self.shown[node.shown])

    def length(self, node: _Node) -> int:
        return len(_clean(self.bare[node.bare]))

    def _content(self) -> _Node:
        """The first element of the first preferred selector whose first element has text enough, else the longest of the body and the fallbacks."""
        nodes = list(self.root.walk())
        for selector in PREFERRED:
            node = next((n for n in nodes if n.fits(*selector)), None)
            if node and self.length(node) > LEAST_CONTENT:
                return node
        body = next((n for n in nodes if n.tag == "body"), self.root)
        return max([body, *(n for s in FALLBACK for n in nodes if n.fits(*s))], key=self.length)

    def title(self) -> str:
        found = (next((n for n in place.walk() if n.tag == tag), None) for place, tag in ((self.content, "h1"), (self.root, "title")))
        return next((t for n in found if n and (t := self.text(n))), UNTITLED)

    def updated(self) -> str | None:
        """The first date of an element that speaks of its change: in the content, or else anywhere."""
        marks = [(m.start(), m.end()) for m in DATE_MARK.finditer(self.bare)]
        for place in (self.content, self.root):
            marked = [n for n in place.walk() if n.tag in DATED and (k := bisect_left(marks, (n.bare.start, 0))) < len(marks) and marks[k][1] <= n.bare.stop]
            if marked:
                return next((d for n in marked if (d := iso_date(_clean(self.bare[n.bare])))), None)
        return None

    def links(self) -> list[str]:
        """The addresses of the links in the part that is crawled, in order; junk there is crawled too."""
        nodes = list(self.root.walk(junk=True))
        place = next((n for s in LINKED for n in nodes if n.fits(*s)), self.root)
        return [n.attrs["href"] for n in place.walk(junk=True) if n.tag == "a" and "href" in n.attrs]


def iso_date(text: str) -> str | None:
    """The first date of a text that is one, by format: ISO, then month, day and year, then day, month and year; the 31st of a short month is the next one's first."""
    for pattern in DATES:
        if m := re.search(pattern, text):
            if "iso" in m.groupdict():
                return m["iso"]
            month, day = m["month"][:3].lower(), int(m["day"])
            if month in MONTHS and 1 <= day <= 31 and m["year"] != "0000":
                return (date(int(m["year"]), MONTHS.index(month) + 1, 1) + timedelta(day - 1)).isoformat()
    return None


def table_lines(page: Page, table: _Node) -> list[str]:
    """``Table: <caption>``, then a line for each row, labelled by the header if there is one."""
    header, out = [], [f"Table: {page.text(n)}" for n in table.walk() if n.tag == "caption"]
    for row in (n for n in table.walk() if n.tag == "tr"):
        cells = row.children("td", "th")
        values = [page.text(c) for c in cells]
        if not header and cells and all(c.tag == "th" for c in cells):
            header = [v for v in values if v]
        elif any(values):
            out.append(" | ".join(f"{header[i]}: {v}" if i < len(header) else v for i, v in enumerate(values) if v))
    return out


def item_lines(page: Page, item: _Node) -> list[str]:
    """A line for an item without its nested lists, then those of their items."""
    lines, stack = [], [item]
    while stack:
        node = stack.pop()
        own = [x if isinstance(x, str) else page.text(x) for x in node.items if isinstance(x, str) or not (x.junk or x.tag in ("ul", "ol"))]
        if t := _clean(" ".join(own)):
            lines.append(f"- {t}")
        stack += reversed([child for nest in node.children("ul", "ol") for child in nest.children("li")])
    return lines


def sections_of(page: Page) -> list[tuple[list[str], str, str]]:
    """(heading path, anchor, text) of the parts under h1 to h4; parts without text are left out."""
    title = page.title()
    levels: list[str] = [title, "", "", ""]
    out: list[tuple[list[str], str, list[str]]] = [([title], "", [])]
    stack: list[tuple[str, _Node | str]] = [(page.content.tag, x) for x in reversed(page.content.items)]
    while stack:
        within, x = stack.pop()
        if isinstance(x, str):
            if within in ("div", "section", "article", "main", "body", "root") and (t := _clean(x)):
                out[-1][2].append(t)
        elif x.junk:
            continue
        elif x.tag in HEADINGS:
            if t := page.text(x):
                k = int(x.tag[1]) - 1
                levels[k:] = [t] + [""] * (3 - k)
                out.append(([h for h in levels if h], f"#{x.attrs['id']}" if x.attrs.get("id") else "", []))
        elif x.tag == "table":
            out[-1][2].extend(table_lines(page, x))
        elif x.tag == "li":
            out[-1][2].extend(item_lines(page, x))
        elif x.tag in ("p", "blockquote", "pre"):
            if t := page.text(x):
                out[-1][2].append(t)
        elif x.tag not in ("head", "title"):
            stack += [(x.tag, y) for y in reversed(x.items)]
    found = [(path, anchor, t) for path, anchor, lines in out if (t := _clean(" ".join(lines)))]
    return found or ([([title], "", t)] if (t := page.text(page.content)) else [])


def lines_of(page: Page) -> list[str]:
    """Markdown lines: headings, list items, table rows and paragraphs."""
    out = []
    for n in page.content.walk():
        if n.tag not in (*HEADINGS, "li", "p", "tr") or not (t := page.text(n)):
            continue
        if n.tag in HEADINGS:
            out.append("#" * int(n.tag[1]) + " " + t)
        elif n.tag == "li":
            out.append(f"- {t}")
        elif n.tag == "p":
            out.append(t)
        else:
            out.append("Table row: " + " | ".join(c for c in map(page.text, n.children("td", "th")) if c))
    return out or [page.text(page.content)]


def resolved_links(page: Page, base: str | None) -> list[str | None]:
    """The page's links as whole addresses; null where no address can be made of one."""

    def one(href: str) -> str | None:
        try:
            return urljoin(base or "", href.strip())
        except ValueError:
            return None

    return [one(h) for h in page.links()]


#: What can be read off a page, its type, and how, given the page and its address.
PARTS: dict[str, tuple[str, Callable[[Page, str | None], object]]] = {
    "title": ("string", lambda page, base: page.title()),
    "last_updated": ("string", lambda page, base: page.updated()),
    "links": ("array<string>", resolved_links),
    "sections": ("array<struct<heading_path:array<string>,anchor:string,text:string>>", lambda page, base: [{"heading_path": p, "anchor": a or None, "text": t} for p, a, t in sections_of(page)]),
    "markdown": ("string", lambda page, base: "\n\n".join(dict.fromkeys(lines_of(page)))),
}


#: The same types in Arrow, and pages whose parts leave a task at a time.
ARROW = {
    "string": pa.string(), "array<string>": pa.list_(pa.string()),
    PARTS["sections"][0]: pa.list_(pa.struct([("heading_path", pa.list_(pa.string())), ("anchor", pa.string()), ("text", pa.string())])),
}
PAGES_OUT = 200


def _read(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(key, and each of ``names``) of pages (key, url, html); one page at a time is a tree."""
    for batch in batches:
        for i in range(0, len(batch), PAGES_OUT):
            part = batch.slice(i, PAGES_OUT)
            found: list[list] = [[] for _ in names]
            for html, url in zip(part.column("html"), part.column("url")):
                page, base = Page(html.as_py()), url.as_py()
                for name, values in zip(names, found):
                    values.append(PARTS[name][1](page, base))
            yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(values, ARROW[PARTS[name][0]]) for name, values in zip(names, found)]], ["key", *names])


def parts(pages: DataFrame, *names: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, and each of ``names`` out of PARTS): every page is parsed once, whatever is asked of it; a null page is an empty one."""
    rows = pages.select(F.col(key).alias("key"), (F.col(url) if url in pages.columns else F.lit("")).alias("url"), F.col(html).alias("html"))
    kinds = ", ".join(f"{name} {PARTS[name][0]}" for name in names)
    return rows.mapInArrow(lambda batches: _read(batches, names), f"key {pages.schema[key].dataType.simpleString()}, {kinds}").withColumnRenamed("key", key)


def sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, section_index, heading_path, top_heading, anchor, text)."""
    found = parts(pages, "sections", key=key, html=html).select(key, F.posexplode("sections").alias("section_index", "s"))
    return found.select(key, "section_index", "s.heading_path", F.col("s.heading_path")[0].alias("top_heading"), "s.anchor", "s.text")


def markdown(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, markdown): each different line once, where it is first."""
    return parts(pages, "markdown", key=key, html=html)


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, link): canonical links of the part that is crawled, each where it is first; relative ones are resolved."""
    raw = parts(pages, "links", key=key, url=url, html=html).select(F.col(key).alias("key"), F.posexplode("links").alias("pos", "full"))
    canonical = urls.with_canonical(raw, "full", "link").where("link is not null")
    return canonical.groupBy("key", "link").agg(F.min("pos").alias("pos")).select(F.col("key").alias(key), "pos", "link")


def markdown_links(text: Column) -> Column:
    """URLs of a markdown text, labelled ones first, each once."""
    labelled = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), 1)
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"(https?://[^\s)\]>\"']+)"), 1), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))
    return F.array_distinct(F.concat(labelled, bare))


def page_title(html: Column) -> Column:
    """The first heading of a page, else its title element, by expressions alone; ``Untitled`` if both are empty."""
    plain = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), "<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    return F.coalesce(plain("h1"), plain("title"), F.lit("Untitled"))


def root_links(html: Column, base: Column) -> Column:
    """The different addresses of a page's hrefs that are absolute or begin at the root, without order."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    found = F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+)["']"""), 1)
    full = F.transform(found, lambda h: F.when(F.startswith(h, F.lit("http")), h).when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, "^(https?:)", 1), h)).when(F.startswith(h, F.lit("/")), F.concat(origin, h)))
    return F.array_sort(F.array_distinct(F.array_compact(full)))


def title(html: Column) -> Column:
    """The title element of a page, by expressions alone."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit("")), F.lit("Untitled"))


def toc_like(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("contents")) & text.rlike(r"(?m)\.{3,}\s*\d+\s*$")


def low_text(text: Column, least: int = 300) -> Column:
    return F.length(F.trim(text)) < least


def last_updated(text: Column) -> Column:
    """The date after ``date modified`` and its like, as ISO."""
    return F.nullif(F.regexp_extract(text, r"(?i)(?:date modified|last updated|date updated)\D{0,40}?(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
