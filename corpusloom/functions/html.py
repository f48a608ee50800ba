"""HTML pages: title, main text and links, by an event parser in Arrow batches. Spark has no parser
for malformed HTML, so this is one of the few places where rows go through Python."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements that hold no content, elements without an end, and where the main text is.
DROPPED = frozenset(("nav", "header", "footer", "script", "style", "noscript", "form"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAIN = ("main", "article", "body")
STATIC = re.compile(r"\.(jpg|jpeg|png|gif|svg|zip|docx?|xlsx?|pptx?|pdf)$", re.I)


class _Page(HTMLParser):
    """Collects text pieces by region. An end tag closes the innermost open element of its name;
    without one it is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.depth = 0  # open dropped elements
        self.text: dict[str, list[str]] = {"main": [], "article": [], "body": [], "": []}
        self.began: set[str] = set()
        self.closed: set[str] = set()
        self.titles: dict[str, list[str] | None] = {"h1": None, "title": None}
        self.done: set[str] = set()
        self.links: list[tuple[str, list[str]]] = []
        self.anchors: list[bool] = []  # of the open a elements: whether they have an address

    def handle_starttag(self, tag: str, attrs: list) -> None:
        href = dict(attrs).get("href") if tag == "a" else None
        if href is not None:
            self.links.append((href, []))
        if tag == "a":
            self.anchors.append(href is not None)
        if tag in VOID:
            return
        self.open.append(tag)
        self.depth += tag in DROPPED
        if self.depth == 0:
            if tag in MAIN:
                self.began.add(tag)
            if tag in self.titles and self.titles[tag] is None:
                self.titles[tag] = []

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            t = self.open.pop()
            self.depth -= t in DROPPED
            if t == "a":
                self.anchors.pop()
            if t in self.titles and self.titles[t] is not None:
                self.done.add(t)
            if t in MAIN and t not in self.open and t in self.began:
                self.closed.add(t)
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.anchors and self.anchors[-1]:
            self.links[-1][1].append(data)
        if self.depth:
            return
        for t in self.titles:
            if t in self.open and t not in self.done:
                self.titles[t].append(data.strip())
        piece = data.strip()
        if piece:
            self.text[""].append(piece)
            for t in MAIN:
                if t in self.open and t not in self.closed:
                    self.text[t].append(piece)


def parse(html: str, url: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(title, text, links as (absolute URL without fragment, link text))."""
    p = _Page()
    p.feed(html)
    p.close()
    title = next(("".join(p.titles[t]) for t in ("h1", "title") if p.titles[t] is not None), url)
    region = next((t for t in MAIN if t in p.began), "")
    links = []
    for href, text in p.links:
        try:
            links.append((urldefrag(urljoin(url, href))[0], " ".join(" ".join(text).split())[:200]))
        except ValueError:
            continue
    return title, "\n".join(p.text[region]), links


def internal(links: list[tuple[str, str]], host: str) -> list[str]:
    """Distinct same-host page addresses without query, in order; static files aren't pages."""
    out: dict[str, None] = {}
    for link, _ in links:
        u = urlsplit(link)
        if u.netloc == host and u.scheme in ("http", "https") and not STATIC.search(u.path):
            out[urlunsplit((u.scheme, u.netloc, u.path, "", ""))] = None
    return list(out)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    link = pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())]))
    for b in batches:
        titles, texts, links = [], [], []
        for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
            t, x, l = parse(html or "", url or "")
            titles.append(t)
            texts.append(x)
            links.append([{"url": a, "text": c} for a, c in l])
        yield pa.RecordBatch.from_arrays([b.column("url"), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(links, link)], ["url", "title", "text", "links"])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(url, html) -> (url, title, text, links)."""
    return pages.select("url", "html").mapInArrow(_parse_batches, "url string, title string, text string, links array<struct<url:string,text:string>>")
