"""Documents from raw pages: title, description, language, headings, body, links, icon."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_BARRIER = {"ul", "ol", "table", "div", "section", "article", "main", "body", "td", "th"}
_ROOTS = ["main", "article", "[role=main]", "#content", "#main", ".content", ".main", "section"]

DOCUMENT = ("id long, url string, domain string, title string, body string, links array<string>, headings array<string>, meta_description string, "
            "lang string, content_hash long, crawled_at long, favicon_url string")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            if isinstance(child, Node):
                yield from child.walk()

    def texts(self, strip: frozenset[str] = frozenset()) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in strip:
                yield from child.texts(strip)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P and any(n.tag == "p" for n in self.open):
            self._close("p")
        closes = _CLOSES.get(tag)
        if closes:
            for node in reversed(self.open):
                if node.tag in closes:
                    self._close(node.tag)
                    break
                if node.tag in _BARRIER:
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def _close(self, tag: str) -> None:
        while len(self.open) > 1:
            if self.open.pop().tag == tag:
                return


def parse(source: str) -> Node:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _matches(node: Node, selector: str) -> bool:
    if selector.startswith("["):
        return node.attrs.get("role") == "main"
    if selector.startswith("#"):
        return node.attrs.get("id") == selector[1:]
    if selector.startswith("."):
        return selector[1:] in node.attrs.get("class", "").split()
    return node.tag == selector


def _meta(root: Node, attribute: str, value: str) -> str | None:
    for node in root.walk():
        if node.tag == "meta" and node.attrs.get(attribute) == value:
            found = squeeze(node.attrs.get("content", ""))
            if found:
                return found
    return None


def _first(root: Node, tag: str) -> str | None:
    for node in root.walk():
        if node.tag == tag:
            return squeeze("".join(node.texts())) or None
    return None


def title(root: Node) -> str:
    return _meta(root, "property", "og:title") or _first(root, "title") or _first(root, "h1") or ""


def description(root: Node) -> str | None:
    return _meta(root, "property", "og:description") or _meta(root, "name", "description")


def headings(root: Node) -> list[str]:
    found = (squeeze("".join(n.texts())) for n in root.walk() if re.fullmatch("h[1-6]", n.tag))
    return [h for h in found if h]


def _blocks(node: Node, strip: frozenset[str], blocks: frozenset[str], out: list[str]) -> None:
    """A block element is one paragraph with all its subtree; text between blocks is one of its own."""
    if node.tag in blocks:
        paragraph = squeeze("".join(node.texts(strip)))
        if paragraph:
            out.append(paragraph)
        return
    for child in node.children:
        if isinstance(child, str):
            if squeeze(child):
                out.append(squeeze(child))
        elif child.tag not in strip:
            _blocks(child, strip, blocks, out)


def body_text(root: Node) -> str:
    """Paragraphs of the content root: of the usual containers the one with the longest text, else the body."""
    strip, blocks = frozenset(fixed.STRIP_TAGS), frozenset(fixed.BLOCK_TAGS)
    best, size = None, 0
    for selector in _ROOTS:
        for node in root.walk():
            if _matches(node, selector):
                own = len("".join(node.texts()).strip().encode())
                if own > size:
                    best, size = node, own
    if best is None:
        best = next((n for n in root.walk() if n.tag == "body"), None)
    out: list[str] = []
    if best is not None:
        _blocks(best, strip, blocks, out)
    if not out:
        out = [t for t in map(squeeze, root.texts()) if t]
    return "\n\n".join(out)


def normal_link(url: str) -> str | None:
    """As the column expression of the same name, for absolute addresses."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return None
    netloc = parts.hostname if port in (None, 80 if parts.scheme == "http" else 443) else f"{parts.hostname}:{port}"
    path = parts.path or "/"
    if len(path) > 1:
        path = path.rstrip("/") or "/"
    return urlunsplit((parts.scheme, netloc, path, parts.query, ""))


def links(root: Node, base: str) -> list[str]:
    """Targets of the page's links, absolute and normal, each once, in order."""
    out: dict[str, None] = {}
    for node in root.walk():
        href = node.attrs.get("href", "").strip() if node.tag == "a" else ""
        if not href or href.startswith("#") or href.lower().startswith(tuple(fixed.BLOCKED_SCHEMES)):
            continue
        try:
            found = normal_link(urljoin(base, href))
        except ValueError:
            continue
        if found:
            out[found] = None
    return list(out)


def favicon(root: Node, base: str) -> str:
    for rel in ("icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed"):
        for node in root.walk():
            if node.tag == "link" and node.attrs.get("rel", "").lower() == rel and node.attrs.get("href"):
                return urljoin(base, node.attrs["href"])
    parts = urlsplit(base)
    return f"{parts.scheme}://{parts.netloc}/favicon.ico"


def language(root: Node) -> str | None:
    for node in root.walk():
        if node.tag == "html":
            return node.attrs.get("lang", "").strip().lower() or None
    return None


def canonical(root: Node, base: str) -> str | None:
    for node in root.walk():
        if node.tag == "link" and node.attrs.get("rel", "").lower() == "canonical" and node.attrs.get("href"):
            return urljoin(base, node.attrs["href"])
    return None


def homepage_body(url: str, name: str, about: str | None, heads: list[str], body: str) -> str:
    """A homepage of under 100 words gets name, title, description and its first headings before its text."""
    path = re.sub(r"[?#].*", "", re.sub(r"^https?://[^/]*", "", url))
    if path not in fixed.HOME_PATHS or len(body.split()) >= 100:
        return body
    host = re.sub(r"^www\.", "", re.sub(r"^https?://", "", url).split("/")[0].split(":")[0])
    parts = [f"{host.split('.')[0]} - {host}", name, about or "", "".join(f"{h}. " for h in heads[:10]), body]
    return "\n\n".join(p for p in parts if p)


def document(url: str, domain: str, source: str, headers: dict | None, crawled_at: int | None) -> tuple | None:
    """The fields of DOCUMENT, or null for a blank page or another content type."""
    kind = {k.lower(): v for k, v in (headers or {}).items()}.get("content-type") or "text/html"
    if not source or not source.strip() or not ("text/html" in kind or "application/xhtml" in kind):
        return None
    root = parse(source)
    name, about, heads = title(root), description(root), headings(root)
    body = body_text(root)
    if len(body.encode()) < 50 and about:
        body = about
    body = homepage_body(url, name, about, heads, body.encode()[:1_000_000].decode(errors="ignore"))
    signed = lambda text: xxhash.xxh3_64_intdigest(text) - (1 << 64) * (xxhash.xxh3_64_intdigest(text) >> 63)
    return signed(url), url, domain, name, body, links(root, url), heads, about, language(root), signed(body), crawled_at, favicon(root, url)


def extract(pages: DataFrame) -> DataFrame:
    """Documents of pages (url, domain, html, headers, crawled_at); pages without text and null addresses are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in DOCUMENT.split(", ")]
        for batch in batches:
            rows = []
            for url, domain, source, headers, at in zip(*(batch[c] for c in ("url", "domain", "html", "headers", "crawled_at"))):
                found = document(url, domain, source, dict(headers) if headers is not None else None, None if pd.isna(at) else int(at))
                if found:
                    rows.append(found)
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return pages.where("url is not null").select("url", "domain", "html", "headers", F.col("crawled_at")).mapInPandas(run, DOCUMENT)


def fields(pages: DataFrame) -> DataFrame:
    """``extract`` with the pages' own ``fetch_no``: (fetch_no, title, lang, headings, favicon_url, ...) of each page that is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["fetch_no", *(c.split()[0] for c in DOCUMENT.split(", "))]
        for batch in batches:
            rows = []
            for number, url, domain, source, headers in zip(*(batch[c] for c in ("fetch_no", "url", "domain", "html", "headers"))):
                found = document(url, domain, source, dict(headers) if headers is not None else None, None)
                if found:
                    rows.append((number, *found))
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return pages.where("url is not null").select("fetch_no", "url", "domain", "html", "headers").mapInPandas(run, "fetch_no long, " + DOCUMENT)
