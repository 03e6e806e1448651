"""The main body of a page among menus, notices, side columns and comments (problem 2).

Line-block distribution: markup is stripped line by line, the text lengths outside links are summed
over sliding windows of lines, and the text between a surge and a dive of that curve is a block. A
block can't run over the edge of one of the page's top-level elements (or of those inside, where one
wraps the page), for markup tells safely that the text before and after such an edge has different
homes; lines in no element are an element each run. The heaviest block that doesn't look like a menu,
a teaser column, a notice or a discussion is the main body, with the other blocks of its element and
with the heavy blocks of neighbours that go on with it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^>]*)>|<![^>]*>|[^<]+|<", re.S)
_SKIP = {"script", "style", "head", "noscript", "template", "svg", "iframe", "select", "textarea", "button"}
_BOX = {"div", "section", "main", "article", "aside", "nav", "header", "footer", "table", "ul", "ol", "form", "dl"}
_APART = {"nav", "header", "footer", "aside", "form"}
_SPEAKER = re.compile(r"^[^.!?]{2,60}:\s")
_STOP = re.compile(r"[.!?…][\"'”»)]*\s*$|[.!?…][\"'”»)]*\s")


class Line:
    """What one line of a page holds: text, the part of it inside links, and the top-level element."""

    __slots__ = ("text", "linked", "links", "box", "leads", "bold", "head")

    def __init__(self) -> None:
        self.text, self.linked, self.links, self.box, self.leads, self.bold, self.head = [], 0, 0, 0, False, False, False


class Page:
    def __init__(self, source: str, level: int = 0):
        """One pass over the tokens of ``source``; unclosed paragraphs and stray closing tags do no harm.

        ``level``: how many elements wrap those that are told apart.
        """
        n = source.count("\n") + 1
        self.lines = [Line() for _ in range(n)]
        self.kinds: dict[int, set[str]] = {0: set()}
        self.opened: dict[int, int] = {0: 0}
        self.notices: list[str] = []
        stack: list[str] = []
        at, skip, boxes, link, bold = 0, "", 0, 0, 0
        for token in _TOKEN.finditer(source):
            whole = token.group(0)
            name = token.group(2)
            if name is None:
                if not whole.startswith("<!"):
                    for k, piece in enumerate(whole.split("\n")):
                        if k:
                            at += 1
                        if skip:
                            if skip == "noscript" and piece.strip():
                                self.notices.append(piece.strip())
                        elif piece.strip():
                            line = self.lines[at]
                            if not line.text:
                                line.bold, line.leads = bool(bold), bool(link)
                            line.text.append(piece)
                            line.box = boxes if len(stack) > level else 0
                            if link:
                                line.linked += len(piece.strip())
                else:
                    at += whole.count("\n")
                continue
            name, closing = name.lower(), token.group(1) == "/"
            here = at
            at += whole.count("\n")
            if skip:
                if closing and name == skip:
                    skip = ""
                continue
            if name in _SKIP:
                if not closing:
                    skip = name
                    if len(stack) > level:
                        self.kinds[boxes].add(name)
                continue
            if name == "a":
                link = 0 if closing else 1
                self.lines[here].links += not closing
            elif name in ("b", "strong"):
                bold = 0 if closing else 1
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.lines[here].head = True
                if len(stack) > level and not closing:
                    self.kinds[boxes].add(name)
            elif name in ("br", "hr", "p", "li", "td", "tr") and not closing:
                link = 0
                if self.lines[here].text:
                    self.lines[here].text.append(" ")
            if name in _BOX:
                if not closing:
                    if len(stack) == level:
                        boxes += 1
                        self.kinds[boxes], self.opened[boxes] = {name}, here
                    elif len(stack) > level and name in _APART:
                        self.kinds[boxes].add("has " + name)
                    stack.append(name)
                elif name in stack:
                    while stack.pop() != name:
                        pass
        for line in self.lines:
            line.text = " ".join(entities.unescape("".join(line.text)).replace("\xa0", " ").split())


def blocks(lengths: list[int], window: int = 3, surge: int = 25) -> list[tuple[int, int]]:
    """(first, last) of each block: from where the windowed sum of lengths rises over ``surge`` to where it dives to none."""
    out, start = [], None
    for k in range(len(lengths)):
        ahead = sum(lengths[k : k + window])
        if start is None and lengths[k] and ahead >= surge:
            start = k
        if start is not None and ahead == 0:
            last = max(i for i in range(start, k + 1) if i < len(lengths) and lengths[i]) if any(lengths[start : k + 1]) else start
            out.append((start, last))
            start = None
    if start is not None:
        out.append((start, max(i for i in range(start, len(lengths)) if lengths[i])))
    return out


def _linked(line: Line) -> bool:
    """Whether a line is a link or a row of links, rather than sentences with links in them."""
    return bool(line.text) and line.links > 0 and len(line.text) - line.linked < max(10, 0.1 * len(line.text)) and not _STOP.search(line.text)


def _elements(page: Page) -> list[tuple[int, list[int]]]:
    """(element, its lines) in order of their first lines; element 0 once for each run of lines that stand in none."""
    out: list[tuple[int, list[int]]] = []
    at: dict[int, list[int]] = {}
    last = -1
    for k, line in enumerate(page.lines):
        if line.text:
            if line.box and line.box in at:
                at[line.box].append(k)
            elif line.box == 0 and last == 0:
                out[-1][1].append(k)
            else:
                out.append((line.box, [k]))
                at[line.box] = out[-1][1]
            last = line.box
    return out


def main_lines(source: str | None, page: Page | None = None, window: int = 3, surge: int = 25) -> list[int]:
    """Numbers of the lines of ``source`` that hold the main body; none if there is no real paragraph."""
    if not source:
        return []
    page = page or Page(source)
    level, elements = 0, _elements(page)
    # One element with a menu, a side column or a footer inside wraps the page: those inside it are told apart.
    while len(elements) == 1 and elements[0][0] and level < 8 and any(kind.startswith("has ") for kind in page.kinds[elements[0][0]]):
        level += 1
        page = Page(source, level)
        elements = _elements(page)
    # Each element's place, headline, weight and lines.
    heavy: list[tuple[int, bool, float, list[int]]] = []
    for place, (box, rows) in enumerate(elements):
        kinds = page.kinds[box] if box else set()
        if kinds & _APART:
            continue
        lines = [page.lines[k] for k in rows]
        linked = [_linked(line) for line in lines]
        headline = "h1" in kinds if box else any(line.head for line in lines)
        teasers = sum(a or line.leads for a, line in zip(linked, lines))
        spoken = sum(line.bold and bool(_SPEAKER.match(line.text)) for line in lines)
        if not headline and (teasers * 2 >= len(lines) or spoken * 2 >= len(lines) or kinds & {"h3", "h4"} and teasers):
            continue
        first, last = rows[0], rows[-1]
        lengths = [0 if _linked(page.lines[k]) or page.lines[k].box != box else len(page.lines[k].text) for k in range(first, last + 1)]
        full = [n >= 40 and bool(_STOP.search(page.lines[first + k].text)) for k, n in enumerate(lengths)]
        # A notice is a paragraph or two with a button or in no element, a footer one or two with a row of links.
        if not headline and sum(full) < 3 and (not box or "button" in kinds or any(line.links >= 3 and a for a, line in zip(linked, lines))):
            continue
        # One line that opens and closes its element itself, or stands in none, is a loose paragraph, not a body.
        if len(rows) == 1 and (not box or page.opened[box] == rows[0]):
            continue
        weight, kept = 0.0, []
        for a, b in blocks(lengths, window, surge):
            kept += [first + k for k in range(a, b + 1) if lengths[k]]
            if any(full[a : b + 1]):
                weight = max(weight, sum(n for n in lengths[a : b + 1] if n >= surge) * (4.0 if headline else 1.0))
        if weight:
            heavy.append((place, headline, weight, kept))
    if not heavy:
        return []
    # Loose lines without a headline are furniture beside an element with real paragraphs, and the body where there is none.
    heavy = [x for x in heavy if elements[x[0]][0] or x[1]] or heavy
    best = max(range(len(heavy)), key=lambda k: (heavy[k][2], -k))
    place, headline, weight, out = heavy[best]
    # What follows a headline's element at once and is heavy too goes on with the article.
    for step, more in zip(range(1, len(heavy)), heavy[best + 1 :]):
        if not headline or not elements[more[0]][0] or more[0] != place + step or more[1] or more[2] * 8 < weight:
            break
        out = out + more[3]
    return sorted(out)


class MainBody:
    """Finds the main body's lines in pages.

    Parameters: ``window`` lines a block sum, ``surge`` characters at which a block begins.

    Defined results: null and empty pages have none; pages without a real paragraph have none; rows
    delivered twice give their lines once; a null row id is ignored; other columns are not read.
    """

    def __init__(self, row: str = "fetch_no", html: str = "html", window: int = 3, surge: int = 25):
        self.row, self.html, self.window, self.surge = row, html, window, surge

    def _pages(self, pages: DataFrame) -> DataFrame:
        return pages.select(F.col(self.row).alias("row"), F.col(self.html).alias("html")).where("row is not null and html is not null")

    def lines(self, pages: DataFrame) -> DataFrame:
        """(row, line_no) of the main body's lines."""
        window, surge = self.window, self.surge

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(row, k) for row, source in zip(batch["row"], batch["html"]) for k in main_lines(source, None, window, surge)]
                yield pd.DataFrame(out, columns=["row", "line_no"])

        return self._pages(pages).mapInPandas(run, "row long, line_no int").distinct().withColumnRenamed("row", self.row)

    def bodies(self, pages: DataFrame) -> DataFrame:
        """(row, body): the text of the main body, a line for each line of the page, empty if there is none."""
        window, surge = self.window, self.surge

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row, source in zip(batch["row"], batch["html"]):
                    page = Page(source)
                    out.append((row, "\n".join(page.lines[k].text for k in main_lines(source, page, window, surge))))
                yield pd.DataFrame(out, columns=["row", "body"])

        return self._pages(pages).mapInPandas(run, "row long, body string").dropDuplicates(["row"]).withColumnRenamed("row", self.row)
