"""HTML laid out as text: wrapped paragraphs, lists, kept ``pre`` blocks, aligned tables.

One pass over the tokens of a page with a stack of open blocks; work grows with
the page (times the depth of its lists and quotes).  Rows go through in Arrow
batches, nothing is shuffled.

Defined cases: null stays null; an empty page or one of tags alone is an empty
text; tags that are never closed end with the block around them; closing tags
without an opening one only break the line; words longer than a line are not
cut; a ``<`` that starts no tag is text; a tag cut off by the end of the page
goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks around blocks, list marks, widths.
BREAKS = {
    "p": 2, "h1": 3, "h2": 3, "h3": 3, "h4": 2, "h5": 2, "h6": 2, "article": 1, "aside": 1, "body": 1, "div": 1, "footer": 1, "form": 1,
    "header": 1, "html": 1, "main": 1, "nav": 1, "section": 1, "dl": 2, "dt": 1, "dd": 1,
}
AFTER_HEADING = 2
HEADING_MARKS = {"h1": "# ", "h2": "## ", "h3": "### "}
SKIPPED = ("script", "style", "head", "noscript")
BULLET, QUOTE, RULE = " * ", "> ", 40
WRAP, COLUMN_WIDTH, COLUMN_GAP = 130, 60, 3
MAX_SPAN = 1000

_SKIP = "|".join(rf"<{name}\b[^>]*>.*?(?:</{name}\s*>|\Z)" for name in SKIPPED)
_TOKEN = re.compile(rf"(?P<gone><!--.*?(?:-->|\Z)|{_SKIP}|<[!?][^>]*(?:>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_WORD = re.compile(r"[^ \t\r\n\f]+")


def _wrapped(words: list[str], width: int) -> str:
    lines, line, room = [], [], 0
    for word in words:
        if line and room + len(line) + len(word) > width:
            lines.append(" ".join(line))
            line, room = [], 0
        line.append(word)
        room += len(word)
    return "\n".join([*lines, " ".join(line)])


class _Block:
    """An open block: finished text, the inline run under way, line breaks owed before the next text."""

    def __init__(self, kind: str, width: int, prefix: str = "", owed: int = 0):
        self.kind, self.width, self.prefix = kind, max(width, 20), prefix
        self.out, self.run, self.owed, self.brs = [], [], 0, 0
        self.outer = owed  # breaks around this block in the one that holds it

    def put(self, text: str) -> None:
        if self.out:
            self.out.append("\n" * max(self.owed, 1))
        self.out.append(text)
        self.owed = self.brs = 0

    def flush(self) -> None:
        words = _WORD.findall("".join(self.run))
        self.run = []
        if words:
            self.put(_wrapped(words, self.width))

    def breaks(self, n: int) -> None:
        self.flush()
        self.owed = max(self.owed, n)

    def line(self) -> None:
        self.flush()
        self.brs += 1
        self.owed = max(self.owed, self.brs)

    def text(self) -> str:
        self.flush()
        return "".join(self.out)


class _Table:
    """Rows of an open table; each cell is (text, columns it spans)."""

    def __init__(self):
        self.rows: list[list[tuple[str, int]]] = []

    def text(self) -> str:
        placed, widths = [], []
        for row in self.rows:
            at, cells = 0, []
            for text, span in row:
                lines = text.split("\n")
                cells.append((at, lines))
                widths += [0] * (at + span - len(widths))
                if span == 1:
                    widths[at] = max(widths[at], *map(len, lines))
                at += span
            placed.append(cells)
        starts = [0]
        for width in widths:
            starts.append(starts[-1] + width + COLUMN_GAP)
        lines = []
        for cells in placed:
            for i in range(max((len(c) for _, c in cells), default=0)):
                line = ""
                for at, cell in cells:
                    if i < len(cell) and cell[i]:
                        gap = COLUMN_GAP if line else 0
                        line += " " * max(starts[at] - len(line), gap) + cell[i]
                lines.append(line)
        return "\n".join(lines)


class _Layout:
    """The stack of open blocks; one method per kind of tag."""

    def __init__(self, wrap: int, marks: bool):
        self.marks, self.tables, self.lists, self.upper = marks, [], [], False
        self.stack = [_Block("page", wrap)]

    @property
    def top(self) -> _Block:
        return self.stack[-1]

    def close(self) -> None:
        """The innermost block goes, as text, into the one around it."""
        block = self.stack.pop()
        text = block.text()
        if block.kind == "cell":
            self.tables[-1].rows[-1].append((text, int(block.prefix)))
        elif block.kind == "table":
            self.top.breaks(block.outer)
            table = self.tables.pop().text()
            if text or table:
                self.top.put("\n".join(t for t in (text, table) if t))
            self.top.breaks(block.outer)
        elif block.kind == "list":
            self.lists.pop()
            self.top.breaks(block.outer)
            if text:
                self.top.put(text)
            self.top.breaks(block.outer)
        else:
            rest = "\n" + (block.prefix if block.kind == "blockquote" else " " * len(block.prefix))
            self.top.breaks(block.outer)
            if text or block.kind == "li":
                self.top.put((block.prefix + text.replace("\n", rest)).rstrip(" "))
            self.top.breaks(block.outer)

    def close_to(self, kind: str, fence: tuple[str, ...] = ()) -> bool:
        """Closes blocks up to the innermost of this kind; nothing if a fence lies before it."""
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].kind == kind:
                while len(self.stack) > depth:
                    self.close()
                return True
            if self.stack[depth].kind in fence:
                return False
        return False

    def open(self, kind: str, prefix: str = "", owed: int = 0, width: int | None = None) -> None:
        self.top.flush()
        self.stack.append(_Block(kind, (width or self.top.width) - (len(prefix) if kind != "cell" else 0), prefix, owed))

    def list_tag(self, tag: str, end: str, attrs: str) -> None:
        if end:
            self.close_to("list", ("table",))
            return
        self.open("list", owed=1 if self.lists else 2)
        start = re.search(r"\bstart\s*=\s*[\"']?(-?\d{1,9})", attrs, re.I)
        self.lists.append(None if tag == "ul" else int(start[1]) if start else 1)

    def item_tag(self, end: str) -> None:
        self.close_to("li", ("list", "table"))
        if end:
            return
        mark = BULLET
        if self.lists and self.lists[-1] is not None:
            mark = f" {self.lists[-1]}. "
            self.lists[-1] += 1
        self.open("li", mark, 1)

    def table_tag(self, tag: str, end: str, attrs: str) -> None:
        if tag == "table":
            if end:
                self.close_to("table")
            else:
                self.open("table", owed=2)
                self.tables.append(_Table())
            return
        if not self.tables:
            self.top.breaks(1)
            return
        if self.close_to("cell", ("table",)):
            self.upper = False
        if tag == "tr":
            if not end:
                self.tables[-1].rows.append([])
        elif not end:
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            span = re.search(r"\bcolspan\s*=\s*[\"']?(\d{1,9})", attrs, re.I)
            self.open("cell", str(min(max(int(span[1]), 1), MAX_SPAN)) if span else "1", width=COLUMN_WIDTH)
            self.upper = tag == "th"  # header cells are in capitals

    def tag(self, tag: str, end: str, attrs: str) -> None:
        if tag == "br":
            self.top.line()
        elif tag in ("ul", "ol"):
            self.list_tag(tag, end, attrs)
        elif tag == "li":
            self.item_tag(end)
        elif tag in ("table", "tr", "td", "th"):
            self.table_tag(tag, end, attrs)
        elif tag == "blockquote":
            if not end:
                self.open("blockquote", QUOTE, 2)
            else:
                self.close_to("blockquote", ("cell",))
        elif tag == "hr":
            self.top.breaks(2)
            self.top.put("-" * min(self.top.width, RULE))
            self.top.breaks(2)
        elif tag in BREAKS:
            self.top.breaks(AFTER_HEADING if end and tag in HEADING_MARKS else BREAKS[tag])
            if tag[0] == "h" and tag[1:].isdigit():
                mark = HEADING_MARKS.get(tag, "") if self.marks else ""
                self.upper = not end and not mark
                if mark and not end:
                    self.top.run.append(mark)


def _laid_out(page: str, wrap: int, marks: bool) -> str:
    """The text of one page."""
    layout, pre = _Layout(wrap, marks), None
    for token in _TOKEN.finditer(page):
        tag = (token["tag"] or "").lower()
        if tag == "pre" or pre is not None:
            # inside a pre block only its end and line breaks count as tags
            if pre is None:
                if not token["end"]:
                    layout.top.breaks(1)
                    pre = []
            elif tag == "pre" and token["end"]:
                kept = "".join(pre).replace("\r\n", "\n").strip("\n")
                pre = None
                if kept:
                    layout.top.put(kept)
                layout.top.breaks(1)
            elif token["text"]:
                pre.append(unescape(token["text"]))
            elif tag == "br":
                pre.append("\n")
        elif tag:
            layout.tag(tag, token["end"], token["attrs"])
        elif token["text"]:
            text = unescape(token["text"])
            layout.top.run.append(text.upper() if layout.upper else text)
    if pre:
        layout.top.put("".join(pre).strip("\n"))
    while len(layout.stack) > 1:
        layout.close()
    return layout.top.text()


def page_text(col: Column, wrap: int = WRAP, marks: bool = True) -> Column:
    """HTML as laid-out text, lines of at most ``wrap`` characters.

    With ``marks`` the first three heading levels start with ``#`` marks;
    without them, as for mail, and at deeper levels, headings are in capitals.
    """

    @F.pandas_udf("string")
    def laid_out(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([None if p is None else _laid_out(p, wrap, marks) for p in pages], dtype=object)

    return laid_out(col)
