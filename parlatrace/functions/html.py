"""HTML to text. Character references need a table the JVM functions lack, so these run as Arrow batches."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TAG = re.compile(r"<[^>]+>")
_SPACE = re.compile(r"\s+")
BLOCKS = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"br", "hr", "img", "meta", "link", "input", "wbr", "col", "area", "base", "embed", "source", "track"}


def plain_text(source: str | None) -> str | None:
    """Everything matching <[^>]+> dropped, then references decoded, white space collapsed to one space, ends trimmed."""
    return None if source is None else _SPACE.sub(" ", html.unescape(_TAG.sub("", source))).strip()


class _Reader(HTMLParser):
    """Builds the text bottom up: a block is its trimmed content between line breaks, br is a line break, other tags are transparent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = [("", [])]

    def handle_data(self, data: str) -> None:
        self.open[-1][1].append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.open[-1][1].append("\n")
        elif tag not in VOID:
            self.open.append((tag, []))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.open[-1][1].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open[1:]):
            while True:
                name = self._close()
                if name == tag:
                    break

    def _close(self) -> str:
        name, parts = self.open.pop()
        text = "".join(parts)
        self.open[-1][1].append("\n" + text.strip() + "\n" if name in BLOCKS else text)
        return name

    def text(self) -> str:
        self.close()
        while len(self.open) > 1:
            self._close()
        return "".join(self.open[0][1])


def block_text(source: str | None) -> str | None:
    """The text of an HTML tree with line breaks around blocks; only the body where there is one."""
    if source is None:
        return None
    at = re.search(r"<body[^>]*>", source, re.I)
    end = re.search(r"</body\s*>", source, re.I)
    reader = _Reader()
    reader.feed(source[at.end() if at else 0 : end.start() if end else len(source)])
    return reader.text()


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """All named and numeric character references decoded; null stays null."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def html_to_plain(text: pd.Series) -> pd.Series:
    return text.map(plain_text, na_action="ignore")


@F.pandas_udf(StringType())
def html_to_blocks(text: pd.Series) -> pd.Series:
    return text.map(block_text, na_action="ignore")
