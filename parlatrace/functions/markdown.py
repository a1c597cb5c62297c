"""Markdown to HTML: paragraphs, headings, lists, quotes, rules, emphasis, code, links, fenced code and tables."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_INLINE = (
    (re.compile(r"\*\*(.+?)\*\*|__(.+?)__"), lambda m: f"<strong>{m[1] or m[2]}</strong>"),
    (re.compile(r"(?<![\w*])\*(?![\s*])(.+?)(?<![\s*])\*(?![\w*])|(?<![\w_])_(?![\s_])(.+?)(?<![\s_])_(?![\w_])"), lambda m: f"<em>{m[1] or m[2]}</em>"),
    (re.compile(r"\[([^\]]+)\]\(([^()\s]+)\)"), lambda m: f'<a href="{m[2]}">{m[1]}</a>'),
)
_RULE, _HEADING, _ITEM, _FENCE = re.compile(r"^\s{0,3}([-*_])(\s*\1){2,}\s*$"), re.compile(r"^(#{1,6})\s+(.*?)\s*#*$"), re.compile(r"^\s{0,3}(?:([-*+])|(\d+)[.)])\s+(.*)$"), re.compile(r"^\s{0,3}(```|~~~)\s*(\w*)")
_DIVIDER = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def _inline(text: str) -> str:
    parts = re.split(r"(`[^`]+`)", text)
    for i, p in enumerate(parts):
        if p.startswith("`") and p.endswith("`") and len(p) > 2:
            parts[i] = f"<code>{html.escape(p[1:-1], quote=False)}</code>"
        else:
            p = html.escape(p, quote=False)
            for pattern, new in _INLINE:
                p = pattern.sub(new, p)
            parts[i] = p
    return "".join(parts)


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def to_html(source: str | None) -> str | None:
    """HTML of a Markdown text, blocks on lines of their own; null gives null, empty gives empty. HTML in the text is escaped."""
    if source is None:
        return None
    lines, out, i = source.replace("\r\n", "\n").split("\n"), [], 0
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            body = []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(m[1]):
                body.append(lines[i])
                i += 1
            kind = f' class="language-{m[2]}"' if m[2] else ""
            out.append(f"<pre><code{kind}>{html.escape(chr(10).join(body), quote=False)}\n</code></pre>")
            i += 1
        elif not line.strip():
            i += 1
        elif m := _HEADING.match(line):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
            i += 1
        elif _RULE.match(line):
            out.append("<hr />")
            i += 1
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _DIVIDER.match(lines[i + 1]):
            head = _cells(line)
            rows = []
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append((_cells(lines[i]) + [""] * len(head))[: len(head)])
                i += 1
            row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{_inline(c)}</{tag}>" for c in cells) + "</tr>"
            out.append("<table>\n<thead>\n" + row(head, "th") + "\n</thead>\n<tbody>\n" + "".join(row(r, "td") + "\n" for r in rows) + "</tbody>\n</table>")
        elif m := _ITEM.match(line):
            tag, items = ("ol" if m[2] else "ul"), []
            while i < len(lines) and ((m := _ITEM.match(lines[i])) or (items and lines[i].startswith("  ") and lines[i].strip())):
                if m:
                    items.append(m[3])
                else:
                    items[-1] += "\n" + lines[i].strip()
                i += 1
            out.append(f"<{tag}>\n" + "".join(f"<li>{_inline(x)}</li>\n" for x in items) + f"</{tag}>")
        elif line.lstrip().startswith(">"):
            body = []
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                body.append(lines[i].lstrip()[1:].removeprefix(" "))
                i += 1
            out.append(f"<blockquote>\n{to_html(chr(10).join(body))}\n</blockquote>")
        else:
            body = []
            while i < len(lines) and lines[i].strip() and not (_HEADING.match(lines[i]) or _FENCE.match(lines[i]) or body and _ITEM.match(lines[i])):
                body.append(lines[i].strip())
                i += 1
            out.append(f"<p>{_inline(chr(10).join(body))}</p>")
    return "\n".join(out)


@F.pandas_udf(StringType())
def markdown_to_html(text: pd.Series) -> pd.Series:
    return text.map(to_html, na_action="ignore")
