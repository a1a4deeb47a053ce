"""Markdown as HTML: headings, paragraphs, lists, tables, quotes, fences, rules and inline marks."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_INLINE = [
    (re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)"), r'<img src="\2" alt="\1" />'), (re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>'),
    (re.compile(r"\*\*([^*]+)\*\*"), r"<strong>\1</strong>"), (re.compile(r"(?<![*\w])\*([^*\s][^*]*)\*(?!\*)"), r"<em>\1</em>"), (re.compile(r"~~([^~]+)~~"), r"<s>\1</s>"),
]
_ITEM = re.compile(r"(\s*)(?:[*+-]|(\d+)\.)\s+(.*)")


def inline(text: str) -> str:
    """Marks inside a line; code spans are left as they stand."""
    out = []
    for i, piece in enumerate(re.split(r"`([^`]+)`", text)):
        if i % 2:
            out.append(f"<code>{html.escape(piece, quote=False)}</code>")
        else:
            piece = html.escape(piece, quote=True)
            for rx, to in _INLINE:
                piece = rx.sub(to, piece)
            out.append(piece)
    return "".join(out)


def blocks(text: str) -> list[tuple[str, object]]:
    """(kind, content) of a Markdown text: head, fence, table, list, quote, rule, math, paragraph."""
    lines = text.split("\n")
    out: list[tuple[str, object]] = []
    i = 0
    while i < len(lines):
        line = lines[i].strip()
        at = i
        i += 1
        if not line:
            continue
        if line.startswith("```") or line == "$$":
            end = "```" if line.startswith("```") else "$$"
            while i < len(lines) and lines[i].strip() != end:
                i += 1
            out.append(("fence" if end == "```" else "math", (line[3:].strip(), "\n".join(lines[at + 1 : i]))))
            i += 1
        elif m := re.fullmatch(r"(#{1,6})\s+(.*?)\s*#*", line):
            out.append(("head", (len(m[1]), m[2])))
        elif re.fullmatch(r"([-*_])(?:\s*\1){2,}", line):
            out.append(("rule", None))
        elif line.startswith("|") and line.endswith("|") and len(line) > 1:
            while i < len(lines) and lines[i].strip().startswith("|"):
                i += 1
            rows = [[c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", x.strip()[1:-1])] for x in lines[at:i]]
            body = [r for n, r in enumerate(rows) if not (n == 1 and all(re.fullmatch(":?-+:?", c) for c in r))]
            out.append(("table", (body, len(body) < len(rows))))
        elif line.startswith(">"):
            while i < len(lines) and lines[i].strip().startswith(">"):
                i += 1
            out.append(("quote", "\n".join(re.sub(r"^\s*>\s?", "", x) for x in lines[at:i])))
        elif _ITEM.fullmatch(lines[at]):
            while i < len(lines) and _ITEM.fullmatch(lines[i]):
                i += 1
            out.append(("list", [(len(m[1].expandtabs(4)), m[2] is not None, m[3]) for x in lines[at:i] if (m := _ITEM.fullmatch(x))]))
        else:
            while i < len(lines) and lines[i].strip() and not re.match(r"\s*(?:#{1,6}\s|```|\||>|(?:[*+-]|\d+\.)\s)", lines[i]):
                i += 1
            out.append(("paragraph", "\n".join(x.strip() for x in lines[at:i])))
    return out


def _list(items: list[tuple[int, bool, str]]) -> str:
    out, open_ = "", []
    for indent, ordered, text in items:
        tag = "ol" if ordered else "ul"
        while open_ and open_[-1][0] > indent:
            out += f"</li></{open_.pop()[1]}>"
        if open_ and open_[-1][0] == indent:
            out += "</li>"
        else:
            open_.append((indent, tag))
            out += f"<{tag}>"
        box = re.match(r"\[([ xX])\] (.*)", text)
        out += "<li>" + (f'<input type="checkbox" disabled{" checked" if box[1] != " " else ""} /> {inline(box[2])}' if box else inline(text))
    while open_:
        out += f"</li></{open_.pop()[1]}>"
    return out


def to_html(text: str) -> str:
    out = []
    for kind, x in blocks(text):
        if kind == "head":
            out.append(f"<h{x[0]}>{inline(x[1])}</h{x[0]}>")
        elif kind == "fence":
            out.append(f"<pre><code{f' class="language-{html.escape(x[0])}"' if x[0] else ''}>{html.escape(x[1], quote=False)}\n</code></pre>")
        elif kind == "math":
            out.append(f"<p>$${html.escape(x[1], quote=False)}$$</p>")
        elif kind == "rule":
            out.append("<hr />")
        elif kind == "table":
            rows, headed = x
            line = lambda r, t: "<tr>" + "".join(f"<{t}>{inline(c)}</{t}>" for c in r) + "</tr>"
            head = f"<thead>{line(rows[0], 'th')}</thead>" if headed and rows else ""
            out.append(f"<table>{head}<tbody>{''.join(line(r, 'td') for r in rows[headed:])}</tbody></table>")
        elif kind == "quote":
            out.append(f"<blockquote>{to_html(x)}</blockquote>" if x.count(">") < 50 else f"<blockquote><p>{inline(x)}</p></blockquote>")
        elif kind == "list":
            out.append(_list(x))
        else:
            out.append(f"<p>{inline(x)}</p>")
    return "\n".join(out)


@pandas_udf(StringType())
def html_column(texts: pd.Series) -> pd.Series:
    """Markdown columns as HTML; null stays null."""
    return pd.Series([None if t is None else to_html(t) for t in texts], dtype=object)
