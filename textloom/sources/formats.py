"""Readers of single formats: bytes to Markdown, without Spark."""

from __future__ import annotations

import csv
import html
import io
import json
import os
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import quote, urlsplit, urlunsplit


class Unsupported(ValueError):
    """No reader takes this file."""


def decode(data: bytes, charset: str | None = None) -> str:
    """Text by the given charset, else UTF-8, else Windows-1252 with unknown bytes dropped."""
    if charset:
        return data.decode(charset)
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "ignore")


def normalize(markdown: str) -> str:
    """No white space at line ends, no more than one blank line in a row."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in re.split(r"\r?\n", markdown)))


# ---- tables -----------------------------------------------------------------------------------


def _cell(value: str) -> str:
    escaped = re.sub(r"(\\*)\|", lambda m: m[1] * 2 + r"\|", value)
    return re.sub(r"\r\n|\n|\r", " ", escaped)


def markdown_table(rows: list[list[str]]) -> str:
    """A table padded to its widest row; blank rows at its start, after the header and at its end go."""
    filled = [i for i, r in enumerate(rows) if r]
    if not filled:
        return ""
    body = [i for i in filled if i > filled[0]]
    keep = [rows[filled[0]], *(rows[body[0] : body[-1] + 1] if body else [])]
    width = max(map(len, keep))
    line = lambda cells: "| " + " | ".join([*map(_cell, cells), *[""] * (width - len(cells))]) + " |"
    return "\n".join([line(keep[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, keep[1:])])


def read_csv(data: bytes, charset: str | None = None, **_) -> tuple[str, str | None]:
    return markdown_table(list(csv.reader(io.StringIO(decode(data, charset).lstrip("﻿"), newline="")))), None


def read_text(data: bytes, charset: str | None = None, **_) -> tuple[str, str | None]:
    return decode(data, charset), None


def read_notebook(data: bytes, **_) -> tuple[str, str | None]:
    book = json.loads(decode(data).lstrip("﻿"))
    out, title = [], None
    for cell in book.get("cells", []):
        source = cell.get("source", [])
        text = "".join(source)
        kind = cell.get("cell_type")
        if kind == "markdown":
            out.append(text)
            heads = [x[2:].strip() for x in (source if isinstance(source, list) else source.split("\n")) if x.startswith("# ")]
            title = title if title is not None or not heads else heads[0]
        elif kind in ("code", "raw"):
            out.append(f"```{'python' if kind == 'code' else ''}\n{text}\n```")
    return "\n\n".join(out), book.get("metadata", {}).get("title", title)


# ---- HTML -------------------------------------------------------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEADS = {f"h{i}": i for i in range(1, 7)}
_FLOW = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "form", "address", "dl", "dt", "dd", "fieldset", "ul", "ol", "table", "blockquote", "pre", "hr", *_HEADS}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag, attrs=None, up=None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs or {}, [], up


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        if tag in _FLOW and tag != "p":
            n = self.at
            while n.up and n.tag not in _FLOW and n.tag not in ("td", "th", "li"):
                n = n.up
            if n.tag == "p":
                self.at = n.up
        elif tag in ("p", "li", "td", "th", "tr"):
            ends = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}[tag]
            n = self.at
            while n.up and n.tag not in ends and n.tag not in {"ul", "ol", "table", "div", "article", "body", "blockquote"} - ends:
                n = n.up
            while n.up and n.tag in ends:
                self.at = n = n.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.up and n.tag != tag:
            n = n.up
        if n.up:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def parse_html(text: str) -> Node:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    return tree.root


def parse_page(data: bytes, charset: str | None = None) -> Node:
    """The tree of a page's bytes; a charset that does not hold to their end is passed over, as browsers do."""
    try:
        return parse_html(decode(data, charset))
    except (UnicodeDecodeError, LookupError):
        return parse_html(decode(data))


def find(node: Node, tag: str, test=lambda n: True) -> Node | None:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag == tag and test(n):
            return n
        stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return None


def plain(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in ("script", "style"):
            stack += reversed(n.kids)
    return "".join(out)


def _link(href: str) -> str | None:
    """The address with its path quoted (escapes kept); None for schemes other than http, https and file."""
    try:
        parts = urlsplit(href)
    except ValueError:
        return None
    if parts.scheme and parts.scheme.lower() not in ("http", "https", "file"):
        return None
    path = "".join(x if re.fullmatch("%[0-9A-Fa-f]{2}", x) else quote(x) for x in re.split("(%[0-9A-Fa-f]{2})", parts.path))
    return urlunsplit(parts._replace(path=path))


class Writer:
    """Markdown of a tree."""

    def __init__(self, keep_data_uris: bool = False):
        self.keep = keep_data_uris

    def flow(self, node: Node, depth: int = 0, ordered: int = 0) -> str:
        blocks: list[str] = []
        line: list[str] = []

        def end():
            text = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t\r\f\v]+", " ", "".join(line))).strip()
            if text:
                blocks.append(text)
            line.clear()

        for kid in node.kids:
            if isinstance(kid, str):
                line.append(re.sub(r"\s+", " ", kid))
            elif kid.tag in ("script", "style", "head", "title"):
                continue
            elif kid.tag in _HEADS:
                end()
                text = self.inline(kid).strip()
                if text:
                    blocks.append("#" * _HEADS[kid.tag] + " " + text.replace("\n", " "))
            elif kid.tag == "pre":
                end()
                blocks.append("```\n" + plain(kid).strip("\n") + "\n```")
            elif kid.tag == "blockquote":
                end()
                blocks.append("\n".join("> " + x if x else ">" for x in self.flow(kid).split("\n")))
            elif kid.tag in ("ul", "ol"):
                end()
                blocks.append(self.items(kid, depth))
            elif kid.tag == "table":
                end()
                blocks.append(self.table(kid))
            elif kid.tag == "hr":
                end()
                blocks.append("---")
            elif kid.tag in _FLOW or kid.tag in ("html", "body", "li", "tr", "td", "th", "tbody", ""):
                end()
                inner = self.flow(kid, depth)
                if inner:
                    blocks.append(inner)
            else:
                line.append(self.span(kid))
        end()
        return "\n\n".join(b for b in blocks if b)

    def items(self, node: Node, depth: int) -> str:
        out = []
        start = int(node.attrs.get("start", "1")) if node.attrs.get("start", "1").isdigit() else 1
        for n, kid in enumerate(k for k in node.kids if isinstance(k, Node) and k.tag == "li"):
            mark = f"{start + n}. " if node.tag == "ol" else "*+-"[depth % 3] + " "
            text = re.sub(r"\n\n(?=[ ]*([*+-]|\d+\.) )", "\n", self.flow(kid, depth + 1))
            out.append(mark + text.replace("\n", "\n" + " " * len(mark)))
        return "\n".join(out)

    def table(self, node: Node) -> str:
        rows, stack = [], [node]
        while stack:
            n = stack.pop()
            if n.tag == "tr":
                rows.append([re.sub(r"\s+", " ", self.flow(c)).strip() for c in n.kids if isinstance(c, Node) and c.tag in ("td", "th")])
            else:
                stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
        return markdown_table(rows)

    def inline(self, node: Node) -> str:
        return "".join(re.sub(r"\s+", " ", k) if isinstance(k, str) else self.span(k) for k in node.kids)

    def span(self, node: Node) -> str:
        tag, text = node.tag, ""
        if tag in ("script", "style"):
            return ""
        if tag == "br":
            return "  \n"
        if tag == "img":
            src = node.attrs.get("src", "")
            lazy = node.attrs.get("data-src", "")
            if lazy and (not src or src[:5].lower() == "data:" and not self.keep):
                src = lazy
            if src[:5].lower() == "data:" and not self.keep:
                src = src.split(",")[0] + "..."
            title = node.attrs.get("title")
            return f"![{node.attrs.get('alt', '').replace(chr(10), ' ')}]({src}" + (' "' + title.replace('"', '\\"') + '"' if title else "") + ")"
        if tag == "input":
            return ("[x] " if "checked" in node.attrs else "[ ] ") if node.attrs.get("type") == "checkbox" else ""
        text = self.flow(node) if any(isinstance(k, Node) and k.tag in _FLOW for k in node.kids) else self.inline(node)
        core = text.strip()
        if not core:
            return " " if text else ""
        before, after = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
        if tag in ("b", "strong"):
            core = f"**{core}**"
        elif tag in ("i", "em"):
            core = f"*{core}*"
        elif tag in ("s", "del", "strike"):
            core = f"~~{core}~~"
        elif tag == "u":
            core = f"<u>{core}</u>"
        elif tag in ("code", "kbd", "samp"):
            core = f"`{core}`"
        elif tag == "a" and node.attrs.get("href"):
            href = _link(node.attrs["href"])
            title = node.attrs.get("title")
            if href is not None:
                core = f"<{href}>" if core == href and not title else f"[{core}]({href}" + (' "' + title.replace('"', '\\"') + '"' if title else "") + ")"
        return before + core + after


def read_html(data: bytes, keep_data_uris: bool = False, strict: bool = False, charset: str | None = None, **_) -> tuple[str, str | None]:
    """Markdown of the body (or of all), and the title. A page too deep to lay out gives its plain text, unless strict."""
    root = parse_page(data, charset)
    title = find(root, "title")
    body = find(root, "body") or root
    try:
        text = Writer(keep_data_uris).flow(body).strip()
    except RecursionError:
        if strict:
            raise
        text = plain(body).strip()
    return text, plain(title).strip() if title else None


def read_zip(data: bytes, name: str = "(unknown)", depth: int = 3, **options) -> tuple[str, str | None]:
    """Each member that a reader takes under its own heading; others are left out. Archives nest up to depth."""
    out = [f"Content from the zip file `{name}`:"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for entry in z.infolist():
            if entry.is_dir():
                continue
            try:
                if depth or not entry.filename.lower().endswith(".zip"):
                    text, _ = convert(z.read(entry), entry.filename, depth=depth - 1, **options)
                    out.append(f"## File: {entry.filename}\n\n{text}")
            except (ValueError, zipfile.BadZipFile, KeyError, RuntimeError):
                continue
    return "\n\n".join(out).strip(), None


#: extension: readers in the order in which they are tried
READERS = {
    ".csv": [read_csv], ".html": [read_html], ".htm": [read_html], ".ipynb": [read_notebook, read_text], ".zip": [read_zip],
    **{e: [read_text] for e in (".txt", ".text", ".md", ".markdown", ".json", ".jsonl")},
}


def register(extensions: list[str], *readers) -> None:
    """Readers for extensions, tried before those known already."""
    for e in extensions:
        READERS[e] = [*readers, *READERS.get(e, [])]


#: the first bytes of files without a known extension
MAGIC = [(b"PK\x03\x04", ".zip"), (b"<!DOCTYPE html", ".html"), (b"<html", ".html")]


#: addresses of encyclopedia pages; a fixed value
WIKI = re.compile(r"https?://[a-zA-Z]{2,3}\.wikipedia.org/")


def read_wiki(data: bytes, charset: str | None = None, **options) -> tuple[str, str | None]:
    """The content block of an encyclopedia page under its title; the whole page where there is none."""
    root = parse_page(data, charset)
    seek = lambda tag, key, value: find(root, tag, lambda n: value in n.attrs.get(key, "").split())
    body, head, title = seek("div", "id", "mw-content-text"), seek("span", "class", "mw-page-title-main"), find(root, "title")
    name = (plain(head) if body and head else plain(title) if title else "").strip() or None
    text = Writer(options.get("keep_data_uris", False)).flow(body or root).strip()
    return (f"# {name}\n\n" if body and name else "") + text, name


def convert(data: bytes, name: str, **options) -> tuple[str, str | None]:
    """(Markdown, title) by the first reader that succeeds (option url: the address of the file); raises Unsupported, or ValueError with all failures."""
    ext = os.path.splitext(name)[1].lower()
    readers = READERS.get(ext) or next((READERS[e] for magic, e in MAGIC if data[: len(magic)].lower() == magic.lower()), None)
    if not readers:
        raise Unsupported(name)
    if read_html in readers and WIKI.match(options.get("url") or ""):
        readers = [read_wiki, *readers]
    failed = []
    for read in readers:
        try:
            text, title = read(data, name=name, **options)
            return normalize(text), title
        except Exception as e:  # a reader's failure passes the file on
            failed.append(f"{read.__name__}: {type(e).__name__}: {e}")
    raise ValueError("; ".join(failed))


def unescape(text: str) -> str:
    return html.unescape(text)
