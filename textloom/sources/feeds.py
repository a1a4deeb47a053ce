"""RSS and Atom feeds to Markdown."""

from __future__ import annotations

import textwrap
from urllib.parse import urljoin
from xml.etree import ElementTree as ET

from textloom.sources import formats

# Namespaces of feeds; fixed values.
ATOM = "{http://www.w3.org/2005/Atom}"
ENCODED = "{http://purl.org/rss/1.0/modules/content/}encoded"
XHTML = "{http://www.w3.org/1999/xhtml}"
BASE = "{http://www.w3.org/XML/1998/namespace}base"


def _flat(text: str | None) -> str | None:
    """Lines joined by one space; None for blank."""
    return " ".join(x for x in map(str.strip, (text or "").splitlines()) if x) or None


def _base(path: list[ET.Element], url: str) -> str:
    for e in path:
        url = urljoin(url, e.get(BASE, ""))
    return url


def _markdown(markup: str, base: str) -> str:
    """Markdown of an HTML fragment whose links are resolved against base."""
    tree = formats.parse_html(markup)
    stack = [tree]
    while stack and base:
        node = stack.pop()
        for name in ("href", "src"):
            if node.attrs.get(name):
                node.attrs[name] = urljoin(base, node.attrs[name])
        stack += [k for k in node.kids if isinstance(k, formats.Node)]
    return formats.Writer().flow(tree).strip()


def _kind(declared: str | None, media: bool) -> str:
    """text, html, xhtml or binary, by an Atom type attribute; media types count on content only."""
    t = (declared or "text").split(";")[0].strip().lower()
    if t in ("text", "html", "xhtml"):
        return t
    if not media:
        return "text"
    if t == "text/html":
        return "html"
    if t == "application/xhtml+xml" or t.endswith(("+xml", "/xml")):
        return "xhtml"
    return "text" if t.startswith("text/") else "binary"


def _inner(e: ET.Element) -> str:
    """The markup inside an element, without namespace prefixes."""
    out = [(e.text or "").replace("&", "&amp;").replace("<", "&lt;")]
    for kid in e:
        tag = kid.tag.rsplit("}", 1)[-1]
        attrs = "".join(f' {k.rsplit("}", 1)[-1]}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in kid.attrib.items())
        out.append(f"<{tag}{attrs}>{_inner(kid)}</{tag}>" + (kid.tail or "").replace("&", "&amp;").replace("<", "&lt;"))
    return "".join(out)


def _atom(e: ET.Element | None, media: bool = False) -> tuple[str | None, bool]:
    """(value, is markup) of an Atom text construct or content."""
    if e is None:
        return None, True
    kind = _kind(e.get("type"), media)
    if kind == "binary":
        return None, True
    if kind == "xhtml":
        return _inner(e) or None, True
    value = "".join(e.itertext())
    if kind == "html":
        return value or None, True
    first, *rest = value.splitlines() or [""]
    return "\n".join([first, textwrap.dedent("\n".join(rest))] if rest else [first]).strip(), False


def _atom_line(e: ET.Element | None) -> str | None:
    value, markup = _atom(e)
    return _flat(formats.Writer().flow(formats.parse_html(value)) if value and markup else value)


def _entry(head: str | None, dated: str, date: str | None, bodies: list[str | None]) -> str:
    out = (f"\n## {head}\n" if head else "") + (f"{dated}: {date}\n" if date else "")
    return out + "\n\n".join(b for b in bodies if b)


def _join(parts: list[str]) -> str:
    """Parts one after another, a blank line before a part that would run into unfinished text."""
    out = ""
    for p in parts:
        out += ("\n\n" if out and p and not out.endswith("\n") and not p.startswith("\n") else "") + p
    return out


def read_feed(data: bytes, url: str = "", **_) -> tuple[str, str | None]:
    """Title, then each item with its date and text. ValueError for XML that is no feed."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        raise ValueError(f"no XML: {e}") from e
    if root.tag == "rss":
        channel = root.find("channel")
        if channel is None:
            raise ValueError("feed without a channel")
        title, about = _flat(channel.findtext("title")), channel.findtext("description")
        parts = [(f"# {title}\n" if title else "") + (f"{about}\n" if about else "")]
        for item in channel.findall("item"):
            bodies = [_markdown("".join(f.itertext()), _base([root, channel, item, f], url)) for f in (item.find("description"), item.find(ENCODED)) if f is not None]
            parts.append(_entry(_flat(item.findtext("title")), "Published on", _flat(item.findtext("pubDate")), bodies))
        return _join(parts), title
    ns = ATOM if root.tag == f"{ATOM}feed" else "" if root.tag == "feed" else None
    entries = root.findall(f"{ns}entry") if ns is not None else []
    if not entries:
        raise ValueError("no feed")
    title, about = _atom_line(root.find(f"{ns}title")), _atom_line(root.find(f"{ns}subtitle"))
    parts = [(f"# {title}\n" if title else "") + (f"{about}\n" if about else "")]
    for entry in entries:
        bodies = []
        for name in ("summary", "content"):
            e = entry.find(f"{ns}{name}")
            value, markup = _atom(e, media=name == "content")
            bodies.append(_markdown(value, _base([root, entry, e], url)) if value and markup else value)
        parts.append(_entry(_atom_line(entry.find(f"{ns}title")), "Updated on", _flat(entry.findtext(f"{ns}updated")), bodies))
    return _join(parts), title


formats.register([".rss", ".atom"], read_feed)
formats.register([".xml"], read_feed, formats.read_text)
