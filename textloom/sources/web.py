"""Readers of pages of known sites: encyclopedia articles, video pages, search results."""

from __future__ import annotations

import base64
import binascii
import json
import re
from urllib.parse import parse_qs, urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.sources import formats
from textloom.sources.formats import Node, Writer, find, parse_page, plain

VIDEO = re.compile(r"https?://(?:www\.|m\.)?(?:youtube\.com/(?:watch\?|shorts/|embed/)|youtu\.be/.)", re.I)
RESULTS = re.compile(r"https://www\.bing\.com/search\?q=")


def video_id(url: Column) -> Column:
    """Video of an address in any of its forms; null for others."""
    host = F.lower(F.regexp_extract(url, "^https?://([^/?#]*)", 1))
    path = F.filter(F.split(F.regexp_extract(url, "^https?://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    own = F.nullif(F.regexp_extract(url, "[?&]v=([^&#]+)", 1), F.lit(""))
    return F.when(host.isin("youtu.be", "www.youtu.be"), F.get(path, F.lit(0))).when(
        host.isin("youtube.com", "www.youtube.com", "m.youtube.com"), F.when(F.get(path, F.lit(0)) == "watch", own).when(F.get(path, F.lit(0)).isin("shorts", "embed"), F.get(path, F.lit(1)))
    )


def find_key(value, key: str):
    """The first value under a key anywhere in nested lists and maps, depth first; null and empty ones are passed over below the top."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if key in v:
                return v[key]
            stack += reversed(list(v.values()))
        elif isinstance(v, list):
            stack += reversed(v)
    return None


def every(node: Node, test) -> list[Node]:
    """All elements that pass a test, in page order."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, Node):
            if test(n):
                out.append(n)
            stack += reversed(n.kids)
    return out


def read_video(data: bytes, charset: str | None = None, **options) -> tuple[str, str | None]:
    """Title, figures and description from a video page's metadata; transcripts need a service. A page without metadata is read as any page."""
    root = parse_page(data, charset)
    meta: dict[str, str] = {}
    title = find(root, "title")
    if title and plain(title).strip():
        meta["title"] = plain(title)
    for m in every(root, lambda n: n.tag == "meta"):
        name = next((m.attrs[a] for a in m.attrs if a in ("itemprop", "property", "name")), "")
        if name and m.attrs.get("content"):
            meta[name] = m.attrs["content"]
    for s in every(root, lambda n: n.tag == "script"):
        found = re.search(r"var ytInitialData = (\{.*?\});", "".join(k for k in s.kids if isinstance(k, str)))
        if found:
            try:
                about = find_key(json.loads(found[1]), "attributedDescriptionBodyText")
                if isinstance(about, dict):
                    meta["description"] = str(about.get("content", ""))
            except ValueError:
                pass
            break
    first = lambda *keys: next((meta[k] for k in keys if k in meta), None)
    name = first("title", "og:title", "name") or ""
    out = f"\n## {name}\n" if name else ""
    figures = "".join(f"- **{label}:** {v}\n" for label, key in (("Views", "interactionCount"), ("Keywords", "keywords"), ("Runtime", "duration")) if (v := first(key)))
    out += f"\n### Video Metadata\n{figures}\n" if figures else ""
    about = first("description", "og:description")
    out += f"\n### Description\n{about}\n" if about else ""
    if not out:
        return formats.read_html(data, charset=charset, **options)
    return "# YouTube\n" + out, name


def _has(cls: str):
    return lambda n: cls in n.attrs.get("class", "").split()


def _target(href: str) -> str:
    """The address behind a redirect: its parameter u after two signs, in the URL alphabet of base64."""
    packed = parse_qs(urlparse(href).query).get("u")
    if packed:
        try:
            return base64.b64decode(packed[0][2:].strip() + "==", altchars=b"-_").decode("utf-8")
        except (binascii.Error, UnicodeDecodeError, ValueError):
            pass
    return href


def read_results(data: bytes, url: str | None = None, charset: str | None = None, **options) -> tuple[str, str | None]:
    """The organic results of a search page, with their true addresses."""
    root = parse_page(data, charset)
    for n in every(root, _has("tptt")):
        n.kids.append(" ")
    for n in every(root, _has("algoSlug_icon")):
        n.up.kids.remove(n)
    out = []
    for result in every(root, _has("b_algo")):
        for a in every(result, lambda n: n.tag == "a" and "href" in n.attrs):
            a.attrs["href"] = _target(a.attrs["href"])
        text = Writer(options.get("keep_data_uris", False)).flow(result).strip()
        out.append("\n".join(x.strip() for x in re.split(r"\n+", text) if x.strip()))
    query = parse_qs(urlparse(url or "").query).get("q", [""])[0]
    title = find(root, "title")
    return f"## A Bing search for '{query}' found the following results:\n\n" + "\n\n".join(out), plain(title) if title else None


#: name, pattern of the address, reader
SITES = [("read_wiki", formats.WIKI, formats.read_wiki), ("read_video", VIDEO, read_video), ("read_results", RESULTS, read_results)]
