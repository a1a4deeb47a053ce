"""Office files and e-books to Markdown, from their ZIP parts."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd

from textloom.sources import equations, formats
from textloom.sources.formats import Node, Writer

# Namespaces of office files; fixed values.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
DC = "{http://purl.org/dc/elements/1.1/}"


class Parts:
    """The XML parts of a package and the links between them."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = {n.lower(): n for n in self.zip.namelist()}

    def xml(self, name: str) -> ET.Element | None:
        real = self.names.get(name.lower())
        return ET.fromstring(self.zip.read(real)) if real else None

    def links(self, name: str) -> dict[str, str]:
        """id: part or address that the part links to."""
        folder, base = posixpath.split(name)
        root = self.xml(posixpath.join(folder, "_rels", base + ".rels"))
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            outside = r.get("TargetMode") == "External"
            out[r.get("Id")] = target if outside else target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return out

    def linked(self, name: str, kind: str) -> str | None:
        """The first part that name links to under a relationship type ending in kind."""
        folder, base = posixpath.split(name)
        root = self.xml(posixpath.join(folder, "_rels", base + ".rels"))
        ids = [r.get("Id") for r in (root if root is not None else ()) if r.get("Type", "").endswith("/" + kind)]
        return self.links(name)[ids[0]] if ids else None


# ---- e-books ----------------------------------------------------------------------------------


def read_epub(data: bytes, **options) -> tuple[str, str | None]:
    """Lines of metadata, then the documents of the spine in its order; entries missing from the archive are left out."""
    parts = Parts(data)
    package = next(e.get("full-path") for e in parts.xml("META-INF/container.xml").iter() if e.tag.endswith("}rootfile"))
    root, folder = parts.xml(package), posixpath.dirname(package)
    texts = lambda tag: [t for e in root.iter(DC + tag) if (t := "".join(e.itertext()).strip())]
    meta = {k: texts(t)[:n] for k, t, n in (("Title", "title", 1), ("Authors", "creator", None), ("Language", "language", 1), ("Publisher", "publisher", 1), ("Date", "date", 1), ("Description", "description", 1), ("Identifier", "identifier", 1))}
    files = {e.get("id"): e.get("href", "") for e in root.iter() if e.tag.endswith("}item")}
    inside = set(parts.zip.namelist())
    out = ["\n".join(f"**{k}:** {', '.join(v)}" for k, v in meta.items() if v)]
    for ref in (e.get("idref") for e in root.iter() if e.tag.endswith("}itemref")):
        if ref in files:
            paths = [posixpath.normpath(posixpath.join(folder, h)) for h in (unquote(files[ref]), files[ref])]
            path = next((p for p in paths if p in inside), None)
            if path:
                out.append(formats.read_html(parts.zip.read(path), **options)[0])
    return "\n\n".join(out), next(iter(meta["Title"]), None)


# ---- sheets -----------------------------------------------------------------------------------

#: built-in number formats of dates and times; fixed values
DATES = {*range(14, 23), *range(45, 48)}


def _date_styles(parts: Parts) -> set[int]:
    """Indexes of cell styles that show a date or a time."""
    root = parts.xml("xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(S + "numFmt")}
    dates = DATES | {k for k, code in own.items() if re.search("[dyhs]|mm", code.lower()) and "general" not in code.lower()}
    cells = root.find(S + "cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in dates}


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _number(text: str):
    x = float(text)
    return int(x) if x.is_integer() else x


def _cell(c: ET.Element, shared: list[str], dates: set[int], epoch: datetime.datetime):
    kind, v = c.get("t", "n"), c.findtext(S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(S + "t"))
    if v is None:
        return None
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return v == "1"
    if kind != "n":
        return v
    if int(c.get("s", 0)) in dates:
        return epoch + datetime.timedelta(days=float(v))
    return _number(v)


def sheets(data: bytes):
    """(name, rows) of each sheet in workbook order; rows are lists of values with None for blanks."""
    parts = Parts(data)
    book = parts.xml("xl/workbook.xml")
    links = parts.links("xl/workbook.xml")
    strings = parts.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in strings] if strings is not None else []
    dates = _date_styles(parts)
    pr = book.find(S + "workbookPr")
    epoch = datetime.datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
    for sheet in book.iter(S + "sheet"):
        root = parts.xml(links.get(sheet.get(R + "id"), ""))
        rows: list[list] = []
        for row in root.iter(S + "row") if root is not None else ():
            at = int(row.get("r", len(rows) + 1)) - 1
            cells: dict[int, object] = {}
            for c in row.iter(S + "c"):
                cells[_column(c.get("r")) if c.get("r") else len(cells)] = _cell(c, shared, dates, epoch)
            rows += [[] for _ in range(at - len(rows))] + [[cells.get(i) for i in range(max(cells, default=-1) + 1)]]
        yield sheet.get("name"), rows


def sheet_frame(rows: list[list]) -> pd.DataFrame:
    """The first row names the columns: a blank name is 'Unnamed: i', a repeated one gets .1, .2 and so on."""
    while rows and all(v is None for v in rows[-1]):
        rows = rows[:-1]
    width = max(map(len, rows), default=0)
    full = [[*r, *[None] * (width - len(r))] for r in rows]
    names, seen = [], {}
    for i, v in enumerate(full[0] if full else ()):
        name = f"Unnamed: {i}" if v is None else str(v)
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}.{n}" if n else name)
    return pd.DataFrame(full[1:], columns=names).infer_objects()


def read_xlsx(data: bytes, **_) -> tuple[str, str | None]:
    """Each sheet as a heading and a table."""
    out = []
    for name, rows in sheets(data):
        tree = formats.parse_html(sheet_frame(rows).to_html(index=False))
        out.append(f"## {name}\n" + Writer().flow(tree).strip())
    return "\n\n".join(out).strip(), None


# ---- slides -----------------------------------------------------------------------------------


def _frame_text(e: ET.Element | None) -> str:
    """Paragraphs of a text body by line."""
    out = []
    for p in e.iter(A + "p") if e is not None else ():
        out.append("".join("\v" if x.tag == A + "br" else x.text or "" for x in p.iter() if x.tag in (A + "t", A + "br")))
    return "\n".join(out)


def _place(shape: ET.Element) -> tuple[float, float]:
    """(top, left); a shape without a place comes first."""
    for path in (f"{P}spPr/{A}xfrm/{A}off", f"{P}xfrm/{A}off", f"{P}grpSpPr/{A}xfrm/{A}off"):
        off = shape.find(path)
        if off is not None:
            return float(off.get("y")), float(off.get("x"))
    return float("-inf"), float("-inf")


def _shapes(tree: ET.Element) -> list[ET.Element]:
    kinds = {P + x for x in ("sp", "pic", "graphicFrame", "grpSp")}
    return sorted((s for s in tree if s.tag in kinds), key=_place)


def _chart(root: ET.Element | None) -> str:
    """Categories by series as a table."""
    plot = root.find(f"{C}chart/{C}plotArea") if root is not None else None
    series = list(plot.iter(C + "ser")) if plot is not None else []
    points = lambda e: {int(p.get("idx")): p.findtext(C + "v") for p in e.iter(C + "pt")} if e is not None else {}
    if not series or any(s.find(C + "val") is None for s in series):
        return "\n\n[unsupported chart]\n\n"
    title = root.find(f"{C}chart/{C}title/{C}tx/{C}rich")
    labels = points(series[0].find(C + "cat"))
    values = [{i: float(v) for i, v in points(s.find(C + "val")).items()} for s in series]
    rows = [["Category", *[next(iter(points(s.find(C + "tx")).values()), "") for s in series]]]
    rows += [[labels[i], *[str(v.get(i)) for v in values]] for i in sorted(labels)]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n\n### Chart" + (f": {_frame_text(title)}" if title is not None else "") + "\n\n" + "\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]])


def _shape(shape: ET.Element, parts: Parts, links: dict[str, str]) -> str:
    if shape.tag == P + "grpSp":
        return "".join(_shape(s, parts, links) for s in _shapes(shape))
    name = next((e for e in shape.iter(P + "cNvPr")), None)
    if shape.tag == P + "pic":
        alt = (name.get("descr") or "").strip() and name.get("descr") or name.get("name", "")
        alt = re.sub(r"\s+", " ", re.sub(r"[\r\n\[\]]", " ", alt)).strip()
        return f"\n![{alt}]({re.sub(r'\W', '', name.get('name', ''))}.jpg)\n"
    if shape.tag == P + "graphicFrame":
        rows = [[_frame_text(c.find(A + "txBody")) for c in r.findall(A + "tc")] for r in shape.iter(A + "tr")]
        if rows:
            return formats.markdown_table([[re.sub(r"\s+", " ", c).strip() for c in r] for r in rows]) + "\n"
        chart = next((e for e in shape.iter(C + "chart")), None)
        return _chart(parts.xml(links.get(chart.get(R + "id"), ""))) if chart is not None else ""
    body = shape.find(P + "txBody")
    if body is None:
        return ""
    text = _frame_text(body)
    ph = next((e for e in shape.iter(P + "ph")), None)
    if ph is not None and ph.get("type") in ("title", "ctrTitle"):
        return f"# {text.lstrip()}\n" if text.strip() else ""
    return text + "\n"


def read_pptx(data: bytes, **_) -> tuple[str, str | None]:
    """Slides in order: shapes by place, then notes that hold text."""
    parts = Parts(data)
    deck = "ppt/presentation.xml"
    links, out = parts.links(deck), ""
    for n, ref in enumerate(parts.xml(deck).iter(P + "sldId"), 1):
        path = links[ref.get(R + "id")]
        tree = parts.xml(path).find(f"{P}cSld/{P}spTree")
        own = parts.links(path)
        out = (out + f"\n\n<!-- Slide number: {n} -->\n" + "".join(_shape(s, parts, own) for s in _shapes(tree))).strip()
        notes = parts.linked(path, "notesSlide")
        for sp in parts.xml(notes).iter(P + "sp") if notes else ():
            ph = next((e for e in sp.iter(P + "ph")), None)
            text = _frame_text(sp.find(P + "txBody")) if ph is not None and ph.get("type") == "body" else ""
            if text.strip():
                out = f"{out}\n\n### Notes:\n{text}".strip()
                break
    return out, None


# ---- word processing --------------------------------------------------------------------------


def _on(props: ET.Element | None, *names: str) -> bool:
    found = [props.find(W + n) for n in names] if props is not None else []
    return any(e is not None and e.get(W + "val", "1") not in ("0", "false", "none") for e in found)


def _equation(e: ET.Element) -> str:
    """An equation between dollar signs, two for one of its own paragraph; its plain text where a part has no LaTeX form."""
    mark = "$$" if e.tag.endswith("oMathPara") else "$"
    try:
        return f"{mark}{equations.latex(e)}{mark}"
    except ValueError:
        return "".join(t.text or "" for t in e.iter(equations.M + "t"))


def repair_docx(data: bytes) -> bytes:
    """A document with its parts named as its directory names them and styles that have no type taken as paragraphs'; unreadable bytes as they are.

    Members whose local header spells the name in another case are copied under the directory's name; styles without an id go.
    """
    try:
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
            for entry in src.infolist():
                at = entry.header_offset
                size = int.from_bytes(data[at + 26 : at + 28], "little")
                inside = data[at + 30 : at + 30 + size]
                if inside.lower() == entry.orig_filename.encode().lower() and inside != entry.orig_filename.encode():
                    # the reader compares both names: give it the local spelling and write the directory's
                    entry.orig_filename = inside.decode()
                body = src.read(entry)
                if entry.filename == "word/styles.xml":
                    body = _mended_styles(body)
                dst.writestr(entry.filename, body)
        return out.getvalue()
    except (zipfile.BadZipFile, ValueError, ET.ParseError, KeyError):
        return data


def _mended_styles(body: bytes) -> bytes:
    root = ET.fromstring(body)
    for s in root.findall(W + "style"):
        if s.get(W + "styleId") is None:
            root.remove(s)
        elif s.get(W + "type") is None:
            s.set(W + "type", "paragraph")
    return ET.tostring(root)


class _Word:
    """A tree of HTML nodes from a document's paragraphs, lists and tables."""

    def __init__(self, parts: Parts):
        self.parts, self.links = parts, parts.links("word/document.xml")
        styles, numbers = parts.xml("word/styles.xml"), parts.xml("word/numbering.xml")
        self.heads = {}
        for s in styles.iter(W + "style") if styles is not None else ():
            name = s.find(W + "name")
            m = re.fullmatch("heading ([1-6])", name.get(W + "val", "").lower()) if name is not None else None
            if m:
                self.heads[s.get(W + "styleId")] = int(m[1])
        self.formats = {}
        if numbers is not None:
            levels = {a.get(W + "abstractNumId"): {lv.get(W + "ilvl"): lv.find(W + "numFmt").get(W + "val") for lv in a.iter(W + "lvl") if lv.find(W + "numFmt") is not None} for a in numbers.iter(W + "abstractNum")}
            self.formats = {n.get(W + "numId"): levels.get(n.find(W + "abstractNumId").get(W + "val"), {}) for n in numbers.iter(W + "num") if n.find(W + "abstractNumId") is not None}

    def run(self, r: ET.Element) -> list:
        kids: list = []
        for e in r:
            if e.tag == W + "t":
                kids.append(e.text or "")
            elif e.tag == W + "tab":
                kids.append("\t")
            elif e.tag in (W + "br", W + "cr"):
                kids.append(Node("br"))
            elif e.tag == W + "drawing":
                about = next(e.iter(WP + "docPr"), None)
                kids.append(Node("img", {"alt": (about.get("descr") or "") if about is not None else "", "src": "data:image/png;base64,"}))
        props = r.find(W + "rPr")
        for tag, names in (("s", ("strike", "dstrike")), ("em", ("i",)), ("strong", ("b",))):
            if kids and _on(props, *names):
                node = Node(tag)
                node.kids, kids = kids, [node]
        return kids

    def inline(self, p: ET.Element) -> list:
        out: list = []
        for e in p:
            if e.tag == W + "r":
                out += self.run(e)
            elif e.tag == W + "hyperlink":
                to = self.links.get(e.get(R + "id"), "") or (f"#{e.get(W + 'anchor')}" if e.get(W + "anchor") else "")
                node = Node("a", {"href": to})
                node.kids = self.inline(e)
                out.append(node)
            elif e.tag in (equations.M + "oMath", equations.M + "oMathPara"):
                out.append(_equation(e))
            elif e.tag in (W + "ins", W + "smartTag", W + "sdt", W + "sdtContent", W + "fldSimple"):
                out += self.inline(e)
        merged: list = []
        for k in out:  # neighbours of one kind are one span
            if merged and isinstance(k, Node) and isinstance(merged[-1], Node) and k.tag == merged[-1].tag in ("strong", "em", "s"):
                merged[-1].kids += k.kids
            else:
                merged.append(k)
        return merged

    def blocks(self, body: ET.Element) -> list[Node]:
        out: list[Node] = []
        lists: list[Node] = []
        for e in body:
            if e.tag in (W + "sdt", W + "sdtContent", W + "ins"):
                lists = []
                out += self.blocks(e)
            elif e.tag == equations.M + "oMathPara":
                lists = []
                node = Node("p")
                node.kids = [_equation(e)]
                out.append(node)
            elif e.tag == W + "tbl":
                lists = []
                out.append(self.table(e))
            elif e.tag == W + "p":
                props = e.find(W + "pPr")
                style = props.find(W + "pStyle") if props is not None else None
                level = self.heads.get(style.get(W + "val")) if style is not None else None
                number = props.find(W + "numPr") if props is not None else None
                node = Node(f"h{level}" if level else "p")
                node.kids = self.inline(e)
                if number is None or level or number.find(W + "numId") is None or number.find(W + "numId").get(W + "val") == "0":
                    lists = []
                    out.append(node)
                    continue
                at = number.find(W + "ilvl")
                depth = at.get(W + "val") if at is not None else "0"
                kind = "ul" if self.formats.get(number.find(W + "numId").get(W + "val"), {}).get(depth, "bullet") == "bullet" else "ol"
                lists = lists[: int(depth) + 1]
                if len(lists) == int(depth) + 1 and lists[-1].tag != kind:
                    lists.pop()
                while len(lists) <= int(depth):
                    new = Node(kind)
                    if lists:
                        (lists[-1].kids or [out[-1]])[-1].kids.append(new)
                    else:
                        out.append(new)
                    lists.append(new)
                    if len(lists) <= int(depth):
                        new.kids.append(Node("li"))
                item = Node("li")
                item.kids = node.kids
                lists[-1].kids.append(item)
        return out

    def table(self, t: ET.Element) -> Node:
        table = Node("table")
        for r in t.findall(W + "tr"):
            row = Node("tr")
            for c in r.findall(W + "tc"):
                cell = Node("td")
                cell.kids = list(self.blocks(c))
                row.kids.append(cell)
            table.kids.append(row)
        return table


def read_docx(data: bytes, **_) -> tuple[str, str | None]:
    """Headings, paragraphs, lists, tables, links and character styles of a document's body."""
    parts = Parts(repair_docx(data))
    body = parts.xml("word/document.xml").find(W + "body")
    root = Node("")
    root.kids = list(_Word(parts).blocks(body))
    return Writer().flow(root).strip(), None


for _ext, _read in ((".epub", read_epub), (".xlsx", read_xlsx), (".pptx", read_pptx), (".docx", read_docx)):
    formats.register([_ext], _read)
