"""Markdown as a word-processing document: the parts of the container, written with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from textloom.sinks.html import blocks

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    '<Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/>'
    '<Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/></Types>'
)
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PIECE = re.compile(r"\*\*(?P<b>[^*]+)\*\*|(?<!\*)\*(?P<i>[^*\s][^*]*)\*|~~(?P<s>[^~]+)~~|`(?P<c>[^`]+)`|!?\[(?P<t>[^\]]*)\]\((?P<u>[^)\s]+)\)")


def _run(text: str, props: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if text else ""


class _Writer:
    def __init__(self, font: str):
        self.links: list[str] = []
        self.font = font

    def inline(self, text: str) -> str:
        out, at = "", 0
        for m in _PIECE.finditer(text):
            out += _run(text[at : m.start()])
            at = m.end()
            if m["u"] is not None:
                self.links.append(m["u"])
                out += f'<w:hyperlink r:id="link{len(self.links)}">{_run(m["t"] or m["u"], "<w:u w:val=\'single\'/>")}</w:hyperlink>'
            else:
                out += _run(m["b"] or m["i"] or m["s"] or m["c"], "<w:b/>" if m["b"] else "<w:i/>" if m["i"] else "<w:strike/>" if m["s"] else '<w:rFonts w:ascii="Consolas" w:hAnsi="Consolas"/>')
        return out + _run(text[at:])

    def paragraph(self, body: str, style: str = "", extra: str = "") -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
        return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}{body}</w:p>'

    def body(self, text: str) -> str:
        out = []
        for kind, x in blocks(text):
            if kind == "head":
                out.append(self.paragraph(self.inline(x[1]), f"Heading{x[0]}"))
            elif kind in ("fence", "math"):
                code = '<w:rFonts w:ascii="Consolas" w:hAnsi="Consolas"/>' if kind == "fence" else "<w:i/>"
                out += [self.paragraph(_run(line, code)) for line in x[1].split("\n")]
            elif kind == "rule":
                out.append(self.paragraph("", extra='<w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr>'))
            elif kind == "table":
                cell = lambda c: f"<w:tc><w:tcPr/>{self.paragraph(self.inline(c))}</w:tc>"
                rows = "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in x[0])
                out.append(f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr>{rows}</w:tbl>')
            elif kind == "quote":
                out += [self.paragraph(self.inline(line), "Quote") for line in x.split("\n")]
            elif kind == "list":
                for indent, ordered, item in x:
                    box = re.match(r"\[([ xX])\] (.*)", item)
                    item = f"{'☐' if box[1] == ' ' else '☑'} {box[2]}" if box else item
                    out.append(self.paragraph(self.inline(item), extra=f'<w:numPr><w:ilvl w:val="{min(8, indent // 2)}"/><w:numId w:val="{2 if ordered else 1}"/></w:numPr>'))
            else:
                out.append(self.paragraph(self.inline(x.replace("\n", " "))))
        return "".join(out)


def to_docx(text: str, font: str = "Kalpurush") -> bytes:
    """A document of the text's blocks: headings, paragraphs, lists, tables, quotes, code, rules and links."""
    w = _Writer(font)
    body = w.body(text)
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:rPr><w:b/><w:sz w:val="{40 - 4 * i}"/></w:rPr></w:style>' for i in range(1, 7))
    styles += '<w:style w:type="paragraph" w:styleId="Quote"><w:name w:val="Quote"/><w:rPr><w:i/></w:rPr></w:style><w:style w:type="table" w:styleId="TableGrid"><w:name w:val="Table Grid"/></w:style>'
    default = f"<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii={quoteattr(font)} w:hAnsi={quoteattr(font)} w:cs={quoteattr(font)}/><w:sz w:val=\"22\"/></w:rPr></w:rPrDefault></w:docDefaults>"
    level = lambda kind, mark: "".join(f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{kind}"/><w:lvlText w:val="{mark.format(i + 1)}"/></w:lvl>' for i in range(9))
    numbering = f'<w:abstractNum w:abstractNumId="0">{level("bullet", "•")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{level("decimal", "%{}.")}</w:abstractNum>'
    numbering += '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    rel = lambda i, kind, target, more="": f'<Relationship Id="{i}" Type="{_OFFICE}/{kind}" Target={quoteattr(target)}{more}/>'
    links = "".join(rel(f"link{i}", "hyperlink", u, ' TargetMode="External"') for i, u in enumerate(w.links, 1))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (
            ("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS.format(rel("rId1", "officeDocument", "word/document.xml"))),
            ("word/document.xml", f"{head}<w:document {_W}><w:body>{body}</w:body></w:document>"), ("word/styles.xml", f"{head}<w:styles {_W}>{default}{styles}</w:styles>"),
            ("word/numbering.xml", f"{head}<w:numbering {_W}>{numbering}</w:numbering>"),
            ("word/_rels/document.xml.rels", _RELS.format(rel("rId1", "styles", "styles.xml") + rel("rId2", "numbering", "numbering.xml") + links)),
        ):
            z.writestr(zipfile.ZipInfo(name), part)
    return out.getvalue()


@pandas_udf(BinaryType())
def docx_column(texts: pd.Series) -> pd.Series:
    """Markdown columns as documents; null stays null."""
    return pd.Series([None if t is None else to_docx(t) for t in texts], dtype=object)
