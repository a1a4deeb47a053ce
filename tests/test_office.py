import io
import zipfile

import pytest

from textloom.sources import feeds, formats, office


def package(**members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return buf.getvalue()


def rels(*links):
    body = "".join(f'<Relationship Id="{i}" Type="http://x/{kind}" Target="{to}"{mode}/>' for i, kind, to, mode in links)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def ns(prefix, uri):
    return f'xmlns:{prefix}="{uri[1:-1]}"'


def test_rss():
    xml = b"""<rss xml:base="http://h/"><channel><title>
      Feed </title><description>about</description>
      <item><title>One</title><pubDate>Mon</pubDate><description>&lt;p&gt;a &lt;b&gt;b&lt;/b&gt; &lt;a href="x"&gt;l&lt;/a&gt;&lt;/p&gt;</description></item><item><title>Two</title></item></channel></rss>"""
    assert formats.convert(xml, "f.rss") == ("# Feed\nabout\n\n## One\nPublished on: Mon\na **b** [l](http://h/x)\n## Two\n", "Feed")


def test_atom_and_plain_xml():
    xml = b"""<feed xmlns="http://www.w3.org/2005/Atom"><title type="html">A &lt;i&gt;b&lt;/i&gt;</title><entry><title>E</title><updated>d</updated>
      <summary>x &lt;job&gt;</summary><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>p &amp; q</p></div></content></entry></feed>"""
    text, title = feeds.read_feed(xml)
    assert title == "A *b*" and text.endswith("## E\nUpdated on: d\nx <job>\n\np & q")
    assert formats.convert(b"<other/>", "o.xml")[0] == "<other/>"
    with pytest.raises(ValueError):
        feeds.read_feed(b"<feed><title>no entry</title></feed>")


def test_epub():
    opf = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator></metadata>
      <manifest><item id="b" href="b%20c.html"/><item id="a" href="a.html"/><item id="z" href="gone.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="z"/></spine></package>"""
    box = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>'
    data = package(**{"META-INF/container.xml": box, "O/c.opf": opf, "O/b c.html": "<h1>B</h1>", "O/a.html": "<p>a</p>"})
    assert formats.convert(data, "x.epub") == ("**Title:** T\n**Authors:** A, B\n\n# B\n\na", "T")


def test_xlsx():
    s, r = office.S[1:-1], office.R[1:-1]
    book = f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'
    sheet = f"""<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n|m</t></is></c><c r="C1"/><c r="D1" t="str"><v>d</v></c></row>
      <row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c><c r="D2" s="1"><v>45292</v></c></row><row r="3"><c r="B3"><v>2.5</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>"""
    data = package(**{
        "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml", "")), "xl/worksheets/sheet1.xml": sheet,
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>k</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{s}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })
    lines = formats.convert(data, "x.xlsx")[0].split("\n")
    assert lines[:3] == ["## One", "| k | n\\|m | Unnamed: 2 | d |", "| --- | --- | --- | --- |"]
    assert lines[3].startswith("| xy | 3.0 | ") and "2024-01-01" in lines[3] and "2.5 | True" in lines[4]


def test_pptx():
    head = f"{ns('p', office.P)} {ns('a', office.A)} {ns('r', office.R)} {ns('c', office.C)}"
    shape = lambda y, text, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="s"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    tbl = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in r) + "</a:tr>" for r in ("ab", "12"))
    table = f'<p:graphicFrame><p:xfrm><a:off x="0" y="30"/></p:xfrm><a:graphic><a:graphicData><a:tbl>{tbl}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    chart = '<p:graphicFrame><p:xfrm><a:off x="0" y="40"/></p:xfrm><a:graphic><a:graphicData><c:chart r:id="c1"/></a:graphicData></a:graphic></p:graphicFrame>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="2" name="Pic 1" descr="a [b]"/></p:nvPicPr><p:spPr/></p:pic>'
    title = '<p:ph type="title"/>'
    slide = f"<p:sld {head}><p:cSld><p:spTree>{shape(20, 'body')}{shape(10, ' Head', title)}{table}{chart}{pic}</p:spTree></p:cSld></p:sld>"
    pts = lambda vs: "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in enumerate(vs))
    plot = f'<c:chartSpace {ns("c", office.C)}><c:chart><c:plotArea><c:barChart><c:ser><c:tx>{pts(["S"])}</c:tx><c:cat>{pts(["q", "r"])}</c:cat><c:val>{pts([1, 2])}</c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>'
    notes = f"<p:notes {head}><p:cSld><p:spTree>{shape(1, 'note', '<p:ph type=%sbody%s/>' % (chr(34), chr(34)))}</p:spTree></p:cSld></p:notes>"
    data = package(**{
        "ppt/presentation.xml": f'<p:presentation {head}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml", "")),
        "ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": rels(("c1", "chart", "../charts/c.xml", ""), ("n1", "notesSlide", "../notesSlides/n.xml", "")), "ppt/charts/c.xml": plot, "ppt/notesSlides/n.xml": notes,
    })
    text = formats.convert(data, "x.pptx")[0]
    assert text == "<!-- Slide number: 1 -->\n\n![a b](Pic1.jpg)\n# Head\nbody\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n### Chart\n\n| Category | S |\n|---|---|\n| q | 1.0 |\n| r | 2.0 |\n\n### Notes:\nnote"


def test_docx():
    run = lambda t, pr="": f"<w:r><w:rPr>{pr}</w:rPr><w:t>{t}</w:t></w:r>"
    item = lambda t, lv: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{lv}"/><w:numId w:val="1"/></w:numPr></w:pPr>{run(t)}</w:p>'
    body = f"""<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr>{run("Title")}</w:p><w:p>{run("a ")}{run("b", "<w:b/>")}{run("c", "<w:b/>")} {run(" d", '<w:i w:val="0"/>')}<w:hyperlink r:id="l">{run("link")}</w:hyperlink></w:p>
      {item("x", 0)}{item("y", 1)}{item("z", 0)}<w:tbl><w:tr><w:tc><w:p>{run("h")}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{run("v")}</w:p></w:tc></w:tr></w:tbl>"""
    w = ns("w", office.W)
    data = package(**{
        "word/document.xml": f"<w:document {w} {ns('r', office.R)}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels(("l", "hyperlink", "http://h/", ' TargetMode="External"')),
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {w}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    })
    assert formats.convert(data, "x.docx")[0] == "# Title\n\na **bc** d[link](http://h/)\n\n* x\n  1. y\n* z\n\n| h |\n| --- |\n| v |"


def test_wiki():
    page = b'<title>T - W</title><span class="mw-page-title-main"> Cats </span><div id="mw-content-text"><p>body</p></div><p>menu</p>'
    assert formats.read_wiki(page) == ("# Cats\n\nbody", "Cats")
    assert formats.convert(page, "p.html", url="https://en.wikipedia.org/wiki/Cat")[0] == "# Cats\n\nbody" != formats.convert(page, "p.html")[0]
