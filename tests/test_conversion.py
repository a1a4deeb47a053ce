import io
import json
import subprocess
import sys
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from textloom import streaming
from textloom.__main__ import ToolError, convert_to_markdown, main
from textloom.functions import numbers, repair, tables, text
from textloom.operators import forms, memory, quality, translate
from textloom.plans import catalogue
from textloom.sinks import bundles, docx, html
from textloom.sources import equations, external, files, formats, info, office, records, registry, rich, web


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers(spark):
    say = lambda v: one(spark, numbers.any_number_words(F.lit(v)))
    assert say("-৫০.২৫") == "ঋণাত্মক পঞ্চাশ দশমিক দুই পাঁচ" and say("abc") == say("") == say("1e5") == "" and say(".5") == "শূন্য দশমিক পাঁচ" and say("1" * 30) == ""
    read = lambda v: one(spark, numbers.words_number(F.lit(v)))
    assert read("এক হাজার দুই শত চৌত্রিশ") == 1234 and read("মাইনাস পাঁচ লক্ষ") == -500000 and read(" ") is None and read("xx শত") == 100 and read("এক হাজার কোটি") == 10001000


def test_dates(spark):
    assert one(spark, numbers.dates_to_bangabda(F.lit("on ২৩ সেপ্টেম্বর ২০২৬, not 31 June 2020 or 5 Foo 2020"))) == "on ৮ আশ্বিন ১৪৩৩ বঙ্গাব্দ, not 31 June 2020 or 5 Foo 2020"
    assert one(spark, numbers.dates_to_gregorian(F.lit("৮ আশ্বিন ১৪৩৩ বঙ্গাব্দ y 5 Foo 1400"))) == "২৩ সেপ্টেম্বর ২০২৬ খ্রিষ্টাব্দ y 5 Foo 1400"
    assert one(spark, numbers.approximate_gregorian(F.lit("১৫ মাঘ, ১৪২২"))) == "15 Magha, 2016 CE (Approx)" and one(spark, numbers.approximate_gregorian(F.lit("x"))) is None


def test_repair(spark):
    assert one(spark, repair.repair_bengali(F.lit("﻿িতন জলু | াই ব\x00াংক িি"))) == "তিন জুলাই ব্যাংক ি"
    assert one(spark, repair.speech_order(F.lit("িকেখা েপৗষ িস্ত্র"))) == "কিখো পৌষ স্ত্রি"
    lines = lambda *xs: one(spark, repair.merge_fragments(F.array(*[F.lit(x) for x in xs]).cast("array<string>")))
    assert lines("(ক", ")", "a long enough line", ",", "x", "another line") == ["(ক)", "a long enough line, x", "another line"] and lines() == []


def test_form_page(spark):
    w = [("d", 1, f"c{r}{c}", float(x + r % 2), float(x + 30), r * 12.0) for r in range(5) for c, x in enumerate((50, 200, 400))]
    w += [("d", 1, "A line of words that is no table", 50.0, 300.0, 100.0), ("d", 1, ".1", 50.0, 60.0, 120.0), ("d", 1, "item", 200.0, 230.0, 120.0), ("e", 1, "only prose", 10.0, 80.0, 10.0)]
    got = {r.doc: r for r in forms.form_pages(spark.createDataFrame(w, "doc string, page int, text string, x0 double, x1 double, top double")).collect()}
    assert got["d"].columns == [50.0, 200.0, 400.0] and got["d"].table_rows == 5 and got["e"].markdown is None
    assert got["d"].markdown.split("\n")[:3] == ["| c00 | c01 | c02 |", "| --- | --- | --- |", "| c10 | c11 | c12 |"] and got["d"].markdown.endswith("| c40 | c41 | c42 |\nA line of words that is no table\n.1 item")
    assert one(spark, forms.join_numbering(F.lit(".1\n\n a\nb\n.2\n"))) == ".1 a\nb\n.2\n"


def test_form_pages_are_made_once(spark):
    """One shuffle and no join back: a page without a name keeps its Markdown; rows of the same height and unsorted words stand in order."""
    w = [(None, 1, f"c{r}{c}", float(x), float(x + 30), r * 12.0) for r in (3, 1, 0, 2) for c, x in ((2, 400), (0, 50), (1, 200))] + [(None, 1, "between", 50.0, 90.0, 18.0)]
    out = forms.form_pages(spark.createDataFrame(w, "doc string, page int, text string, x0 double, x1 double, top double"))
    head = ["| --- | --- | --- |", "| c10 | c11 | c12 |"]
    assert [r.markdown.split("\n") for r in out.collect()] == [["| c00 | c01 | c02 |", *head, "between", "| c20 | c21 | c22 |", "| --- | --- | --- |", "| c30 | c31 | c32 |"]]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_calibration_edges(spark):
    none = spark.createDataFrame([], "score double, good boolean")
    r = quality.calibrate(none).first()
    assert (r.precision, r.recall, r.f1, r.true_positives) == (0.0, 0.0, 0.0, 0)
    r = quality.calibrate(spark.createDataFrame([(10.0, False), (20.0, True), (80.0, True), (None, True), (90.0, False)], "score double, good boolean")).first()
    assert (r.precision, r.recall, r.f1, r.min_good_score, r.max_bad_score) == (0.5, 0.5, 0.5, 20.0, 90.0)


def test_fuzzy_equals_all_pairs(spark):
    words = ["abcdefghij", "abcdefghix", "aaaaaaaaaaaa", "aaaaaaaaaaab", "short", "shart", "a longer text with many words in it", "a longer text with mony words in it", "another text altogether here", "x" * 300, "x" * 280 + "y" * 20, "x" * 299 + "é", ""]
    m = spark.createDataFrame(list(enumerate(words)), "mem_id long, text string")
    q = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(50, "abcdefghij"), (51, None), (52, "aaaaaaaaaaa"), (53, "a longer text with many word in it")], "id long, source string")
    got = {r.id: (r.mem_id, r.similarity) for r in memory.fuzzy_lookup(q, m).collect()}
    pairs = q.crossJoin(m).where("source != '' and text != ''").withColumn("s", 1 - F.levenshtein("source", "text") / F.greatest(F.length("source"), F.length("text"))).where("s >= 0.9 - 1e-12")
    want = {r.id: (r.b.mem_id, round(r.b.s, 3)) for r in pairs.groupBy("id").agg(F.max_by(F.struct("mem_id", "s"), F.struct("s", -F.col("mem_id"))).alias("b")).collect()}
    assert got == want


def test_translation_takes_the_closest_entry(spark):
    memory_ = spark.createDataFrame([("The court made an order today.", "to_bn", "X"), ("ignored", "to_en", "Y")], "source_text string, direction string, target_text string")
    docs = spark.createDataFrame([(1, "The court made an order todey."), (2, "The court made an order today."), (3, "Something else."), (4, "আমি যাই"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in translate.translate(docs, "bn", memory_, lambda xs: [x.upper() for x in xs]).collect()}
    assert [got[i].text for i in range(1, 6)] == ["X", "X", "SOMETHING ELSE.", "আমি যাই", ""] and [got[i].from_memory for i in (1, 2, 3, 4)] == [1, 1, 0, 0]


def test_file_facts():
    assert info.data_uri("data:Text/plain;CharSet=x;base64,aGk=") == ("Text/plain", {"charset": "x"}, b"hi") and info.data_uri("data:,a%20b") == (None, {}, b"a b")
    for bad in ("data:x", "http:x"):
        with pytest.raises(ValueError):
            info.data_uri(bad)
    assert info.file_path("file:///a%20b/c") == "/a b/c"
    for bad in ("file:////host/x", "file:///%5C%5Chost/x", "file://host/x", "http://x"):
        with pytest.raises(ValueError):
            info.file_path(bad)
    r = info.of_response("http://h/p/a.csv?q", {"content-type": "text/html; charset=utf-8", "content-disposition": "attachment; filename=x.txt; filename*=UTF-8''%C3%A9.md"})
    assert (r.mimetype, r.charset, r.filename, r.extension) == ("text/html", "utf-8", "é.md", ".md") and info.of_response("http://h/p/a.csv?q", {}).extension == ".csv"
    cut = ("a" * (info.SAMPLE - 1) + "é" * 9).encode()
    assert info.sample(cut).decode().endswith("é") and info.canonical_charset("UTF8") == "utf-8" and info.canonical_charset("nope") == "nope"
    two = info.guesses(b"<html><body>x", info.Info(extension=".csv"))
    assert [g.extension for g in two] == [".csv", ".html"] and info.guesses(b"a,b", info.Info(extension=".csv"))[0].charset == "ascii"


def test_pages_that_are_ascii_for_a_whole_sample(spark, tmp_path):
    page = "<html><body><p>%s</p><footer>%s</footer></body></html>"
    long = "a " * info.SAMPLE
    pages = [(i, page % (long if i % 2 else "a", end)) for i, end in enumerate(["é", "é", "e", "日本", "\U0001f600", "é", "é", "é"])]
    spark.createDataFrame([(i, "https://a.example.com/", h) for i, h in pages], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalogue.QUERIES["batch_totals"](spark, str(tmp_path)).first()
    assert (got.converted, got.errors, got.files) == (6, 2, 8)  # pages 0 and 5 are no pages
    assert info.guess_charset((long + "é").encode()) == "utf-8" and info.guess_charset((long + "é").encode("cp1252")) == "cp1252" and info.guess_charset(long.encode()) == "ascii"
    for end, body in ((b"\xe9", "é" + long), (b"\xe9\x81", long)):
        data = (page % (body, "X")).encode().replace(b"X", end)
        text, _, name = registry.default().convert(data, info.of_path("a.html"))
        assert name == "read_html" and text.endswith("é")
    with pytest.raises(ValueError):
        registry.default().convert(("é" + long).encode() + b"\xe9", info.of_path("a.txt"))


def test_dispatch_order_and_plugins(recwarn):
    own = registry.Registry(list(registry.default().entries))
    own.register("late", lambda d, i: True, lambda d, **o: ("late", None), 20.0)
    own.register("bad", lambda d, i: i.extension == ".txt", lambda d, **o: 1 / 0, -1.0)
    own.register("first", lambda d, i: i.extension == ".txt", lambda d, **o: ("first", None), -1.0)
    assert own.convert(b"x", info.of_path("a.txt")) == ("first", None, "first") and own.convert(b"\x00\x01", info.of_path("a.bin"))[2] == "late"

    class Point:
        name = "p"

        def __init__(self, broken):
            self.broken = broken

        def load(self):
            if self.broken:
                raise ImportError("no")
            return self

        def register_converters(self, r):
            r.register("plug", lambda d, i: i.extension == ".zzz", lambda d, **o: ("plugged", "t"))

    got = registry.with_plugins([Point(True), Point(False)])
    assert got.convert(b"?", info.of_path("a.zzz"))[0] == "plugged" and any("was not loaded" in str(w.message) for w in recwarn)


def test_site_pages():
    page = b"<html><head><title>T</title><meta itemprop='interactionCount' content='5'><meta name='keywords' content='k'></head><script>var ytInitialData = {\"a\":[{\"attributedDescriptionBodyText\":{\"content\":\"D\"}}]};</script></html>"
    text_, title = registry.default().convert(page, info.Info(extension=".html", url="https://www.youtube.com/watch?v=1"))[:2]
    assert title == "T" and text_ == "# YouTube\n\n## T\n\n### Video Metadata\n- **Views:** 5\n- **Keywords:** k\n\n### Description\nD\n"
    assert web.find_key({"a": [{"b": {"c": 1}}, {"c": 2}]}, "c") == 1 and web.find_key([], "c") is None
    results = b"<html><div class='b_algo'><h2><a href='https://r/?u=a1aHR0cDovL2gvcA'>R</a></h2><p>s</p></div><div class=other>no</div></html>"
    out = registry.default().convert(results, info.Info(extension=".html", url="https://www.bing.com/search?q=x+y"))[0]
    assert out == "## A Bing search for 'x y' found the following results:\n\n## [R](http://h/p)\ns"


def test_rich_text_and_deep_pages(spark):
    rtf = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 A;}}Hello \b world\b0\par caf\'e9 @8212?x{\*\gen y}}".replace(b"@", bytes([92]) + b"u")
    assert rich.read_rtf(rtf)[0] == "Hello world\ncafé —x"
    deep = "<div>" * 5000 + "x"
    assert formats.read_html(deep.encode())[0] == "x"
    df = spark.createDataFrame([(1, deep, "old"), (2, None, "old")], "id long, html string, title string")
    assert [(r.id, r.markdown) for r in files.html_to_markdown(df).orderBy("id").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        registry.default().convert(b"%PDF-1.4 x", info.of_path("a.pdf"))
    external.plug("pdf_words", lambda data, **o: "words")
    assert registry.default().convert(b"%PDF-1.4 x", info.of_path("a.pdf"))[0] == "words"


def omml(body):
    return ET.fromstring(f'<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math">{body}</m:oMath>')


def test_equations():
    r = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    for body, want in (
        (f"<m:f><m:num>{r('𝑎')}</m:num><m:den>{r('2')}</m:den></m:f>", "\\frac{a}{2}"), (f"<m:sSup><m:e>{r('x')}</m:e><m:sup>{r('2')}</m:sup></m:sSup>", "x^{2}"),
        (f"<m:rad><m:deg>{r('3')}</m:deg><m:e>{r('x')}</m:e></m:rad>", "\\sqrt[3]{x}"), (f"<m:func><m:fName>{r('sin')}</m:fName><m:e>{r('𝛼')}</m:e></m:func>", "\\sin(\\alpha )"),
        (f"<m:func><m:fName>{r('foo')}</m:fName><m:e>{r('x')}</m:e></m:func>", "\\operatorname{foo}(x)"), (f"<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val=''/></m:dPr><m:e>{r('x≤_')}</m:e></m:d>", "\\left[x\\leq \\_\\right."),
        (f"<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr><m:sub>{r('i')}</m:sub><m:sup>{r('n')}</m:sup><m:e>{r('i')}</m:e></m:nary>", "\\sum_{i}^{n}i"),
        (f"<m:limLow><m:e>{r('lim')}</m:e><m:lim>{r('x→0')}</m:lim></m:limLow>", "\\lim_{x\\to 0}"), (f"<m:m><m:mr><m:e>{r('a')}</m:e><m:e>{r('b')}</m:e></m:mr><m:mr><m:e>{r('c')}</m:e></m:mr></m:m>", "\\begin{matrix}a&b\\\\c\\end{matrix}"),
        (f"<m:acc><m:e>{r('x')}</m:e></m:acc><m:bar><m:e>{r('y')}</m:e></m:bar>", "\\hat{x}\\overline{y}"),
    ):
        assert equations.latex(omml(body)) == want


def test_documents_written_and_read():
    source = "# T\n\na **b** *i* ~~s~~ `c` [l](http://x/)\n\n* i\n  * j\n\n1. one\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n> q\n\n---\n\n```\nx = 1\n```"
    data = docx.to_docx(source)
    text_, _ = office.read_docx(data)
    for part in ("# T", "a **b** *i* ~~s~~ c [l](http://x/)", "* i\n  + j", "1. one", "| a | b |", "| 1 | 2 |", "x = 1"):
        assert part in text_, (part, text_)
    buf = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as src, zipfile.ZipFile(buf, "w") as dst:
        for e in src.infolist():
            body = src.read(e)
            if e.filename == "word/document.xml":
                body = body.replace(b"<w:body>", b'<w:body><w:p><m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><m:r><m:t>x</m:t></m:r></m:oMath></w:p>', 1)
            if e.filename == "word/styles.xml":
                body = body.replace(b'w:type="paragraph" ', b"")
            dst.writestr(e.filename, body)
    assert office.read_docx(buf.getvalue())[0].startswith("$x$\n\n# T")
    out = html.to_html("# T\n\na **b** `x<` [l](http://h)\n\n- i\n  - j\n- [x] k\n\n|a|b|\n|-|-|\n|1|2|\n\n> q\n\n```py\nx<1\n```")
    assert '<h1>T</h1>' in out and "<strong>b</strong> <code>x&lt;</code>" in out and "<ul><li>i<ul><li>j</li></ul></li><li>" in out and "<thead><tr><th>a</th>" in out and 'class="language-py">x&lt;1' in out


def test_bundles_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.csv", "A", True, None), ("b/a.md", "B", True, None), ("c.bin", None, False, "unsupported: c.bin")], "name string, markdown string, success boolean, error string")
    b = bundles.zip_bundles(rows).collect()
    assert len(b) == 1 and (b[0].converted, b[0].errors) == (2, 1)
    with zipfile.ZipFile(io.BytesIO(bytes(b[0].content))) as z:
        assert z.namelist() == ["a.md", "a_2.md", "_errors.txt"] and z.read("_errors.txt") == b"c.bin: unsupported: c.bin"
    assert bundles.zip_bundles(rows.where("not success")).first().content is None
    bundles.write_markdown(rows.where("name != 'b/a.md'"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "markdown")).first().value == "A" and spark.read.json(str(tmp_path / "out" / "_errors")).first().name == "c.bin"


def test_record_sources(spark, tmp_path):
    (tmp_path / "g.csv").write_text("﻿term,translation,domain,case_sensitive\nBank,ব্যাংক,law,true\nbank,B,,\n,x,,\ny,,,\n", encoding="utf-8")
    rows = records.glossary(spark, str(tmp_path / "g.csv"))
    assert sorted((r.term, r.translation, r.domain, r.case_sensitive) for r in rows.collect()) == [("Bank", "ব্যাংক", "law", True), ("bank", "B", "general", False)]
    assert records.merged(rows, [F.col("file")]).count() == 2
    (tmp_path / "m.json").write_text(json.dumps([{"source_text": "a", "target_text": "b"}, {"source_text": None, "target_text": "c"}]))
    m = records.read_memory(spark, str(tmp_path / "m.json"))
    assert [(r.direction, r.approved_by) for r in m.collect()] == [("en->bn", "import")]
    records.write_memory(m, str(tmp_path / "m2"))
    assert records.read_memory(spark, str(tmp_path / "m2")).count() == 1
    (tmp_path / "p.tsv").write_text("# c\nid\tbn\ten\n1\tক\ta\n2\tlaw\tখ\tb\n\nbad\n", encoding="utf-8")
    assert sorted((r.id, r.domain, r.bn, r.en) for r in records.pairs(spark, str(tmp_path / "p.tsv")).collect()) == [("1", "general", "ক", "a"), ("2", "law", "খ", "b")]
    assert len(records.list_templates()) == 3 and len(records.template("government_gazette")["fields"]) == 7
    with pytest.raises(KeyError):
        records.template("none")


def test_streams(spark, tmp_path):
    src = tmp_path / "events"
    rows = [(i % 3, i, float(i), f"2020-01-01 00:{i:02d}:00", "a") for i in range(20)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, value double, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.unionAll(df).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = streaming.first_seen(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 20 and streaming.progress(q)["active"] is False and streaming.cancel(q)
    q = streaming.running_totals(stream).writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.user_id: r.n for r in spark.table("totals").collect()} == {0: 14, 1: 14, 2: 12}
    seen = []
    drop = tmp_path / "in"
    drop.mkdir()
    (drop / "a.csv").write_text("x,y\n1,2")
    q = streaming.convert_batches(spark, str(drop), lambda batch, n: seen.extend(batch.collect()), str(tmp_path / "c3"))
    q.awaitTermination(120)
    assert [r.name for r in seen] == ["a.csv"]


def test_table_functions(spark):
    tables.register(spark)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.txt", "hi")
    spark.createDataFrame([(bytearray(buf.getvalue()), "x\n# A\nb\n## C"), (bytearray(b"?"), None)], "c binary, t string").createOrReplaceTempView("archives")
    assert [(r.name, r["size"]) for r in spark.sql("SELECT m.name, m.size FROM archives, LATERAL archive_members(c) m").collect()] == [("a.txt", 2)]
    assert [(r.line, r.level, r.title, r.body) for r in spark.sql("SELECT s.* FROM archives, LATERAL markdown_sections(t) s").collect()] == [(0, 0, "", "x"), (1, 1, "A", "b"), (3, 2, "C", "")]


def test_fence_lines(spark):
    got = one(spark, text.fence_lines(F.lit("a\n```x\nb\n```\nc\n ```")))
    assert [(r.kind, r.open) for r in got] == [("text", False), ("fence", True), ("code", True), ("fence", False), ("text", False), ("fence", True)]


def test_command_line(tmp_path, capsys):
    (tmp_path / "a.csv").write_text("x,y\n1,2")
    assert main([str(tmp_path / "a.csv"), "-o", str(tmp_path / "o.md")]) == 0 and (tmp_path / "o.md").read_text().startswith("| x | y |")
    assert main(["data:text/csv,a%2Cb"]) == 0 and main([str(tmp_path / "none")]) == 1 and main(["--list-plugins"]) == 0
    done = subprocess.run([sys.executable, "-m", "textloom", "-x", "html"], input=b"<h1>T</h1>", capture_output=True, timeout=60)
    assert done.stdout.decode().strip() == "# T"
    assert convert_to_markdown("data:text/html,<b>x</b>") == "**x**"
    for uri in ("file:///no/such/file", "ftp://x", "data:x", "data:application/octet-stream;base64,AAEC"):
        with pytest.raises(ToolError) as e:
            convert_to_markdown(uri)
        assert "/no/such" not in str(e.value)


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 85
