import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom import streaming
from textloom.sources import files, formats


def md(html):
    return formats.read_html(html.encode())[0]


@pytest.mark.parametrize("html,want", [
    ("<h1>T</h1><p>a <b>b</b> &amp; c<p>d", "# T\n\na **b** & c\n\nd"),
    ("<ul><li>x<li>y <i>z</i></ul>", "* x\n* y *z*"),
    ("<ol><li>x</li><li>y</li></ol>", "1. x\n2. y"),
    ("<a href='http://h/a b%20c?q=1 2'>t</a>", "[t](http://h/a%20b%20c?q=1 2)"),
    ("<a href='javascript:x()'>t</a> <a href='http://h/'>http://h/</a>", "t <http://h/>"),
    ("<img alt='a' src='data:image/png;base64,AAA' data-src='/r.png'><u>u</u><strike>s</strike>", "![a](/r.png)<u>u</u>~~s~~"),
    ("<img src='data:image/png;base64,AAA'>", "![](data:image/png;base64...)"),
    ("<table><tr><th>a|b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a\\|b |  |\n| --- | --- |\n| 1 | 2 |"),
    ("<script>x</script><input type=checkbox checked>y", "[x] y"),
    ("<pre>a\n b</pre><blockquote>q</blockquote>", "```\na\n b\n```\n\n> q"),
])
def test_html(html, want):
    assert md(html) == want


def test_csv_and_notebook():
    assert formats.read_csv(b"\xef\xbb\xbfa,b|c\n\n1\n\n2,3,4\n\n")[0] == "| a | b\\|c |  |\n| --- | --- | --- |\n| 1 |  |  |\n|  |  |  |\n| 2 | 3 | 4 |"
    book = {"cells": [{"cell_type": "markdown", "source": ["# T \n", "x"]}, {"cell_type": "code", "source": "1"}, {"cell_type": "raw", "source": ["r"]}]}
    assert formats.read_notebook(json.dumps(book).encode()) == ("# T \nx\n\n```python\n1\n```\n\n```\nr\n```", "T")


def archive(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return buf.getvalue()


def test_zip_and_dispatch():
    data = archive({"a.txt": "hi", "b.xyz": "?", "c/d.csv": "x,y\n1,2", "in.zip": archive({"e.md": "# e"})})
    text, _ = formats.convert(data, "f.zip")
    assert text.startswith("Content from the zip file `f.zip`:\n\n## File: a.txt\n\nhi") and "## File: e.md\n\n# e" in text and "xyz" not in text
    assert formats.convert(b"not json", "n.ipynb")[0] == "not json"  # falls through to plain text
    with pytest.raises(formats.Unsupported):
        formats.convert(b"?", "x.bin")


def test_files_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("x,y\n1,2")
    (src / "b.bin").write_bytes(b"\x00")
    rows = {r.name: r for r in files.convert(files.scan(spark, str(src))).collect()}
    assert rows["a.csv"].success and rows["a.csv"].markdown.startswith("| x | y |") and rows["b.bin"].error.startswith("unsupported")
    q = streaming.convert_dropped(spark, str(src), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    routed = files.route(spark.createDataFrame([("A.HTML",), ("x/y.zip",), ("z",)], "name string")).select("name", "reader").collect()
    assert [r.reader for r in routed] == ["read_html", "read_zip", None]


def test_entry_runs_without_llm(spark):
    from textloom.plans import catalogue

    out = catalogue.QUERIES["doc_stats"](spark, "/root/testdata/sf0.001")
    assert out.agg(F.count("*")).first()[0] == 200
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
