import itertools
import random

import numpy as np

from textloom.llm import html_crf as H


def test_blocks():
    page = '<!DOCTYPE html><head><title>x</title><script>var t="</p>";</script></head><body><p>a &amp; b<b> c</b><br>d<p>e<ul><li>f<li>g</ul>h &lt;i&gt; <a href="x>y">k</a> <div cla'
    got = H.leaf_blocks(page)
    assert [b.text for b in got] == ["a & b c d", "e", "f", "g", "h <i> k"]
    assert got[2].path == ("<body", "<ul", "<li") and got[4].linked == 1
    assert H.leaf_blocks("") == [] and [b.text for b in H.leaf_blocks("x < y &am")] == ["x < y &am"]
    assert len(H.leaf_blocks("<div>" * 5000 + "x")) == 1


def test_viterbi_and_gradient_equal_enumeration():
    crf = H.trained()
    r = random.Random(1)
    blocks = H.labelled_blocks(H.labelled_page(r))[0][:8]
    e = crf.emission(blocks)

    def total(y):
        return crf.begin[y[0]] + sum(e[i] * y[i] for i in range(len(y))) + sum(crf.edge[a, b] for a, b in zip(y, y[1:]))

    every = list(itertools.product([0, 1], repeat=len(blocks)))
    assert crf.decode(blocks) == list(max(every, key=total))
    feats = [H.path_features(b.path) + H.text_features(b, i, len(blocks)) + ["bias"] for i, b in enumerate(blocks)]
    p = np.exp([total(y) for y in every])
    p /= p.sum()
    err, _, _ = crf.gradient(feats, [1] * len(blocks))
    assert np.allclose(1 - err, (p[:, None] * np.array(every)).sum(0))


def test_held_out_accuracy():
    r = random.Random(77)
    crf = H.trained()
    right = n = whole = 0
    for _ in range(150):
        blocks, gold = H.labelled_blocks(H.labelled_page(r))
        got = crf.decode(blocks)
        right += sum(a == b for a, b in zip(gold, got))
        n += len(gold)
        whole += got == gold
    assert right / n > 0.97 and whole / 150 > 0.75, (right / n, whole)


def test_rows(spark):
    page = "<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='ad'>Buy this thing now.</div><article><h1>T é</h1><p>One two.</p><p>Sh.</p></article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (None, "w", "<p>", 1)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in H.extract(df).collect()))
    assert got == [(0, "", 0), (1, "T é\nOne two.\nSh.", 16), (1, "T é\nOne two.\nSh.", 16), (2, "", 0), (3, "", 0)]
    assert H.extract(df.limit(0)).collect() == []


def test_article_text_is_kept_whole():
    """Formulas, fallbacks of objects and canvases, and text for readers without scripts belong to the article."""
    crf = H.trained()
    page = "<body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>On values</h1><p>The value <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is given here.</p><p>See <object data=a>the drawing</object> and <canvas>its outline</canvas> below.</p><noscript><p>The table is printed at the end.</p></noscript><script>var x</script><style>p{}</style></article><footer>&copy; 2020</footer>"
    assert H.main_text(crf, page).split("\n") == ["On values", "The value x = 2 is given here.".replace("x = 2", "x=2"), "See the drawing and its outline below.", "The table is printed at the end."]


def test_deep_pages_keep_their_paths():
    """End tags close their own elements at any depth."""
    deep = "<div>" * 450
    page = f"<nav>{deep}<nav>inner</nav>{'</div>' * 450}still a menu</nav><article><p>text</p></article>"
    blocks = {b.text: b.path for b in H.leaf_blocks(page)}
    assert blocks["still a menu"] == ("<nav",) and blocks["text"] == ("<article", "<p") and blocks["inner"][0] == "<nav"
    many = H.leaf_blocks("<p>" + "<i>" * 20000 + "x" + "</i>" * 20000 + "</p><p>y")
    assert [b.text for b in many] == ["x", "y"] and many[1].path == ("<p",)


def test_very_long_page(spark):
    body = "".join(f"<p>Sentence number {i} of a very long article.</p>" for i in range(30_000))
    df = spark.createDataFrame([(1, "u", f"<html><body><nav><a href=x>Home</a></nav><article>{body}</article></body></html>", "z")], "page_id long, url string, html string, n_chars string")
    text = H.extract(df).first().text
    assert text.count("\n") == 29_999 and "Home" not in text
