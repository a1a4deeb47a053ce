import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import chrf, script, segment, templates
from textloom.operators import translate


def test_segments_are_lossless():
    rng = random.Random(1)
    bits = ["Mr. X ate 3.14 pies. ", "আমি যাই। ", "# h\n", "\n\n", "| a | b |\n", "|---|---|\n", "`c`", "```\nx\n```", "http://h/a?b ", "a@b.co", "- li\n", "1. n", " ", "?!", "---\n", " ", "\r\n", "> q", "e.g. so"]
    for _ in range(500):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert "".join(t for t, _, _ in segment.segment(text, ("pies", "X ate"))) == text
        assert "".join(segment.chunks(text, 5)) == text


@pytest.mark.parametrize("text,want", [
    ("Dr. No. 5 is in. Go!", ["Dr. No. 5 is in. ", "Go!"]),
    ("It is 3.14. Next? Yes", ["It is 3.14. Next?", " Yes"]),
    ("আমি। তুমি", ["আমি।", " তুমি"]),
    ("What?! Ok", ["What?", "!", " Ok"]),
])
def test_sentences(text, want):
    assert segment.sentences(text) == want


def test_kinds():
    got = segment.segment("# Head\nsee `x` or http://h/p.\n| a | b |\n|---|---|\n", ("or",))
    assert [(t, k) for t, _, k in got if k != "text" and k != "whitespace"] == [("# ", "markdown_syntax"), ("`x`", "inline_code"), ("or", "do_not_translate"), ("http://h/p.", "url"), ("|", "markdown_syntax"), ("|", "markdown_syntax"), ("|", "markdown_syntax"), ("|---|---|\n", "markdown_syntax")]
    assert segment.label("আমি hello আমি তুমি সে") == "bn" and segment.label("12") == "en" and segment.label("আমি hi") == "mixed"


def test_chunks():
    text = "one two three. four five six. seven\n\n```\na b c d e f g h i j\n```\n\nx"
    assert segment.chunks(text, 6) == ["one two three. ", "four five six. seven\n\n", "```\na b c d e f g h i j\n```\n\n", "x"]


def test_chrf(spark):
    assert chrf.chrf_score(chrf.chrf_counts("the cat", "the cat")) == pytest.approx(100)
    counts = chrf.chrf_counts("ab", "ac")  # one of two letters, no pair, no word
    assert chrf.chrf_score(counts) == pytest.approx(100 * 0.5 / 3)
    rows = spark.createDataFrame([("g", "the cat sat on it", "the cat sat on it"), ("g", "a b c d", "a b c e"), ("h", "", "x"), ("h", None, "y")], "g string, hyp string, ref string")
    got = {r.g: r for r in chrf.corpus_scores(rows, ["g"]).collect()}
    pairs = [("the cat sat on it", "the cat sat on it"), ("a b c d", "a b c e")]
    total = [sum(x) for x in zip(*(chrf.chrf_counts(*p) for p in pairs))]
    assert got["g"].chrf == round(chrf.chrf_score(total), 2) and (got["h"].chrf, got["h"].bleu) == (0.0, 0.0)
    assert got["g"].bleu == round(100 * (8 / 9 * 6 / 7 * 4 / 5 * 2 / 3) ** 0.25, 2)
    d = rows.select(chrf.drift(F.col("ref"), F.col("hyp")).alias("d")).select("d.*").collect()
    assert [r.drifted for r in d] == [False, False, True, True]


def test_template(spark):
    template = {"fields": [
        {"name": "no", "pattern": r"(?:No|নং)\s*(?:(\d+)|([A-Z]+))", "confidence_threshold": 0.8}, {"name": "all", "type": "list", "pattern": r"§\s*(\w+)"}, {"name": "last", "pattern": r"^end: (.*)\Z"}, {"name": "two", "type": "list", "pattern": "(a)-(b)?"},
    ]}
    docs = spark.createDataFrame([(1, "No ABCD\n§ 1 § ২ § 1\nend: x|y"), (2, None), (3, "a-b a- a-b No 7")], "doc_id long, text string")
    rows = {r.doc_id: r for r in templates.extract(docs, template).withColumn("md", templates.summary(F.col("fields"), "T")).collect()}
    f = rows[1].fields
    assert (f["no"].value, f["no"].confidence, f["no"].passed) == (["ABCD"], 0.9, True) and (f["all"].value, f["all"].confidence) == (["1", "২"], 0.9)
    assert f["last"].value == ["x|y"] and rows[1].overall_confidence == 0.75 and "| **last** | x\\|y | 75% |" in rows[1].md
    assert rows[2].overall_confidence == 0 and rows[3].fields["two"].value == ["a b", "a"] and rows[3].fields["no"].confidence == 0.75


def test_script(spark):
    assert script.type_phonetic("bhlakkhm x") == "ভ্লআক্ষ্ম x" and script.type_phonetic("kh", "probhat") == "কh" and script.type_phonetic("ok", own={"ok": "!"}) == "!"
    row = spark.createDataFrame([("ক্ষি|ab‌  c||\nকাি ্",)], "t string").select(script.graphemes(F.col("t")).alias("g"), script.normalize(F.col("t")).alias("n"), script.broken(F.col("t")).alias("b")).first()
    assert row.g[0] == "ক্ষি" and row.n == "ক্ষি।ab c॥\nকাি ্" and [(x.line, x.kind) for x in row.b] == [(2, "orphan_halant"), (2, "double_vowel_sign")]
    assert script.diff("ab", "ac") == [("equal", "a"), ("delete", "b"), ("insert", "c")]


def test_translate(spark):
    docs = spark.createDataFrame([(1, "# Title\n\nHello world. Bye `x` now."), (2, "আমি যাই।"), (3, None)], "doc_id long, text string")
    memory = spark.createDataFrame([("Hello world.", "to_bn", "হ্যালো।")], "source_text string, direction string, target_text string")
    got = {r.doc_id: r for r in translate.translate(docs, "bn", memory, lambda ts: [f"<{t}>" for t in ts], [("bye", "TATA")]).collect()}
    assert got[1].text.startswith("# ") and "হ্যালো। <TATA> `x` <now.>" in got[1].text and (got[1].translated, got[1].from_memory) == (4, 1)
    assert got[2].text == "আমি যাই।" and (got[2].translated, got[3].text, got[3].segments) == (0, "", 0)


def test_next_filled_line(spark, tmp_path):
    from textloom.plans import language

    docs = spark.createDataFrame([(1, "a\n\n \nb\nc\n\n"), (2, ""), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = language.next_filled_line(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.line, r.next_line) for r in got) == [(1, 1, 4), (1, 2, 4)]
