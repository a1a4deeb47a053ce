"""Glossary overrides against term-by-term regular expressions, and kept terms against str.find."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import glossary


def one_by_one(text, entries, reverse=False):
    count = 0
    for term, translation, exact in sorted(entries, key=lambda e: -len(e[0])):
        source, target = (translation, term) if reverse else (term, translation)
        text, n = re.subn(rf"\b{re.escape(source)}\b", lambda _: target, text, flags=0 if exact else re.IGNORECASE)  # noqa: B023
        count += n
    return text, count


def texts(r, n, words):
    seps = [" ", " ", " ", "  ", ", ", ".", "\n", "-", "", "_", "'"]
    return ["".join(r.choice(words) + r.choice(seps) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("dense", [0, 1 << 23])
def test_equals_term_by_term(seed, dense):
    r = random.Random(seed)
    syllables = ["a", "an", "The", "court", "অব", "দেশ", "ের", "É", "ß", "x1", "Of", "c++", "Σ"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(40)]
    every = words + [f"{r.choice(words)} {r.choice(words)}" for _ in range(40)]
    targets = ["ঢাকা", "zz", "Q", "$1 \\g<0>", "(x)", *r.sample(every, 5)] if seed % 2 else [f"<{i}>" for i in range(9)] + ["zzz", "ঞ"]
    entries, seen = [], set()
    for term in r.sample(every, 30):
        if term.lower() not in seen:
            seen.add(term.lower())
            entries.append((term, r.choice(targets), r.random() < 0.3))
    docs = texts(r, 60, words + [w.upper() for w in words])
    for reverse in (False, True):
        got = glossary.Overrides(entries, reverse, dense).apply(docs)
        want = [one_by_one(t, entries, reverse) for t in docs]
        assert list(zip(*got)) == want


def test_five_hundred_terms_in_one_pass():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(900)})
    terms = words[:400] + [f"{a} {b}" for a, b in zip(words[100:200], words[200:300])]
    entries = [(t, f"শব্দ{i}", i % 5 == 0) for i, t in enumerate(terms)]
    o = glossary.Overrides(entries)
    assert not o.risky.any()
    docs = texts(r, 200, words)
    assert list(zip(*o.apply(docs))) == [one_by_one(t, entries) for t in docs]


def test_spans_cross_lanes_and_texts():
    terms = ["ab", "abab", "b", "ba\x00", "zzz"]
    docs = ["ab" * 9000, "", "b\x00a", "xabababx", "ba", "\x00"]
    for dense in (0, 1 << 23):
        got = glossary.Matcher(terms, [True] * 5, False, dense).spans(docs)
        for text, found in zip(docs, got):
            want = [(m.start(), m.start() + len(t), k) for k, t in enumerate(terms) for m in re.finditer(f"(?={re.escape(t)})", text)]
            assert sorted(found) == sorted(want)


def test_frames(spark):
    rows = [(1, "The court of Appeal's Court", "x"), (2, None, "y"), (3, "", None), (4, "COURT", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, replacements_made string")
    entries = spark.createDataFrame(
        [(1, "court", "old", False), (2, "Court", "আদালত", False), (3, "Court of appeal", "আপিল আদালত", False), (4, "COURT", "X", True), (5, "", "none", False), (6, "none", None, False)],
        "seq int, term string, translation string, case_sensitive boolean",
    )
    got = {r.doc_id: (r.text, r.replacements, r.replacements_made) for r in glossary.override(df, entries).collect()}
    assert got == {1: ("The আপিল আদালত's আদালত", 2, "x"), 2: (None, 0, "y"), 3: ("", 0, None), 4: ("আদালত", 1, "z")}
    back = glossary.override(df.withColumn("text", F.lit("আপিল আদালত ও আদালত")), entries.where("seq = 3"), reverse=True).first()
    assert (back.text, back.replacements) == ("Court of appeal ও আদালত", 1)
    assert glossary.override(df, entries.where("seq > 4")).where("replacements > 0").count() == 0
    spans = glossary.term_spans(df, entries.select("term")).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in spans[0].spans] == [(4, 9), (22, 27)] and spans[1].spans == []


def test_too_many_terms(spark, monkeypatch):
    monkeypatch.setattr(glossary, "MAX_TERMS", 2)
    entries = spark.range(3).select(F.col("id").cast("string").alias("term"), F.lit("x").alias("translation"), F.lit(False).alias("case_sensitive"))
    with pytest.raises(ValueError):
        glossary.override(spark.createDataFrame([("1",)], "text string"), entries)


def test_a_task_holds_a_slice_of_its_batch(spark):
    size = glossary.SLICE_CHARS // 8
    df = spark.range(40).coalesce(1).select("id", F.repeat(F.lit("x"), size).alias("text"))
    sent = spark.sparkContext.broadcast(None)
    rows = glossary._with_texts(df, "text", sent, "held long", lambda _, texts: (None, pa.array([sum(map(len, texts))] * len(texts), pa.int64())))
    assert [r.id for r in rows.select("id").collect()] == list(range(40)) and rows.agg(F.max("held")).first()[0] <= glossary.SLICE_CHARS


def test_totals_are_those_of_the_spans(spark):
    docs = spark.createDataFrame([(1, "abc ab bc"), (2, ""), (3, None), (4, "😀 xabcabc AB")], "id int, text string")
    terms = spark.createDataFrame([("ab",), ("bc",), ("abc",), ("",)], "term string")
    spans = {r.id: r.spans for r in glossary.term_spans(docs, terms).collect()}
    want = {i: (len(s), sum(x.end - x.start for x in s), min((x.start for x in s), default=None)) for i, s in spans.items()}
    assert {r.id: tuple(r.totals) for r in glossary.term_totals(docs, terms).collect()} == want and want[4] == (6, 14, 3) and want[3] == (0, 0, None)
    assert {tuple(r.totals) for r in glossary.term_totals(docs, terms.where("term = ''")).collect()} == {(0, 0, None)}
