"""Nearest words against all pairs, spelling reports against a plain loop, places against splitting lines."""

from __future__ import annotations

import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import places, script
from textloom.operators import nearest, written


def all_pairs(word, vocabulary, k, cutoff):
    scored = []
    for v in vocabulary:
        r = difflib.SequenceMatcher(None, v, word).ratio()
        if r >= cutoff:
            scored.append((r, v))
    return [(v, r) for r, v in sorted(scored, reverse=True)[:k]]


def words(r, n, letters, longest):
    return ["".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("seed, letters, longest", [(1, "abc", 8), (2, "abcdefghijklmnop", 10), (3, "কখগািে্", 9), (4, "ab", 300)])
def test_equals_all_pairs(seed, letters, longest):
    r = random.Random(seed)
    vocabulary, asked = sorted(set(words(r, 150, letters, longest))), words(r, 40, letters + "z", longest)
    for k, cutoff in ((4, 0.6), (2, 0.55), (50, 0.3), (3, 0.0)):
        got, compared = nearest.Vocabulary(vocabulary).nearest(asked, k, cutoff)
        assert got == [all_pairs(w, vocabulary, k, cutoff) for w in asked]
        assert compared <= len(asked) * len(vocabulary)


def test_bounds_skip_most_pairs(monkeypatch):
    r = random.Random(9)
    vocabulary, asked = words(r, 3000, "abcdefghijklmnopqrst", 9), words(r, 50, "abcdefghijklmnopqrst", 9)
    monkeypatch.setattr(nearest, "SLICE", 700)
    got, compared = nearest.Vocabulary(vocabulary).nearest(asked, 4, 0.6)
    assert got == [all_pairs(w, sorted(set(vocabulary)), 4, 0.6) for w in asked]
    assert compared < 0.1 * len(asked) * len(vocabulary)


def test_frames(spark):
    v = spark.createDataFrame([("court",), ("count",), ("county",), ("",), (None,), ("court",)], "word string")
    w = spark.createDataFrame([("courts",), ("courts",), (None,), ("",), ("zzz",)], "word string")
    got = {(r.word, r["rank"]): (r.match, round(r.ratio, 4)) for r in nearest.nearest(w, v, 2).collect()}
    assert got == {("courts", 1): ("court", 0.9091), ("courts", 2): ("count", 0.7273)}
    assert nearest.nearest(w, v.limit(0)).count() == 0


def suspects(text, vocabulary):
    known, out = set(vocabulary), []
    for n, line in enumerate((text or "").split("\n"), 1):
        for m in re.finditer("[ঀ-৿]+", line):
            word = unicodedata.normalize("NFC", m[0])
            if len(m[0]) <= 1 or all("০" <= c <= "৯" for c in m[0]) or word in known:
                continue
            near = all_pairs(word, known, 4, 0.6)
            if not near and len(m[0]) > 2:
                stem = script.SUFFIX.sub("", word)
                if stem in known:
                    continue
                near = all_pairs(stem, known, 4, 0.55)
            out.append((n, m.start() + 1, m[0], [v for v, _ in near]))
    return out


def test_spelling_equals_a_loop(spark):
    r = random.Random(4)
    vocabulary = ["ঢাকা", "নদী", "সরকার", "বিভাগ", "আইন", "ভাষা", "বাংলা", "বাংলাদেশ", "কাজ"]
    bad = ["ঢাক্কা", "ঢাকাটি", "কাজগুলো", "ষষষষষষ", "১২৩", "ক", "সরকর", "বাঙলাদেশ", "য়য", "আইনের"]
    docs = [(i, "".join(r.choice([*vocabulary, *bad, "x", "english"]) + r.choice([" ", "\n", ", "]) for _ in range(r.randrange(30)))) for i in range(60)]
    docs += [(60, None), (61, "")]
    got = {}
    rows = nearest.spelling(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    for x in rows.collect():
        got.setdefault(x.doc_id, []).append((x.line, x.col, x.word, x.suggestions))
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(s) for i, t in docs if (s := suspects(t, vocabulary))}
    assert any(not s for v in got.values() for *_, s in v) and len({w for v in got.values() for _, _, w, _ in v}) >= 5


def test_spelling_sends_forms_only(spark, tmp_path, monkeypatch, capsys):
    spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("ঢাক্কা নদী " * 9).alias("text")).write.parquet(str(tmp_path / "docs"))  # a small file of many words
    vocabulary = spark.createDataFrame([("ঢাকা",), ("নদী",)], "word string")
    counts = []
    for size in (written.SENT_BYTES, 0):
        monkeypatch.setattr(written, "SENT_BYTES", size)
        rows = nearest.spelling(spark.read.parquet(str(tmp_path / "docs")), vocabulary)
        rows.explain()
        joins = [x for x in capsys.readouterr().out.splitlines() if "Join" in x]
        assert len(joins) == 1 and ("BuildRight" if size else "SortMergeJoin") in joins[0]
        counts.append(rows.where("suggestions[0] = 'ঢাকা'").count())
    assert counts == [27000, 27000]


def test_places(spark):
    text = "a1\n\nbb22 3\r\n😀4\n5"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = df.orderBy("id").select(places.places(F.col("text"), "[0-9]+").alias("p")).collect()
    assert [(p.line, p.col, p.text) for p in got[0].p] == [(1, 2, "1"), (3, 3, "22"), (3, 6, "3"), (4, 2, "4"), (5, 1, "5")]
    assert all(text[p.start : p.end] == p.text for p in got[0].p) and got[1].p == [] == got[2].p


def test_subsequence_bound():
    vocabulary = nearest.Vocabulary(["abcd", "dcba", "xabxcd", "a" * 70, "zz"])  # sorted
    assert vocabulary.words[1:] == ["abcd", "dcba", "xabxcd", "zz"]
    every = nearest.np.arange(5)
    assert vocabulary._common("abcd", every).tolist() == [nearest.BITS, 4, 1, 4, 0] and vocabulary._common("b" * 64, every[1:]).tolist() == [1, 1, 1, 0]
