"""Texts in slices of bounded size, and what is made of them."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import chrf, places, script, segment, text
from textloom.operators import translate
from textloom.operators.slices import BATCH_BYTES, parts
from textloom.plans._registry import table
from textloom.sources import files


def test_parts():
    texts = pa.array(["aaaa", None, "bb", "cc", "ষষষষ", "", "d" * 9, "e"])
    got = [p.to_pylist() for p in parts(texts, 8)]
    assert got == [["aaaa", None, "bb", "cc"], ["ষষষষ"], [""], ["d" * 9], ["e"]] and not list(parts(texts.slice(0, 0), 8))
    assert [p.to_pylist() for p in parts(texts.slice(3, 2), 8)] == [["cc"], ["ষষষষ"]]


def test_columns_of_several_slices_keep_their_rows(spark):
    size = places.SLICE_BYTES // 3 + 1
    assert size == segment.SLICE_BYTES // 3 + 1 == script.SLICE_BYTES // 3 + 1 == files.SLICE_BYTES // 3 + 1
    df = spark.range(9).coalesce(1).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit(" "), size), F.lit("<b>é</b>")).alias("t"))
    df = df.withColumn("t", F.when(F.col("id") != 4, F.col("t")))
    rows = df.select("id", places.places(F.col("t"), "[0-9]").alias("p"), F.size(segment.segments(F.col("t"))).alias("s"), F.length(script.nfc("t")).alias("n")).collect()
    assert [(r.id, [p.text for p in r.p], r.s, r.n) for r in rows] == [(i, [] if i == 4 else [str(i)], 0 if i == 4 else 1, None if i == 4 else 1 + size + 8) for i in range(9)]
    md = files.html_to_markdown(df.select("id", F.lit("x").alias("title"), "t"), "t")
    assert md.columns == ["id", "t", "markdown", "title"] and [(r.id, (r.markdown or "")[:1]) for r in md.collect()] == [(i, "" if i == 4 else str(i)) for i in range(9)]


def test_sizes_round_a_half_to_the_even_digit(spark):
    sizes = [(1280,), (1024 + 768,), (2**20 + 2**17,), (2**20 - 1,), (2**30 + 3 * 2**27,), (None,)]
    got = [r[0] for r in spark.createDataFrame(sizes, "n long").select(text.human_size(F.col("n"))).collect()]
    assert got == ["1.2 KB", "1.8 KB", "1.12 MB", "1024.0 KB", "1.38 GB", None]


@pytest.mark.parametrize("cells", [0, 1 << 18])
def test_grams_equal_counters(cells, monkeypatch):
    monkeypatch.setattr(chrf, "CELLS", cells)
    chrf._reference.cache_clear()
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choices("ab c.আ😀", k=r.randrange(30))) for _ in range(2))
        x, y = ("".join(t.split()) for t in (a, b))
        for n in range(1, 7):
            p, q = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (x, y))
            assert chrf.chrf_counts(a, b)[3 * n - 3 : 3 * n] == [p.total() if q else 0, q.total(), (p & q).total()]
        for n in range(1, 5):
            p, q = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a.split(), b.split()))
            assert chrf.bleu_counts(a, b)[2 * n : 2 * n + 2] == [(p & q).total(), p.total()]
    chrf._reference.cache_clear()


def test_turns_hold_all_text(spark):
    parts_ = segment.segment("# One two. Three\n\nআমি যাই।  `x` last  \n")
    turns, rest, n = translate._turns(parts_, {"en", "mixed"})
    assert "".join("".join(t) for t in turns) + rest == "# One two. Three\n\nআমি যাই।  `x` last  \n" and n == len(parts_)
    docs = spark.createDataFrame([(1, None), (1, ""), (1, "আমি।"), (None, "আমি।")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text, r.segments) for r in translate.translate(docs, "bn").collect()) == [(0, "আমি।", 1), (1, "", 0), (1, "", 0), (1, "আমি।", 1)]


def test_sentence_ends_are_those_of_the_plain_rule():
    def stops(t: str, at: int) -> bool:
        before = t[:at]
        short = re.search(r"(?:^|\W)(?:" + "|".join(map(re.escape, segment.SHORT)) + r")\Z", before)
        return not (short or before[-1:].isdecimal() or t[at] == "." and not (re.search(r"\w\Z", before) and (at + 1 == len(t) or t[at + 1].isspace())))

    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choices(["Mr", "e.g", "p", "No", "Prof", ".", ".", "!", "?", "।", "\n", " ", " ", "1", "২", "ab", "আমি", "é", "(", "\x85"], k=r.randrange(14)))
        marks = [m.start() for m in segment._STOP.finditer(t)]
        assert marks == [i for i, c in enumerate(t) if c in "।!?\n." and stops(t, i) and not (c == "\n" and any(m < i and t[m] == "." and t[m + 1 : i + 1].isspace() for m in marks))]
        assert "".join(segment.sentences(t)) == t


def test_tables_come_to_python_in_batches_of_bounded_bytes(spark, tmp_path):
    spark.range(3000).coalesce(1).select("id", F.repeat(F.lit("ab "), 3000).alias("t")).write.parquet(f"{tmp_path}/wide.parquet")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    got = [r.n for r in table(spark, str(tmp_path), "wide").coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 27_000_000 and max(got) < 2 * BATCH_BYTES


def test_a_reference_is_read_once_for_the_rows_of_some_batches():
    r = random.Random(5)
    refs = [" ".join(r.choices(["a.", "bc", "আb,", "(d", " ", "x\x1fy", "..", "e"], k=r.randrange(9))) for _ in range(40)] + [None]
    pairs = [(r.choice(["g", "h", None]), r.choice([*refs, None]), refs[i % 41]) for i in range(600)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pairs[i : i + 50])], names=["lang", "hyp", "ref"]) for i in range(0, 600, 50)]
    chrf._reference.cache_clear()
    got = {k: np.zeros(1 + chrf.COUNTS, int) for k in ("g", "h", None)}
    for out in chrf._sums(batches):
        for k, n in zip(out.column("lang").to_pylist(), out.column("n").to_pylist()):
            got[k] += n
    assert chrf._reference.cache_info().misses <= len(refs)
    for k, total in got.items():
        counts = [[1, *chrf.chrf_counts(a or "", b or ""), *chrf.bleu_counts(a or "", b or "")] for g, a, b in pairs if g == k]
        assert total.tolist() == np.sum(counts, 0).tolist()


def test_tokens_of_words():
    """Words as str.split() gives them, one mark at an end split off."""
    r = random.Random(6)
    lines = ["".join(r.choices("ab.,( \x1f　আ😀\n", k=r.randrange(12))) for _ in range(300)]
    cut = lambda w: [w[:-1], w[-1]] if len(w) > 1 and w[-1] in ".,(" else [w[0], w[1:]] if len(w) > 1 and w[0] in ".,(" else [w]
    texts = chrf._Texts(lines)
    of = lambda start: [b.decode("utf-32-le") for b in texts.pieces(start).to_pylist()]
    assert of(texts.words) == [w for t in lines for w in t.split()]
    assert of(texts.tokens()) == [x for t in lines for w in t.split() for x in cut(w)]
    assert np.diff(np.searchsorted(texts.words, texts.stops), prepend=0).tolist() == [len(t.split()) for t in lines]
