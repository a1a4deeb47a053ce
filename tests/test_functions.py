import datetime

import pytest
from pyspark.sql import functions as F

from textloom.functions import bengali, text
from textloom.operators import layout, memory


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("n,words", [(0, "শূন্য"), (5, "পাঁচ"), (28, "আটাশ"), (100, "এক শত"), (1234, "এক হাজার দুই শত চৌত্রিশ"), (10_000_000, "এক কোটি"), (10**10, "এক হাজার কোটি"), (9_999_999, "নিরানব্বই লাখ নিরানব্বই হাজার নয় শত নিরানব্বই")])
def test_number_words(spark, n, words):
    assert one(spark, bengali.number_words(F.lit(n))) == words


@pytest.mark.parametrize("day,want", [("2024-04-14", (1, "বৈশাখ", 1431)), ("2024-04-13", (1, "চৈত্র", 1430)), ("2025-04-13", (29, "চৈত্র", 1431)), ("2024-02-29", (17, "ফাল্গুন", 1430))])
def test_calendar(spark, day, want):
    b = one(spark, bengali.bangabda(F.lit(datetime.date.fromisoformat(day))))
    start = datetime.date(want[2] + 593, 4, 14)
    lengths = [31] * 5 + [30] * 7
    lengths[10] += (start.year % 4 == 0 and start.year % 100 != 0) or start.year % 400 == 0
    left, m = (datetime.date.fromisoformat(day) - start).days, 0
    while m < 11 and left >= lengths[m]:
        left, m = left - lengths[m], m + 1
    assert (b.day, b.month_name, b.year) == (left + 1, bengali.MONTHS[m], want[2])
    assert one(spark, bengali.gregorian(F.lit(b.day), F.lit(b.month), F.lit(b.year))) == datetime.date.fromisoformat(day)


def test_text(spark):
    assert one(spark, text.human_size(F.lit(1536))) == "1.5 KB" and one(spark, text.human_size(F.lit(5 << 20))) == "5.00 MB"
    assert one(spark, text.normalize_markdown(F.lit("a  \n\n\n\nb \t"))) == "a\n\nb"
    assert one(spark, text.words(F.lit(None).cast("string"))) == 0 and one(spark, text.sentences(F.lit("A. B! \n।?"))) == 2
    assert one(spark, text.drop_cid_lines(F.lit("ok cid:1\ncid:1 (cid:2)\nz"))) == "ok cid:1\nz"
    r = one(spark, bengali.ratio(bengali.script_counts(F.lit("আমি hello আমিx 12"))))
    assert (r.bn, r.en, r.other) == (0.5, 0.5, 0.25)
    assert one(spark, bengali.sentence_class(bengali.ratio(bengali.script_counts(F.lit("12 34"))))) == "en"


def test_glossary_and_layout(spark):
    out, n = memory.override_terms(F.lit("The Court's court of Appeal courts"), [("court", "X$1"), ("court of appeal", "Y")])
    row = spark.range(1).select(out.alias("t"), n.alias("n")).first()
    assert (row.t, row.n) == ("The X$1's Y courts", 2)
    assert one(spark, layout.clusters(F.array(*[F.lit(x) for x in (0.0, 15.0, 25.0, 40.0, 46.0)]), 20.0)) == [0.0, 25.0, 46.0]


def test_fuzzy_equals_all_pairs(spark):
    from itertools import product

    mem = [(i, t) for i, t in enumerate(["alpha beta gamma", "alpha beta gamme", "short", "", "a much longer line of text here", "élan vital théorie"])]
    qs = [(i, t) for i, t in enumerate(["alpha beta gamma", "alphabeta gamma", "a mch longer line of txt here", "zzz", "elan vital théorie"])]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for (i, q), (m, t) in product(qs, mem):
        s = 1 - lev(q, t) / max(len(q), len(t), 1)
        if q and t and s >= 0.9 and (i not in want or s > want[i][1]):
            want[i] = (m, s)
    got = memory.fuzzy_lookup(spark.createDataFrame(qs, "id long, source string"), spark.createDataFrame(mem, "mem_id long, text string"))
    assert {r.id: r.mem_id for r in got.collect()} == {i: m for i, (m, _) in want.items()}
