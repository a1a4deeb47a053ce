import random

import numpy as np
import pyarrow as pa

from textloom.llm import decontam as D
from textloom.llm._text import words


def slow_sw(a, b):
    best = 0
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = max(0, m[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), m[i - 1][j] - 1, m[i][j - 1] - 1)
            best = max(best, m[i][j])
    return best


def test_alignment_equals_table():
    r = np.random.default_rng(0)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(1, 15)), r.integers(0, 5, r.integers(0, 25))
        assert D.smith_waterman(a, b)[0] == slow_sw(a.tolist(), b.tolist())


def data():
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    common = ["the", "of", "and", "to"]
    say = lambda n: [r.choice(common if r.random() < 0.4 else vocab) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([14, 30, 55])))) for i in range(30)] + [(30, "a b"), (31, None), (32, ""), (None, "x y z w")]
    docs, leaks = [], set()
    for i in range(300):
        body = say(r.choice([5, 80, 900]))
        if i % 3 == 0:
            k = 0 if i % 2 else r.randrange(30)  # item 0 is in a sixth of the documents
            piece = items[k][1].split()
            for _ in range(len(piece) // 10):
                piece[r.randrange(len(piece))] = r.choice(vocab)
            if i % 9 == 0:
                del piece[len(piece) // 2]
            at = r.randrange(len(body))
            body[at:at] = piece
            leaks.add((i, k))
        docs.append((i, " ".join(body).title(), 1))
    return items, docs + [(300, None, 1), (301, "", 1), (None, items[0][1], 1)], leaks


def brute(items, docs):
    """Alignment of every item with every whole text."""
    hashed = {}
    for kind, rows in (("i", items), ("d", docs)):
        for row in rows:
            if row[0] is not None and row[1]:
                hashed[kind, row[0]] = next(words(pa.array([row[1]]))).hash
    return {
        (d, i)
        for k, d in hashed if k == "d"
        for q, i in hashed if q == "i" and len(hashed["i", i])
        if D.smith_waterman(hashed["i", i], hashed["d", d])[0] / (2 * len(hashed["i", i])) >= (D.THRESHOLD if len(hashed["i", i]) >= D.N else 1)
    }


def test_equals_whole_text_alignment(spark, monkeypatch):
    items, docs, leaks = data()
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    got = {(r.doc_id, r.item_id) for r in D.find_contamination(d, b).collect()}
    assert got == brute(items, docs) and leaks <= got
    monkeypatch.setattr(D, "SLICE_CHARS", 2000)
    assert {(r.doc_id, r.item_id) for r in D.find_contamination(d, b).collect()} == got
    kept = [r.doc_id for r in D.drop_contaminated(d, b).collect()]
    assert len(kept) == len(docs) - len({x for x, _ in got}) and None in kept


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(d, b).collect() == []
    assert D.find_contamination(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), b).collect() == []


def test_hot_items_are_found_at_any_share(spark):
    """Short and edited items that a half or all of the documents hold, and one of two."""
    r = random.Random(8)
    items = [(0, "k1 k2 k3"), (1, "m1 m2 m3 m4 m5"), (2, " ".join(f"p{i}" for i in range(15)))]
    edited = items[2][1].split()
    for i in (2, 6, 9, 12):
        edited[i] = "zz"
    say = lambda n: [f"v{r.randrange(500)}" for _ in range(n)]
    for n, every in ((60, 1), (60, 2), (60, 3), (2, 2), (1, 1)):
        docs = [(i, " ".join(say(20) + ([*items[0][1].split(), *say(9), *items[1][1].split(), *say(30), *edited] if i % every == 0 else []) + say(20))) for i in range(n)]
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = {(x.doc_id, x.item_id) for x in D.find_contamination(d, b).collect()}
        assert got == brute(items, docs) and len(got) == 3 * -(-n // every)


def test_short_items_whole_copies_and_few_documents(spark, monkeypatch):
    """Items of one to eight words that stand whole in one of one, two or three documents, or in all of a hundred."""
    items = [(1, "Zork"), (2, "quux zork"), (4, "k1 k2 k3 k4"), (8, "e1 e2 e3 e4 e5 e6 e7 e8"), (9, "e1 e2 e3 e4 e5 e6 e7 e8"), (5, " \t ")]
    whole = "x zork y quux  ZORK k1 k2 k3 k4 z e1 e2 e3 e4 e5 e6 e7 e8 end zork"
    for n, every in ((1, 1), (2, 2), (3, 3), (100, 1)):
        docs = [(i, whole if i % every == 0 else f"quux a b c d{i}", "t") for i in range(n)] + [(n, "zor k quux"), ]
        docs = [(*d, "t")[:3] for d in docs]
        d, b = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(items, "item_id long, text string")
        got = {(x.doc_id, x.item_id): x for x in D.find_contamination(d, b).collect()}
        assert set(got) == {(i, k) for i in range(0, n, every) for k in (1, 2, 4, 8, 9)}
        assert {got[0, k].score for k in (1, 2, 4, 8, 9)} == {1.0}
        assert (got[0, 1].start_word, got[0, 1].end_word) == (1, 2) and (got[0, 2].start_word, got[0, 2].end_word) == (3, 5)


def test_seeds_shared_by_many_items(spark, monkeypatch):
    """Memory is cut by ranges of items without a change of result; repeated documents each give rows."""
    r = random.Random(4)
    items = [(i, "what is the answer to " + " ".join(f"v{r.randrange(60)}" for _ in range(r.choice([3, 9])))) for i in range(80)]
    docs = [(i // 2, " ".join([*(f"v{r.randrange(60)}" for _ in range(30)), *items[i][1].split()])) for i in range(40)] + [(99, "what is the answer " * 3000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, D.find_contamination(d, b).collect()))
    monkeypatch.setattr(D, "SPREAD", 50)
    w = next(words(pa.array([t for _, t in docs])))
    own = D._Items(items)
    got = sorted((docs[x][0], own.ids[i], *v) for x, i, *v in D._match_chunk(own, np.ones(len(own.uniq)), w, D.THRESHOLD))
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(want) >= 40
