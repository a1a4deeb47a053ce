import random
import re

import numpy as np
import pytest

from textloom.llm import ngram_join as J


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "One  TWO"), (5, "a"), (6, "É"), (7, "é"), (8, " \x0b ")]
    bases = [[r.choice(vocab) for _ in range(r.choice([5, 12, 60, 200]))] for _ in range(25)]
    while len(rows) < n:
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((len(rows), r.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("k,num,block", [(4, 85, 512), (5, 80, 512), (4, 85, 4)])
def test_equals_brute_force(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n_shingles long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in J.keep_one(df).collect()) == [-1, 2]


def test_skip_join_random():
    r = np.random.default_rng(0)
    for _ in range(30):
        base = r.integers(0, 2**60, 80).astype(np.uint64)
        sets = []
        for _ in range(30):
            s = base.copy()[: r.integers(60, 80)]
            s[r.integers(0, len(s), r.integers(0, 9))] = r.integers(0, 2**60, 1).astype(np.uint64)
            sets.append(np.unique(s))
        side = r.integers(0, 2, 30)
        for sd in (None, side):
            want = {i: i for i in range(30)}

            def find(p, x):
                while p[x] != x:
                    x = p[x]
                return x

            for a in range(30):
                for b in range(a):
                    if sd is not None and sd[a] == sd[b]:
                        continue
                    i = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                        x, y = find(want, a), find(want, b)
                        want[max(x, y)] = min(x, y)
            got = {i: i for i in range(30)}
            for a, b in J.skip_join(sets, sd, 85, 100):
                x, y = find(got, a), find(got, b)
                got[max(x, y)] = min(x, y)
            assert [find(got, i) for i in range(30)] == [find(want, i) for i in range(30)]


def test_blocks_are_skipped_and_answers_derived():
    """Near copies of several bases in sizes that mostly cannot link: most entries are skipped, most answers derived."""
    r = np.random.default_rng(3)
    sets = []
    common = r.integers(0, 2**60, 30).astype(np.uint64)  # passages that all share
    for n in (40, 80, 160, 320):
        for _ in range(4):
            base = np.concatenate([common, r.integers(0, 2**60, n).astype(np.uint64)])
            for _ in range(8):
                s = base.copy()
                s[r.integers(0, len(s), 2)] = r.integers(0, 2**60, 2).astype(np.uint64)
                sets.append(np.unique(s))
    stats = {}
    links = J.skip_join(sets, None, 85, 100, stats)
    assert len(links) == 16 * 7  # a spanning tree of each base's copies
    assert stats["skipped"] > 3 * stats["read"] > 0
    assert stats["derived"] > 4 * stats["counted"] > 0


def test_ties_repeats_and_long_texts(spark):
    """Equal texts in any case, clashing columns, one text of 300,000 words."""
    long = " ".join(f"w{i % 7919}" for i in range(300_000))
    rows = [(3, long, 1, "x"), (1, long.upper(), 2, "y"), (2, "a b c d e", 3, None), (9, "A b C d E ", 4, None), (7, None, 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long, rep string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, 4, 85, 100).collect()}
    assert got == brute([(i, t) for i, t, *_ in rows], 4, 85, 100)
    kept = J.keep_one(df, 4, 85, 100)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7] and kept.columns == df.columns
