"""Codebooks and codes against plain Lloyd in Python integers; bounds that skip and never lose a tie."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from textloom.llm import yinyang

SCHEMA = "vec_id long, embedding array<float>, label int, ints string"


def brute(rows, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    d = width // 4
    cut = lambda v, p: v[p * d : (p + 1) * d]
    starts = {}
    for i, v, _ in sorted(((i, v, 0) for i, v, _ in kept if i is not None)):
        starts.setdefault(i, v)
    starts = [starts[i] for i in sorted(starts)[:256]] or [[0] * width]
    books = [[cut(v, p) for v in starts] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            parts = {}
            for _, v, _ in kept:
                parts.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, members in parts.items():
                books[p][e] = [sum(col) // len(members) for col in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [(i, [nearest(cut(v, p), books[p]) for p in range(4)], label) for i, v, label in kept]
    by = {}
    for _, near, label in found:
        by[label] = by.get(label, 0) + sum(d for d, _ in near)
    return sorted(((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), by[label], digest) for i, near, label in found), key=str)


def vectors(seed, n, d, coarse):
    r = random.Random(seed)
    rows = [(i, [r.randrange(-3, 4) / 1024 if coarse else r.gauss(0, 0.3) for _ in range(d)], r.choice([None, 1, 1, 1, 2]), "clash") for i in range(n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, d, coarse", [(1, 400, 16, False), (2, 500, 8, True), (3, 120, 12, True), (4, 700, 4, True)])
def test_equals_plain_lloyd(spark, seed, n, d, coarse):
    rows = vectors(seed, n, d, coarse)
    got = yinyang.compress(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_edges(spark):
    rows = vectors(5, 60, 6, False)  # a width that 4 does not divide
    rows += [(61, None, 1, None), (62, [0.5, None, 0.1, 0.2, 0.3, 0.4], 1, None), (63, [math.nan] * 6, 1, None), (64, [math.inf] * 6, 2, None)]
    rows += [(None, [0.25] * 6, 3, None), (65, [0.5, -0.5], None, None), (66, [], 2, None), rows[0], rows[0], (rows[0][0], [0.125] * 6, 2, None)]
    got = yinyang.compress(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_empty_and_no_ids(spark):
    assert yinyang.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, [0.5, 0.25, -0.1, 0.3], 1, None)] * 3
    assert sorted((tuple(x) for x in yinyang.compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    assert {x.code for x in yinyang.compress(spark.createDataFrame([(1, [], None, None)], SCHEMA)).collect()} == {"00000000"}


@pytest.mark.parametrize("seed, spread", [(0, 3), (1, 40), (2, 100_000), (3, 2**27)])
def test_bounds_skip_groups_and_keep_ties(seed, spread):
    r = np.random.default_rng(seed)
    x, book = r.integers(-spread, spread, (3000, 4)), r.integers(-spread, spread, (100, 4))
    book[50:60] = book[40:50]  # equal entries: the lower index wins
    home = yinyang.group_entries(book)
    entry = bounds = drift = None
    scanned = []
    for _ in range(8):
        entry, bounds, best, n = yinyang.assign(x, book, home, entry, bounds, drift)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (entry == d.argmin(1)).all() and (best == d.min(1)).all()
        scanned.append(n)
        moved = book.copy()
        for e in np.unique(entry):
            moved[e] = x[entry == e].sum(0) // (entry == e).sum()
        drift, book = yinyang._drift(book, moved, home), moved
    if spread > 3:
        assert scanned[-1] < scanned[0] / 2
