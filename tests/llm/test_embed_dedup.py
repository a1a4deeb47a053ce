import numpy as np
import pytest

from textloom.llm import embed_dedup as E


def data(seed=0, n=700, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and i % 3 == 0:
            v = np.array(rows[r.integers(0, i)][1]) * r.uniform(0.5, 2) + r.normal(0, 0.05, dim)
        elif i % 10 == 1 and i > 10:
            v = np.array(rows[1][1])
        else:
            v = r.normal(0, 1, dim)
        rows.append((i, v.tolist()))
    return rows


def brute(rows):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T >= 0.95
    np.fill_diagonal(g, False)
    comp = list(range(len(rows)))
    while True:
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(g[i]))]) for i in range(len(rows))]
        if new == comp:
            return {i: (int(g[i].sum()), comp[i]) for i in range(len(rows))}
        comp = new


@pytest.mark.parametrize("block,cell,probes", [(1024, 400, 6), (16, 40, 20), (8, 10_000, 6)])
def test_equals_brute_force(spark, monkeypatch, block, cell, probes):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "CELL", cell)
    rows = data()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n_links int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df, probes=probes).collect()}
    assert got == brute(rows)


def test_recall_with_few_probes(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 30)
    rows = data(5)
    want, got = brute(rows), {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= want[i][0] for i in got)
    assert sum(got.values()) >= 0.98 * sum(x[0] for x in want.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]), (10, [1e-300, 0.0]), (None, [1.0, 0.0]), (11, [1e300, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    assert got == {**{i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 11)}, 7: (2, 7, True), 8: (2, 7, False), 10: (2, 7, False)}
    assert E.near_duplicates(df.limit(0)).collect() == []
