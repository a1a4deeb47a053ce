from collections import defaultdict

import pytest

from textloom.llm import mixing as M


def rows():
    out = [(0, None, "b"), (1, "", "a"), (2, "one two three", None), (3, "x " * 5000, "hot")]
    for i in range(4, 900):
        out.append((i, "w " * (1 + i * 7919 % 97), "hot" if i % 3 == 0 else f"s{i % 11}" if i % 50 else "tiny"))
    return out


def test_targets_and_caps(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, source string, taken int").repartition(5)
    got = M.positions(M.mix(df)).collect()
    assert len(got) == len(rows())
    size, taken, target, most, n_rows = defaultdict(int), defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        n_rows[r.source] += 1
        most[r.source] = max(most[r.source], r["size"])
        assert r.taken <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    want, free, left = {}, set(size), float(sum(size.values()))
    while True:  # reshare round by round
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * size[s]] if w else []
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
            free.discard(s)
    want |= {s: left * weight[s] / w for s in free}
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], most[s] / 2 if n_rows[s] < 5 else 0), s
    again = {(r.doc_id, r.taken, r.position) for r in M.positions(M.mix(df.repartition(2))).collect()}
    assert again == {(r.doc_id, r.taken, r.position) for r in got}


def test_schedule_integrates():
    for knots in ([(0, 1), (1, 1)], [(0, 0.2), (0.3, 2), (1, 0.1)]):
        parts = M._segments(knots)
        assert parts[0][3] == 0 and all(a[3] < b[3] for a, b in zip(parts, parts[1:]))


def test_invert_demand(spark):
    from pyspark.sql import functions as F

    knots = [(0.0, 0.2), (0.3, 2.0), (1.0, 0.1)]
    seg = M._segments(knots)
    df = spark.range(101).select((F.col("id") / 100).alias("q")).select("q", M.invert_demand(F.col("q"), knots).alias("t"))
    for r in df.collect():
        t0, rate, slope, done = [s for s in seg if s[0] <= r.t + 1e-12][-1]
        assert done + rate * (r.t - t0) + slope * (r.t - t0) ** 2 / 2 == pytest.approx(r.q, abs=1e-9)


def test_order_and_empty(spark):
    df = spark.createDataFrame(rows()[:200], "doc_id long, text string, source string")
    out = M.training_order(df).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    assert M.mix(df.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (1, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in M.mix(blank).collect()] == [0, 0]


def test_repeated_and_null_ids(spark):
    """Every row has its own copies: n null ids or repeats do not multiply, and columns stay with their row."""
    data = [(1, "a b c", "s", 10), (1, "a b c", "s", 11), (1, "d e f g", "s", 12), (None, "h i", "s", 13), (None, "h i", "s", 14), (None, None, "s", 15), (2, "j " * 40, "t", 16), (2, "j " * 40, "t", 16)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, Copy int").repartition(3)
    mixed, out = M.mix(df), M.training_order(df).collect()
    assert mixed.count() == len(data)
    assert len(out) == mixed.agg({"copies": "sum"}).first()[0]
    assert out and all(r.text for r in out) and max(r["copy"] for r in out) <= 2
    assert M.training_order(df).columns == ["doc_id", "text", "source", "copy", "position"]
    extra = spark.createDataFrame([(*r[:3], r[3], "x") for r in data], "doc_id long, text string, source string, n int, __row string")
    got = M.training_order(extra).collect()
    per = defaultdict(int)
    for r in got:
        per[r.n] += 1
        assert (r.doc_id, r.text, r.source, r.n) in data and r["__row"] == "x"
    assert len(got) == len(out) and all(v <= 3 for k, v in per.items() if k != 16)


def test_one_source_takes_everything_once(spark):
    df = spark.createDataFrame([(i, "w " * (i % 13), None) for i in range(50)], "doc_id long, text string, source string")
    assert all(r.taken == r["size"] for r in M.mix(df).collect())
    assert M.training_order(df.limit(0)).collect() == []
