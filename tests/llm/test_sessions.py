"""Sessions against a plain loop, in chunks of a few rows and with clients cut in time."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random

import pytest

from textloom.llm import sessions

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, grp string"
ZERO = dt.datetime(2024, 1, 1)
MINUTE = 60_000_000


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def brute(rows):
    once = {}
    for r in sorted({r for r in rows if None not in (r[0], r[1], r[3])}, key=lambda r: (r[3], r[1])):
        once.setdefault(r[0], r)
    out = []
    for client in {r[3] for r in once.values()}:
        mine = sorted((us(r[1]), r[0], r) for r in once.values() if r[3] == client)
        late = [x for x in mine if x[2][2] is not None and us(x[2][2]) - x[0] > 60 * MINUTE]
        found = []
        for ts, click, r in (x for x in mine if x not in late):
            value = r[5] if r[5] is not None and math.isfinite(r[5]) else None
            final = r[4] == "purchase" and value is not None and value >= 60
            why = "first"
            if found:
                s = found[-1]
                why = "end" if s["final"] else "gap" if ts - s["end"] >= 30 * MINUTE else "length" if ts - s["start"] > 120 * MINUTE else None
            if why:
                if found:
                    found[-1]["closed"] = why
                found.append({"id": click, "start": ts, "path": [], "cents": 0})
            s = found[-1]
            s["path"].append(str(click))
            s["end"], s["final"], s["cents"] = ts, final, s["cents"] + (math.floor(100 * value + 0.5) if value is not None else 0)
        for k, s in enumerate(found):
            until = found[k + 1]["start"] if k + 1 < len(found) else math.inf
            out.append((
                client, s["id"], s["start"], s["end"], len(s["path"]), sum(s["start"] <= x[0] < until for x in late), s["cents"],
                s.get("closed", "end" if s["final"] else "none"), hashlib.sha256(",".join(s["path"]).encode()).hexdigest(),
            ))
    return sorted(out)


def clicks(seed, n=600):
    r = random.Random(seed)
    rows, at = [], dict.fromkeys(range(4), ZERO)
    for i in range(n):
        c = 0 if r.random() < 0.6 else r.randrange(4)
        step = r.choice([0, 0, 1, 5, 9, 14, 29, 30, 31, 119, 121]) if c else r.choice([0, 1, 3, 7, 12, 20])
        at[c] += dt.timedelta(minutes=step, microseconds=r.choice([0, 0, 1]))
        late = dt.timedelta(minutes=r.choice([0, 1, 60, 61, 600]) if r.random() < 0.2 else 0)
        kind = r.choice(["view", "view", "view", "purchase", None])
        value = r.choice([1.005, 59.999, 60.0, 80.25, -3.335, None, math.nan, math.inf])
        arrived = None if r.random() < 0.05 else at[c] + late
        rows.append((i * 7 % n, at[c], arrived, c, kind, value, "{}", "x"))
    rows += rows[:20] + [(n + 1, None, ZERO, 1, None, 1.0, None, None), (n + 2, ZERO, ZERO, None, None, 1.0, None, None), (None, ZERO, ZERO, 1, None, 1.0, None, None)]
    r.shuffle(rows)
    return rows


def run(spark, rows, **options):
    return sorted(tuple(x) for x in sessions.sessionise(spark.createDataFrame(rows, SCHEMA), **options).collect())


@pytest.mark.parametrize("seed, busy, chunk", [(1, 10_000, 65_536), (2, 10_000, 5), (3, 3, 7), (4, 1000, 65_536), (5, 2, 40), (6, 1, 3)])
def test_equals_a_loop(spark, seed, busy, chunk):
    rows = clicks(seed)
    assert run(spark, rows, busy=busy, chunk=chunk) == brute(rows)


def test_client_without_hard_breaks(spark):
    rows = [(i, ZERO + dt.timedelta(minutes=7 * i), None, 9, "view", None, None, None) for i in range(400)]
    got = run(spark, rows, busy=10, chunk=16)
    assert got == brute(rows)
    assert {x[7] for x in got} == {"length", "none"}


def test_late_before_the_first_session_and_at_edges(spark):
    late = dt.timedelta(hours=5)
    rows = [(1, ZERO, ZERO + late, 5, "view", 1.0, None, None)]
    rows += [(i, ZERO + dt.timedelta(minutes=9 * i), ZERO, 5, "purchase", 99.0, None, None) for i in range(2, 9)]
    rows += [(20 + i, ZERO + dt.timedelta(minutes=9 * i), ZERO + late * 2, 5, "view", 1.0, None, None) for i in range(2, 30)]
    for chunk in (2, 1000):
        assert run(spark, rows, busy=10, chunk=chunk) == brute(rows)


def test_clients_are_cut_in_time(spark):
    rows = spark.createDataFrame(clicks(8), SCHEMA)
    cut = sessions._groups_in_time(sessions.clicks_once(rows).where("client_id = 0"), 30 * MINUTE)
    assert cut.where("NOT late").select("grp").distinct().count() > 5


def test_empty_and_zone(spark):
    assert run(spark, []) == []
    rows = clicks(9, 50)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
