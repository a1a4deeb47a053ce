import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textloom.streaming import timers

SCHEMA = "event_id long, user_id long, ts timestamp, arrived_at timestamp, value double"
T0 = dt.datetime(2024, 1, 1)


def _minutes(x):
    return T0 + dt.timedelta(minutes=x)


def _events():
    """Events of 4 users with late ones, repeats, nulls and one user who goes on for long."""
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        at = rnd.randrange(0, 3000)
        late = rnd.choice([0, 1, 5, 20, 59, 60, 61, 300])
        rows.append((i, rnd.choice([1, 2, 3, 4, 4, 4]), _minutes(at), _minutes(at + late), rnd.choice([None, 1.0, 2.5])))
    rows += [(r[0], r[1], r[2], r[3] + dt.timedelta(minutes=rnd.choice([0, 3, 200])), r[4]) for r in rows[:60]]
    rows += [(None, 1, T0, T0, 1.0), (900, None, T0, T0, 1.0), (901, 1, None, T0, 1.0), (902, 1, T0, None, 1.0)]
    return rows


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def _folder(spark, rows, path, schema, by):
    """Files in order of arrival, one a slice of rows."""
    rows = sorted(rows, key=lambda r: (r[by] is None, r[by] or T0))
    step = max(1, len(rows) // 6)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _plain(rows, quiet, allowed):
    rows = [r for r in rows if None not in r[:4]]
    late = [r for r in rows if r[3] - r[2] > allowed]
    first = {}
    for r in sorted((r for r in rows if r[3] - r[2] <= allowed), key=lambda r: (r[3], r[2], r[4] or 0)):
        first.setdefault((r[0], r[1]), r)
    out = [(r[1], True, r[2], r[2], 1, r[4] or 0.0) for r in late]
    for user in {r[1] for r in first.values()}:
        run = []
        for r in [*sorted((r for r in first.values() if r[1] == user), key=lambda r: (r[2], r[0])), None]:
            if run and (r is None or r[2] - run[-1][2] >= quiet):
                out.append((user, False, run[0][2], run[-1][2], len(run), sum(x[4] or 0 for x in run)))
                run = []
            run.append(r)
    return sorted(out)


def _rows(df):
    c = df.select("user_id", "late", F.timestamp_micros("start_us").alias("s"), F.timestamp_micros("last_us").alias("l"), "n", "total")
    return sorted(tuple(r) for r in c.collect())


def test_table_equals_plain(spark):
    rows = _events()
    got = _rows(timers.quiet_runs(spark.createDataFrame(rows, SCHEMA)))
    assert got == _plain(rows, dt.timedelta(minutes=30), dt.timedelta(minutes=60)) and any(r[4] > 3 for r in got) and any(r[1] for r in got)
    assert timers.quiet_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_with_timers_equals_table(rocks, tmp_path):
    """Late, repeated and expired keys; a last event, far off, moves the watermark past all others."""
    spark, rows = rocks, _events()
    end = (999, 9, _minutes(9000), _minutes(9000), 1.0)
    stream = _folder(spark, [*rows, end], tmp_path / "in", SCHEMA, 3)
    out, side = str(tmp_path / "runs"), str(tmp_path / "late")
    timers.write_apart(timers.quiet_runs(stream), out, side, str(tmp_path / "state")).awaitTermination(120)
    runs = spark.read.parquet(out).withColumn("late", F.lit(False)).unionByName(spark.read.parquet(side).withColumn("late", F.lit(True)))
    assert _rows(runs) == [r for r in _rows(timers.quiet_runs(spark.createDataFrame(rows, SCHEMA)))]
    assert spark.read.parquet(out).select("batch").distinct().count() > 1


def test_pairs_within_a_time(spark, tmp_path):
    rnd = random.Random(5)
    make = lambda n: [(rnd.choice([1, 1, 1, 2, None]), i, _minutes(rnd.randrange(600))) for i in range(n)]
    a, b = make(120), [*make(120), (1, 500, None)]
    schema = "user_id long, id long, ts timestamp"
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] and x[0] == y[0] and y[2] and dt.timedelta(0) <= y[2] - x[2] <= dt.timedelta(minutes=7))
    read = lambda d: sorted(tuple(r) for r in d.select("user_id", "first_id", "then_id").collect())
    assert read(timers.within(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 7)) == want and len(want) > 50
    left, right = (_folder(spark, rows, tmp_path / name, schema, 2) for name, rows in (("a", a), ("b", b)))
    q = timers.within(left, right, 7, "1 hour").writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert read(spark.table("pairs")) == want
