"""Keyed state with event-time timers: runs of events that close when their users fall quiet, and pairs of events within a time.

Rows carry the time at which they arrived besides their own: a row that arrives over `allowed` after its time is late. Late rows
join no run; they come out at once, for a side table. Streams and tables give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

RUN = "user_id long, late boolean, start_us long, last_us long, n long, total double"
EVENT = "event_id long, us long, value double"


def _runs(events: list[tuple], quiet_us: int) -> Iterator[list[tuple]]:
    """Events sorted by time, cut where the one before is at least quiet_us earlier."""
    run: list[tuple] = []
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        if run and e[1] - run[-1][1] >= quiet_us:
            yield run
            run = []
        run.append(e)
    if run:
        yield run


class _Quiet(StatefulProcessor):
    """State of a user: the events of open runs. A run's timer is when no timely event can join it any more."""

    def __init__(self, quiet_us: int, allowed_us: int) -> None:
        self.quiet, self.allowed = quiet_us, allowed_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", EVENT)

    def _closes(self, run: list[tuple]) -> int:
        """Milliseconds at which a run is closed."""
        return (run[-1][1] + self.quiet + self.allowed) // 1000 + 1

    def _wait(self, events: list[tuple]) -> None:
        """One timer, for the run that closes first."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        first = next(_runs(events, self.quiet), None)
        if first:
            self.handle.registerTimer(self._closes(first))

    def handleInputRows(self, key, rows, timerValues):
        events = [tuple(e) for e in self.open.get()]
        seen = {e[0] for e in events}
        new = pd.concat(list(rows)).sort_values(["arrived_us", "us", "value"], kind="stable")
        late = new[new["late"]]
        for e in new[~new["late"]].itertuples():
            if e.event_id not in seen:
                seen.add(e.event_id)
                events.append((int(e.event_id), int(e.us), float(e.value)))
        if events:
            self.open.put(events)
            self._wait(events)
        if len(late):
            yield pd.DataFrame({"user_id": key[0], "late": True, "start_us": late["us"], "last_us": late["us"], "n": 1, "total": late["value"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, done, still = timerValues.getCurrentWatermarkInMs(), [], []
        for run in _runs([tuple(e) for e in self.open.get()], self.quiet):
            if self._closes(run) <= now:
                done.append((key[0], False, run[0][1], run[-1][1], len(run), sum(e[2] for e in run)))
            else:
                still += run
        if still:
            self.open.put(still)
        else:
            self.open.clear()
        self._wait(still)
        if done:
            yield pd.DataFrame(done, columns=["user_id", "late", "start_us", "last_us", "n", "total"])

    def close(self) -> None:
        pass


def micros(d: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a column of times; one without a zone is taken as it is written."""
    c = F.col(name)
    if d.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c)
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def quiet_runs(events: DataFrame, quiet_minutes: int = 30, allowed_minutes: int = 60, disorder: str = "10 minutes") -> DataFrame:
    """user_id, late, start_us, last_us, n, total: runs of timely events (event_id, user_id, ts, arrived_at, value) of a user less than quiet_minutes apart, and each late event.

    Of rows with one event_id the first to arrive counts (then by ts and value); late repeats come out as late rows. A null value is 0; rows without
    event_id, user_id, ts or arrived_at are left out. On a stream, rows may come up to `disorder` out of the order of arrival, and a run comes out once
    nothing timely can join it; state holds the events of open runs. On a table everything is closed at the end.
    """
    quiet, allowed = quiet_minutes * 60_000_000, allowed_minutes * 60_000_000
    rows = events.where("event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL")
    if events.isStreaming:
        rows = rows.withWatermark("arrived_at", disorder)
    us, came = micros(rows, "ts"), micros(rows, "arrived_at")
    rows = rows.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), us.alias("us"), came.alias("arrived_us"),
        (came > us + allowed).alias("late"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), *(["arrived_at"] if events.isStreaming else []),
    )
    if events.isStreaming:
        return rows.groupBy("user_id").transformWithStateInPandas(_Quiet(quiet, allowed), RUN, "append", "EventTime")
    once = rows.where(~F.col("late")).groupBy("event_id", "user_id").agg(F.min(F.struct("arrived_us", "us", "value")).alias("e")).select("event_id", "user_id", "e.us", "e.value")
    # events of one slice of time as long as the pause never part, so runs are cut between the slices' first and last events:
    # what a busy user sends to one task grows with the time covered and not with the events
    slices = once.groupBy("user_id", F.floor(F.col("us") / F.lit(quiet)).alias("slice")).agg(F.min("us").alias("start_us"), F.max("us").alias("last_us"), F.count("*").alias("n"), F.sum("value").alias("total"))
    before = Window.partitionBy("user_id").orderBy("slice")
    cut = slices.withColumn("new", F.coalesce(F.col("start_us") - F.lag("last_us").over(before) >= quiet, F.lit(True)).cast("int"))
    numbered = cut.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = numbered.groupBy("user_id", "run").agg(F.min("start_us").alias("start_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    side = rows.where("late").select("user_id", "late", F.col("us").alias("start_us"), F.col("us").alias("last_us"), F.lit(1).cast("long").alias("n"), F.col("value").alias("total"))
    return runs.select("user_id", F.lit(False).alias("late"), "start_us", "last_us", "n", "total").unionByName(side)


def write_apart(runs: DataFrame, out: str, side: str, checkpoint: str) -> StreamingQuery:
    """A stream of quiet_runs written to two folders, closed runs and late events, one subfolder a batch: a batch that is run again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("NOT late").drop("late").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.where("late").drop("late").write.mode("overwrite").parquet(f"{side}/batch={number}")
        batch.unpersist()

    return runs.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within(first: DataFrame, then: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """user_id, first_id, first_ts, then_id, then_ts: pairs of rows (user_id, id, ts) of a user, the second from 0 to `minutes` after the first.

    A join of two streams or two tables. The key is user and slice of time, so that a busy user is spread over slices; on streams rows
    leave the state when the watermarks of both sides pass them. Null users and times meet nothing.
    """
    width = minutes * 60_000_000
    stream = first.isStreaming
    slot = lambda d, c: F.floor(micros(d, c) / F.lit(width)).cast("long")
    mark = lambda d, c: d.withWatermark(c, late) if stream else d
    own = lambda d, side: d.select("user_id", F.col("id").alias(f"{side}_id"), F.col("ts").alias(f"{side}_ts"))
    a, b = mark(own(first, "first"), "first_ts"), mark(own(then, "then"), "then_ts")
    a = a.withColumn("slot", F.explode(F.array(slot(a, "first_ts"), slot(a, "first_ts") + 1)))
    b = b.withColumn("slot", slot(b, "then_ts"))
    gap: Column = (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    b = b.withColumnsRenamed({"user_id": "other", "slot": "other_slot"})
    return a.join(b, (F.col("user_id") == F.col("other")) & (F.col("slot") == F.col("other_slot")) & gap).select("user_id", "first_id", "first_ts", "then_id", "then_ts")
