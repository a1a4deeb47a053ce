"""Gap sessionisation: Spark hashes clients into Arrow groups, and in each an embedded DuckDB cuts the sessions.

A click is taken once per click_id (of rows that share one, the smallest by client, time and content). Rows without
click_id, client_id or ts are no clicks. A null arrived_at is timely; a value that is null, infinite or not a number
counts 0 and closes nothing; a null kind is no purchase. Late clicks before a client's first session join none.
Clients are ordered streams by (ts, click_id); clicks of one time are parted by click_id.

Scale. A client of less than a BUSY-th of all rows is dealt by its id. The others (at most BUSY of them) are first
cut in time: per client and slice of SLICE_US the first and last timely click are summed up, and a slice edge that a
hard break crosses starts a new group; no session can straddle it. Rows of a task are sorted by group and time and
handed to DuckDB in chunks of CHUNK rows; the last session of a chunk, which may go on, is fed again with the next, so a
task holds a chunk and one session. What stays whole is one session (its path has one digest), and what stays in one
task, as a stream, is a stretch of one client that no slice edge parts at a hard break. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MINUTE_US = 60_000_000
BUSY = 10_000
SLICE_US = 10 * MINUTE_US
CHUNK = 65_536
SCHEMA = (
    "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, "
    "closed_by string, path_sha256 string"
)

SESSIONS = """
WITH ordered AS (
  SELECT *, row_number() OVER w AS i, lag(final) OVER w AS after_final, ts - lag(ts) OVER w AS pause
  FROM clicks WHERE NOT late WINDOW w AS (PARTITION BY client_id, grp ORDER BY ts, click_id)),
hard AS (
  SELECT *, CASE WHEN after_final THEN 'end' WHEN pause >= {gap} THEN 'gap' END AS reason FROM ordered),
stretched AS (
  SELECT *, sum(CASE WHEN i = 1 OR reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY client_id, grp ORDER BY i) AS stretch FROM hard),
long_ones AS (
  SELECT client_id, grp, stretch, min(i) AS first_i, max(i) AS last_i FROM stretched GROUP BY ALL HAVING max(ts) - min(ts) > {length}),
hops AS (
  SELECT s.client_id, s.grp, s.stretch, s.i, last_i, first_i + count(*) OVER (
      PARTITION BY s.client_id, s.grp, s.stretch ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND {length} FOLLOWING) AS next_i
  FROM stretched s JOIN long_ones USING (client_id, grp, stretch)),
cuts AS (
  WITH RECURSIVE cut(client_id, grp, stretch, i) AS (
    SELECT client_id, grp, stretch, first_i FROM long_ones
    UNION ALL
    SELECT c.client_id, c.grp, c.stretch, h.next_i FROM cut c JOIN hops h USING (client_id, grp, stretch, i) WHERE h.next_i <= h.last_i)
  SELECT client_id, grp, i FROM cut),
starts AS (
  SELECT s.*, CASE WHEN s.i = 1 THEN 'first' WHEN s.reason IS NOT NULL THEN s.reason WHEN c.i IS NOT NULL THEN 'length' END AS start
  FROM stretched s LEFT JOIN cuts c USING (client_id, grp, i)),
numbered AS (
  SELECT *, count(start) OVER (PARTITION BY client_id, grp ORDER BY i) AS session FROM starts),
sessions AS (
  SELECT client_id, grp, session, arg_min(click_id, i) AS session_id, min(ts) AS start_us, max(ts) AS end_us, count(*) AS n_clicks,
    CAST(sum(cents) AS BIGINT) AS value_cents, arg_min(start, i) AS start, arg_max(final, i) AS final, any_value(more) AS more,
    sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY i)) AS path_sha256
  FROM numbered GROUP BY client_id, grp, session),
lates AS (
  SELECT s.client_id, s.grp, s.session, count(*) AS n_late
  FROM (SELECT client_id, grp, ts FROM clicks WHERE late) l
  ASOF JOIN (SELECT client_id, grp, start_us, max(session) AS session FROM sessions GROUP BY ALL) s
    ON l.client_id = s.client_id AND l.grp = s.grp AND l.ts >= s.start_us
  GROUP BY ALL)
SELECT client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents,
  coalesce(lead(start) OVER (PARTITION BY client_id, grp ORDER BY session), CASE WHEN final THEN 'end' WHEN more THEN 'gap' ELSE 'none' END) AS closed_by,
  path_sha256, grp, session
FROM sessions LEFT JOIN lates USING (client_id, grp, session)
ORDER BY client_id, grp, session
"""


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, as written for one without a zone, whatever the session's zone is."""
    c = df[name]
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        clock = F.hour(c) * 3600 + F.minute(c) * 60
        return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + clock.cast("long") * 1_000_000 + (
            F.extract(F.lit("SECOND"), c) * 1_000_000
        ).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def clicks_once(df: DataFrame, late_minutes: int = 60, final_value: float = 60.0) -> DataFrame:
    """client_id, ts (microseconds), click_id, late, final, cents: one row per click_id."""
    value = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value").cast("double"))
    rows = df.where("click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL").select(
        df["client_id"].cast("long").alias("client_id"),
        micros(df, "ts").alias("ts"),
        df["click_id"].cast("long").alias("click_id"),
        F.coalesce(micros(df, "arrived_at") - micros(df, "ts") > late_minutes * MINUTE_US, F.lit(False)).alias("late"),
        F.coalesce((df["kind"] == "purchase") & (value >= final_value), F.lit(False)).alias("final"),
        F.coalesce(F.floor(value * 100 + 0.5), F.lit(0)).cast("long").alias("cents"),
    )
    fields = ("client_id", "ts", "late", "final", "cents")
    once = rows.groupBy("click_id").agg(F.min(F.struct(*fields)).alias("c"))
    return once.select("click_id", *(f"c.{f}" for f in fields))


def _groups_in_time(busy: DataFrame, gap_us: int) -> DataFrame:
    """grp and more for the clicks of busy clients: grp is the time of the last slice-edge hard break at or before a
    click (of a late click, of the sessions it can join; null before any), more whether another group follows."""
    sliced = busy.withColumn("slice", F.floor(F.col("ts") / SLICE_US))
    timely = ~F.col("late")
    edges = sliced.groupBy("client_id", "slice").agg(
        F.min(F.when(timely, F.col("ts"))).alias("first"), F.max(F.when(timely, F.struct("ts", "click_id", "final"))).alias("last")
    )
    before = Window.partitionBy("client_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("client_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("client_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("prev", F.last("last", ignorenulls=True).over(before))
    broken = F.col("prev").isNull() | F.col("prev.final") | (F.col("first") - F.col("prev.ts") >= gap_us)
    edges = edges.withColumn("anchor", F.when(F.col("first").isNotNull() & broken, F.col("first")))
    edges = edges.select(
        "client_id", "slice", "anchor",
        F.last("anchor", ignorenulls=True).over(before).alias("earlier"),
        F.last("anchor", ignorenulls=True).over(upto).alias("here"),
        F.last("anchor", ignorenulls=True).over(after).isNotNull().alias("follows"),
    )
    early = F.col("late") & (F.col("ts") < F.col("anchor"))
    return sliced.join(edges, ["client_id", "slice"]).select(
        *busy.columns,
        F.when(early, F.col("earlier")).otherwise(F.col("here")).alias("grp"),
        (F.coalesce(early, F.lit(False)) | F.col("follows")).alias("more"),
    )


def _cut(con, rows: pa.Table, query: str) -> pa.Table:
    con.register("clicks", rows)
    try:
        return con.sql(query).to_arrow_table()
    finally:
        con.unregister("clicks")


def _sessions(batches: Iterator[pa.RecordBatch], query: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """Sessions of rows sorted by client_id, grp, ts, click_id, a chunk at a time."""
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})  # what it holds is bounded, and no local folder is used
    held: list[pa.RecordBatch] = []
    n = 0

    def run(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        rows = pa.Table.from_batches(held).combine_chunks()
        out = _cut(con, rows, query)
        held, n = [], 0
        if not last:  # the last session of the last group may go on
            client, grp = rows["client_id"][-1].as_py(), rows["grp"][-1].as_py()
            if out.num_rows and (out["client_id"][-1].as_py(), out["grp"][-1].as_py()) == (client, grp):
                start = out["start_us"][-1].as_py(), out["session_id"][-1].as_py()
                at = next(i for i in range(rows.num_rows - 1, -1, -1) if rows["click_id"][i].as_py() == start[1])
                while at and rows["late"][at - 1].as_py() and (rows["client_id"][at - 1].as_py(), rows["grp"][at - 1].as_py(), rows["ts"][at - 1].as_py()) == (client, grp, start[0]):
                    at -= 1  # late clicks of the very time at which the session starts are its own
                out, rest = out.slice(0, out.num_rows - 1), rows.slice(at)
                held, n = rest.to_batches(), rest.num_rows
        yield from out.drop_columns(["grp", "session"]).cast(_arrow()).to_batches()

    limit = chunk
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            yield from run(False)
            limit = max(chunk, 2 * n)  # a session longer than a chunk: look again when there is twice as much
    if held:
        yield from run(True)
    con.close()


def _arrow() -> pa.Schema:
    text = {"closed_by", "path_sha256"}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.schema([(x, pa.string() if x in text else pa.int64()) for x in names])


def sessionise(
    df: DataFrame, gap_minutes: int = 30, length_minutes: int = 120, late_minutes: int = 60, final_value: float = 60.0,
    busy: int = BUSY, chunk: int = CHUNK,
) -> DataFrame:
    """One row per session of clicks (click_id, ts, arrived_at, client_id, kind, value); see the module for every edge case.

    A client's timely clicks go on with a session unless the previous one is final (`end`), is gap_minutes or more
    earlier (`gap`), or the session's first is over length_minutes earlier (`length`).
    """
    clicks = clicks_once(df, late_minutes, final_value)
    owner = df["client_id"].cast("long").alias("client_id")
    often = df.where("client_id IS NOT NULL").groupBy(owner).count().where(F.col("count") > df.count() / busy)
    often = F.broadcast(often.select("client_id", F.lit(True).alias("often")))  # fewer than busy rows, as counts add up to all
    marked = clicks.join(often, "client_id", "left")
    rows = marked.where("often IS NULL").drop("often").withColumns({"grp": F.lit(0).cast("long"), "more": F.lit(False)})
    cut = _groups_in_time(marked.where("often").drop("often"), gap_minutes * MINUTE_US).where("grp IS NOT NULL")
    rows = rows.unionByName(cut)
    rows = rows.repartition("client_id", "grp").sortWithinPartitions("client_id", "grp", "ts", "click_id")
    query = SESSIONS.format(gap=gap_minutes * MINUTE_US, length=length_minutes * MINUTE_US)
    return rows.mapInArrow(lambda batches: _sessions(batches, query, chunk), SCHEMA)
