"""Queries over runs of events, dispatch to readers and answers given once; catalogue.py registers them."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import dispatch, once
from textloom.plans._registry import query, table
from textloom.streaming import timers

_ARRIVED = "ts + (event_id % 90) * INTERVAL 1 MINUTE"


@query(
    f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us({_ARRIVED}) > epoch_us(ts) + 3600000000 AS late, coalesce(value, 0) AS value FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL),
    c AS (SELECT *, CASE WHEN us - lag(us) OVER w < 1800000000 THEN 0 ELSE 1 END AS new FROM e WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT user_id, false AS late, min(us) AS start_us, max(us) AS last_us, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM r GROUP BY user_id, run
    UNION ALL SELECT user_id, true, us, us, 1, CAST(round(value * 100) AS BIGINT) FROM e WHERE late"""
)
def quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events that arrive up to 89 minutes after their time, and the late ones."""
    runs = timers.quiet_runs(table(spark, sf_dir, "events").withColumn("arrived_at", F.expr(_ARRIVED)))
    return runs.select("user_id", "late", "start_us", "last_us", "n", F.round(F.col("total") * 100).cast("long").alias("cents"))


@query(
    """SELECT b.event_id, count(*) AS n, min(epoch_us(b.ts) - epoch_us(a.ts)) AS nearest_us FROM events a JOIN events b
    ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR GROUP BY b.event_id"""
)
def views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of the same user in the 12 hours before each purchase: how many, and how long before is the nearest."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", "event_type")
    pairs = timers.within(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), 12 * 60)
    return pairs.groupBy(F.col("then_id").alias("event_id")).agg(F.count("*").alias("n"), F.min(timers.micros(pairs, "then_ts") - timers.micros(pairs, "first_ts")).alias("nearest_us"))


# Made-up readers: name, priority, extensions, types by prefix.
_READERS = [(f"r{i}", float(i % 3), [f".x{i}", f".x{(i * 7) % 20}"], [f"kind/{i % 5}"] if i % 4 == 0 else []) for i in range(20)]
# A reader fails on every page whose id plus its number is divisible by three.
_READERS_SQL = ", ".join(f"({i}, 'r{i}', {float(i % 3)}, ['.x{i}', '.x{(i * 7) % 20}'], {[f'kind/{i % 5}'] if i % 4 == 0 else '[]::VARCHAR[]'})" for i in range(20))


@query(
    f"""WITH g AS (SELECT page_id, 0 AS seq, '.x' || (page_id % 20) AS extension, NULL AS mimetype FROM pages UNION ALL SELECT page_id, 1, NULL, 'kind/' || (page_id % 7) || '; q=1' FROM pages),
    r AS (SELECT * FROM (VALUES {_READERS_SQL}) t(reg, name, priority, extensions, mimes)),
    c AS (SELECT page_id, reg, name, min(struct_pack(seq := seq, priority := priority, late := -reg)) AS best FROM g JOIN r ON list_contains(extensions, extension) OR len(list_filter(mimes, lambda m: starts_with(mimetype, m))) > 0 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY best) AS rank, (page_id + reg) % 3 > 0 AS ok FROM c),
    w AS (SELECT page_id, min(rank) FILTER (ok) AS won, count(*) AS n FROM k GROUP BY page_id),
    l AS (SELECT page_id, name AS reader, won IS NOT NULL AS success, CASE WHEN won IS NULL THEN n ELSE won END AS tries, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS at FROM w JOIN k USING (page_id) WHERE won IS NULL OR rank = won)
    SELECT p.page_id, CASE WHEN l.success THEN l.reader END AS reader, coalesce(l.success, false) AS success, coalesce(l.tries, 0) AS tries, CASE WHEN l.success THEN md5(l.reader || ':' || coalesce(p.html, '')) END AS digest
    FROM pages p LEFT JOIN l ON p.page_id = l.page_id AND l.at = 1"""
)
def reader_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through twenty made-up readers in order of guess, priority and registration; a third of the tries fails and goes to the next reader."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    guess = F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.concat(F.lit(".x"), F.col("page_id") % 20).alias("extension"), F.lit(None).cast("string").alias("mimetype")),
        F.struct(F.lit(1).alias("seq"), F.lit(None).cast("string").alias("extension"), F.concat(F.lit("kind/"), F.col("page_id") % 7, F.lit("; q=1")).alias("mimetype")),
    ))
    order = dispatch.candidates(pages.select("page_id", guess.alias("g")).select("page_id", "g.*"), dispatch.registry(spark, _READERS), "page_id")

    def reader(i: int, name: str):
        def read(contents: list[str]) -> list[tuple[str | None, str | None]]:
            ids = (int(c.partition(":")[0]) for c in contents)
            return [(hashlib.md5(f"{name}:{c.partition(':')[2]}".encode()).hexdigest(), None) if (p + i) % 3 else (None, "broken") for p, c in zip(ids, contents)]

        return read

    rows = pages.select("page_id", F.concat("page_id", F.lit(":"), "html").alias("content"))
    done = dispatch.rounds(rows, order, {name: reader(i, name) for i, (name, *_) in enumerate(_READERS)}, "page_id")
    return done.select("page_id", "reader", "success", F.col("tries").cast("long").alias("tries"), F.col("text").alias("digest"))


@query(
    """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS s FROM documents), w AS (SELECT doc_id, s, len(regexp_extract_all(s, '[A-Za-z]+')) AS n FROM l WHERE s <> '')
    SELECT doc_id, count(*) AS lines, count(DISTINCT s) AS asked, CAST(sum(n) AS BIGINT) AS words, CAST(sum(length(s)) AS BIGINT) AS chars FROM w GROUP BY doc_id"""
)
def lines_answered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, each distinct one counted by a Python call once and the answer joined back to all its places."""
    line = F.explode(F.split("text", "\n", -1)).alias("s")
    lines = table(spark, sf_dir, "documents").select("doc_id", line).select("doc_id", F.trim("s").alias("s")).where("s != ''")
    # what is counted later goes along instead of the lines themselves
    lines = lines.withColumns({"h": F.unhex(F.sha2("s", 256)), "size": F.length("s")})
    answered = once.answer_once(lines, "s", lambda texts: [len(re.findall("[A-Za-z]+", t)) for t in texts], "long")
    return answered.groupBy("doc_id").agg(F.count("*").alias("lines"), F.countDistinct("h").alias("asked"), F.sum("answer").alias("words"), F.sum("size").cast("long").alias("chars"))
