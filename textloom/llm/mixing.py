"""Mixing sources to target weights along a time-varying curriculum.

`mix` turns source weights into word targets (water-filling under a repeat cap) and gives each
document the words the mix takes of it. `positions` integrates each source's weight schedule over
training time, and inverts cumulative token demand so that every copy of a document gets the time at
which its first word is due. `training_order` range-sorts the copies by that time. A position is a time in
0..1 of the schedule, on which all sources run side by side; it is not a count of words.

Prefix sums over a source go through 4096 hash buckets: a running sum inside a bucket, and one over
the buckets' totals, so that a source of any size is spread over tasks. Only the table of sources
(one row a source) is ever sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._spark import checkpoint

MAX_REPEATS = 3
#: A source's remainder is filled up by at most FILLS documents, chosen among one a size class (BINS classes an octave).
FILLS, BINS = 5, 8
#: knots (time, rate) of the weight schedule of a source whose weight is the key: early, even, late
SCHEDULES = {1: [(0.0, 1.5), (1.0, 0.5)], 2: [(0.0, 1.0), (1.0, 1.0)], 3: [(0.0, 0.5), (1.0, 1.5)]}


def word_count(c: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _targets(sized: DataFrame) -> DataFrame:
    """source, weight, source_size, target: shares by weight, none above MAX_REPEATS times its size."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = per.select("source", "source_size", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long").alias("weight"))
    per = per.withColumn("cap", F.col("source_size") * MAX_REPEATS).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    rest = F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * rest)
    return per.select("source", "weight", "source_size", target.alias("target"))


def _sized(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, source, size, key, bucket, tie of each row, and what is carried along.

    key and tie come from the row's content, so every pass sees the same order; rows that tie are equal in all columns
    (maps aside, which have no hash). Null ids get a key from the whole row.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().count("map<") and f.dataType.simpleString() != "variant"]
    tie = F.xxhash64(*plain)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), tie.cast("string"))).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"), key.alias("key"), F.substring(key, 1, 3).alias("bucket"), tie.alias("tie"), *carried,
    )


def _placed(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with their place n in their bucket, the words before them and all that is known of their cell."""
    order = Window.partitionBy("__s", "bucket").orderBy("key", "doc_id", "tie")
    named = sized.withColumn("__s", _name(F.col("source")))
    named = named.withColumn("n", F.row_number().over(order)).withColumn("inside", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return named.join(cells, ["__s", "bucket"]).withColumn("before", F.col("ahead") + F.col("inside"))


def _name(source: Column) -> Column:
    """A source as a join key: null and the empty string stay apart."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _extra(size: Column) -> Column:
    """Rows of the prefix that fills a source's remainder: a document that does not fit whole ends it."""
    return (size > 0) & (F.col("full") < MAX_REPEATS) & (F.col("before") + size <= F.col("rest"))


def _cells(sized: DataFrame) -> DataFrame:
    """Per source and bucket: words ahead, the source's target, weight and size, its whole copies, and `picks`.

    The remainder of a target after whole copies is filled by the longest prefix of documents that fits, and the gap
    that is left by up to FILLS more: each is the candidate whose size is nearest to the gap, as long as it makes the gap smaller.
    Candidates are the smallest remaining document of each size class. picks: place in the bucket, words taken before it.
    """
    targets = _targets(sized).withColumn("__s", _name(F.col("source"))).drop("source")
    targets = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    cells = sized.groupBy(_name(F.col("source")).alias("__s"), "bucket").agg(F.sum("size").alias("cell"))
    ahead = Window.partitionBy("__s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("cell").over(ahead), F.lit(0))).drop("cell")
    cells = checkpoint(cells.join(targets, "__s"))
    placed = _placed(sized, cells)
    left = placed.where((F.col("size") > 0) & (F.col("full") < MAX_REPEATS))
    used = F.sum(F.when(_extra(F.col("size")), F.col("size")).otherwise(0)).alias("used")
    size_class = F.floor(F.log("size") * F.lit(BINS / math.log(2)) + F.lit(1e-6)).cast("int")
    some = F.when(~_extra(F.col("size")), F.struct("size", "key", "bucket", "n"))
    best = left.groupBy("__s", size_class.alias("class")).agg(F.min(some).alias("c"), used, F.first("rest").alias("rest"))
    best = best.groupBy("__s").agg(F.collect_list("c").alias("c"), F.sum("used").alias("used"), F.first("rest").alias("rest"))
    kind = "array<struct<size:bigint,key:string,bucket:string,n:int,gap:double>>"

    def fill(acc: Column, _: Column) -> Column:
        free = F.filter("c", lambda c: ~F.exists(acc["out"], lambda o: (o["key"] == c["key"]) & (o["n"] == c["n"])))
        near = F.array_min(F.transform(free, lambda c: F.struct(F.abs(acc["gap"] - c["size"]).alias("d"), c["size"].alias("size"), c["key"].alias("key"), c["bucket"].alias("bucket"), c["n"].alias("n"))))
        take = F.coalesce(near["d"] < acc["gap"], F.lit(False))
        one = F.array(F.struct(near["size"].alias("size"), near["key"].alias("key"), near["bucket"].alias("bucket"), near["n"].alias("n"), acc["gap"].alias("gap")))
        return F.struct(F.when(take, acc["gap"] - near["size"]).otherwise(acc["gap"]).alias("gap"), F.when(take, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct((F.col("rest") - F.col("used")).alias("gap"), F.array().cast(kind).alias("out"))
    picks = best.select("__s", "rest", F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(FILLS)), start, fill)["out"]).alias("x"))
    picks = picks.groupBy("__s", F.col("x.bucket").alias("bucket")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("x.n"), F.col("rest") - F.col("x.gap")))).alias("picks"))
    return cells.join(picks, ["__s", "bucket"], "left")


def _taken(placed: DataFrame) -> DataFrame:
    """Copies of each row, words taken, and the words before its extra copy (`late`)."""
    picked = F.element_at("picks", F.col("n"))
    late = F.when(_extra(F.col("size")), F.col("before").cast("double")).otherwise(picked)
    out = placed.withColumn("late", late).withColumn("copies", F.when(F.col("size") > 0, F.col("full") + F.col("late").isNotNull().cast("long")).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source, weight, size, source_size, target, copies, full, before, late, taken.

    size counts words (null text: 0). Sources by code point, null last, weigh 1, 2, 3, repeating, and
    share all words; a target stops at three times its source's size and the excess is reshared.
    A source is taken floor(target / size) times whole (`full`), then documents are taken once more in md5(doc_id) order
    as long as they fit, and the gap left is filled by single documents of fitting size; documents are never cut. `before` is
    the source's words ahead of the document, `late` those of the remainder ahead of its extra copy (null without one). Every row
    gives one row: repeated ids each count, null ids are placed by their row's hash, ties are rows that are equal throughout.
    Texts without words are taken 0 times. Other columns are ignored; an empty table gives no rows.
    """
    sized = checkpoint(_sized(docs))
    out = _taken(_placed(sized, _cells(sized)))
    return out.select("doc_id", "source", "weight", "size", "source_size", "target", "copies", "full", "before", "late", "taken")


def _segments(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(start, rate at start, slope, demand before) of each linear piece, total demand 1."""
    area = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        out.append((t0, r0 / area, (r1 - r0) / (t1 - t0) / area, done))
        done += (t1 - t0) * (r0 + r1) / 2 / area
    return out


def invert_demand(share: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which a source's cumulative demand reaches this share of its total.

    The schedule is piecewise linear; demand in a piece is a quadratic that is solved in closed form.
    """
    out = None
    for t0, rate, slope, done in reversed(_segments(knots)):
        q = share - F.lit(done)
        at = q / F.lit(rate) if slope == 0 else (F.sqrt(F.lit(rate * rate) + q * F.lit(2 * slope)) - F.lit(rate)) / F.lit(slope)
        at = F.lit(t0) + at
        out = at if out is None else F.when(share >= F.lit(nxt), out).otherwise(at)  # noqa: F821
        nxt = done
    return out


def _time(words_before: Column, total: Column, weight: Column, schedules: dict) -> Column:
    share = F.least(words_before.cast("double") / total, F.lit(1.0))
    out = F.lit(None).cast("double")
    for w, knots in schedules.items():
        out = F.when(weight == w, invert_demand(share, knots)).otherwise(out)
    return out


def _due(copy: Column) -> Column:
    """Words of the source that are taken before this copy of a row: whole copies first, then the remainder."""
    return F.when(copy < F.col("full"), (F.col("before") + copy * F.col("source_size")).cast("double")).otherwise(F.col("full") * F.col("source_size") + F.col("late"))


def positions(mixed: DataFrame, schedules: dict = SCHEDULES) -> DataFrame:
    """mix()'s rows with `position`, the training time in 0..1 of the first copy; null if not taken.

    A source's demand at time t is its target times the integral of its schedule to t; a copy is due when that reaches
    the words taken before it. Weights without a schedule give null.
    """
    total = F.greatest(F.col("target"), F.lit(1.0))
    return mixed.withColumn("position", F.when(F.col("copies") > 0, F.round(_time(_due(F.lit(0)), total, F.col("weight"), schedules), 9)))


def training_order(docs: DataFrame, schedules: dict = SCHEDULES) -> DataFrame:
    """One row for each copy the mix takes: the columns of docs, copy (from 0) and position, range-sorted by position.

    Rows are carried through, so repeated and null ids give their own copies and no more. Equal positions go by doc_id and copy.
    Columns of docs named copy or position (in any case) are replaced. Nulls and texts without words: as in mix().
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "position")]).alias("__row")
    cells = _cells(checkpoint(_sized(docs)))
    out = _taken(_placed(_sized(docs, row), cells)).where("copies > 0")
    total = F.greatest(F.col("target"), F.lit(1.0))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    at = F.round(_time(_due(F.col("__copy")), total, F.col("weight"), schedules), 9)
    return out.select("__row.*", F.col("__copy").alias("copy"), at.alias("position")).orderBy("position", "doc_id", "copy")
