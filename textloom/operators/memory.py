"""Translation memory and glossary as joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; order must be total for a stable result."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exact_lookup(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """queries (id, source, direction) left-joined with memory (source_text, direction, target_text).

    A memory with several rows for a text and direction gives a query several rows; upsert() leaves one.
    """
    m = memory.select(F.col("source_text").alias("__s"), F.col("direction").alias("__d"), "target_text")
    return queries.join(m, (F.trim(queries["source"]) == m["__s"]) & (queries["direction"] == m["__d"]), "left").drop("__s", "__d")


GRAM = 4


def _edits(n: Column, floor: float) -> Column:
    """Edits that a text of n characters and one at least floor similar can differ by; the longer has n / floor characters at most."""
    return F.floor((1 - floor) * F.floor(n / floor + 1e-6) + 1e-6).cast("int")


def _grams(c: Column) -> Column:
    """Distinct runs of GRAM characters; a shorter text is one itself."""
    n = F.length(c) - (GRAM - 1)
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(GRAM)))).otherwise(F.array(c)))


def fuzzy_lookup(queries: DataFrame, memory: DataFrame, floor: float = 0.9) -> DataFrame:
    """Best match of each query (id, source) in memory (mem_id, text) by normalized edit distance from floor up: id, mem_id, similarity.

    An edit takes at most GRAM distinct runs of GRAM characters from a text, so of two texts within k edits each misses
    at most k * GRAM of the other's: in the order of rarity in memory they share one of their first k * GRAM + 1. Candidates come
    from an equi-join on those, and only they are compared. Two texts that have no more runs than that (a few signs repeated) meet by length.
    Equal texts are compared once. Ties go to the smallest mem_id; null and empty texts match nothing.
    """
    m = memory.where("text != ''").groupBy(F.col("text").alias("t")).agg(F.min("mem_id").alias("mem_id"))
    q = queries.where("source != ''").select(F.col("source").alias("t")).distinct()
    size = F.floor(F.log(F.length("t")) / F.lit(-math.log(floor)) + 1e-9)  # texts that similar are in the same length class or in neighbouring ones
    near = m.select(F.explode(F.array(size - 1, size, size + 1)).alias("size")).distinct()
    q = q.withColumn("size", size).join(near, "size", "left_semi").drop("size")
    runs = lambda df: df.withColumn("k", _edits(F.length("t"), floor) * GRAM).withColumn("g", _grams(F.col("t")))
    m, q = runs(m), runs(q)
    often = m.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def keys(df: DataFrame, around: tuple[int, ...], *more: str) -> DataFrame:
        """Rows by their rarest runs; those of few runs by length class as well (around: classes beside their own)."""
        rare = df.select("t", "k", *more, F.explode("g").alias("gram")).join(often, "gram", "left")
        first = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), F.lit(1), F.first("k") + 1)
        rare = rare.groupBy("t", *more).agg(first.alias("p")).select("t", *more, F.explode("p").alias("x")).where("x.n > 0").select("t", *more, F.concat(F.lit("g"), F.col("x.gram")).alias("key"))
        few = df.where(F.size("g") <= F.col("k")).select("t", *more, F.explode(F.array(*[F.concat(F.lit("l"), (size + i).cast("string")) for i in around])).alias("key"))
        return rare.unionByName(few)

    pairs = keys(q, (-1, 0, 1)).join(keys(m, (0,), "mem_id").withColumnRenamed("t", "m"), "key")
    longer = F.greatest(F.length("t"), F.length("m"))
    pairs = pairs.where(F.abs(F.length("t") - F.length("m")) <= (1 - floor) * longer + 1e-6).select("t", "mem_id", "m").distinct()
    pairs = pairs.withColumn("similarity", 1 - F.levenshtein("t", "m") / longer).where(F.col("similarity") >= floor - 1e-12)
    best = pairs.groupBy("t").agg(F.max_by(F.struct("mem_id", "similarity"), F.struct("similarity", -F.col("mem_id"))).alias("b"))
    return queries.join(best, queries["source"] == best["t"]).select("id", "b.mem_id", F.bround("b.similarity", 3).alias("similarity"))


def override_terms(text: Column, terms: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(text, count) after replacing whole-word terms, longest first, in one fold each; case is ignored."""
    out, n = text, F.lit(0)
    for term, target in sorted(terms, key=lambda t: -len(t[0])):
        rx = "(?i)(?<![A-Za-z0-9_])" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in term) + "(?![A-Za-z0-9_])"
        n = n + F.regexp_count(out, F.lit(rx))
        out = F.regexp_replace(out, rx, target.replace("\\", "\\\\").replace("$", "\\$"))
    return out, n.cast("long")
