"""Page layout over word rows (doc, page, text, x0, x1, top): rows, columns, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows(words: DataFrame) -> DataFrame:
    """Words of a page grouped by their top rounded to 5 (half to even), in x order."""
    y = F.bround(F.col("top") / 5) * 5
    return words.withColumn("y", y).groupBy("doc", "y").agg(
        F.count("*").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("line")
    )


def clusters(xs: Column, tolerance: float) -> Column:
    """Starts of 1-d clusters of a sorted array: a new one begins farther than tolerance from the last start."""
    empty = F.array().cast("array<double>")
    return F.aggregate(xs, empty, lambda a, x: F.when((F.size(a) == 0) | (x - F.get(a, F.size(a) - 1) > tolerance), F.concat(a, F.array(x))).otherwise(a))


def nearest_column(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Each word with the index of its nearest column (doc, columns array<double>); the first of equal ones."""
    best = lambda: F.array_min(F.transform("columns", lambda c, i: F.struct(F.abs(F.col("x0") - c).alias("d"), i.alias("i"))))["i"]
    return words.join(columns, "doc").withColumn("col", best().cast("long")).drop("columns")


def gap_tolerance(words: DataFrame) -> DataFrame:
    """Per document the 70th percentile gap between sorted distinct x (over 5), held within 25 to 50; 35 under three gaps."""
    w = Window.partitionBy("doc").orderBy("x0")
    gaps = words.select("doc", "x0").distinct().withColumn("gap", F.col("x0") - F.lag("x0").over(w))
    per = gaps.groupBy("doc").agg(F.array_sort(F.collect_list(F.when(F.col("gap") > 5, F.col("gap")))).alias("g"))
    pick = F.element_at("g", (F.floor(F.size("g") * 0.7) + 1).cast("int"))
    return per.select("doc", F.when(F.size("g") < 3, F.lit(35.0)).otherwise(F.least(F.greatest(pick, F.lit(25.0)), F.lit(50.0))).alias("tolerance"))


def islands(flagged: DataFrame) -> DataFrame:
    """Runs of consecutive places (doc, place, flag) with flag set: doc, first, last, n."""
    w = Window.partitionBy("doc").orderBy("place")
    run = flagged.where("flag").withColumn("g", F.col("place") - F.row_number().over(w))
    return run.groupBy("doc", "g").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n")).drop("g")
