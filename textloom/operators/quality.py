"""Quality of conversions and translations: calibration of a threshold, accuracy by category, batch totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calibrate(scores: DataFrame, threshold: float = 40.0) -> DataFrame:
    """One row for scores (score, good): the confusion counts of 'bad below threshold', precision, recall, F1 and the scores' spread.

    Rows with a null score or truth are left out; a ratio without a denominator is 0.
    """
    bad = F.col("score") < threshold
    n = lambda c: F.count_if(c)
    got = scores.where("score is not null and good is not null").agg(
        n(bad & ~F.col("good")).alias("true_positives"), n(bad & F.col("good")).alias("false_positives"), n(~bad & F.col("good")).alias("true_negatives"), n(~bad & ~F.col("good")).alias("false_negatives"),
        F.round(F.avg(F.when(F.col("good"), F.col("score"))), 2).alias("good_scores_mean"), F.round(F.avg(F.when(~F.col("good"), F.col("score"))), 2).alias("bad_scores_mean"),
        F.min(F.when(F.col("good"), F.col("score"))).alias("min_good_score"), F.max(F.when(~F.col("good"), F.col("score"))).alias("max_bad_score"),
    )
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    got = got.withColumn("p", share("true_positives", "false_positives")).withColumn("r", share("true_positives", "false_negatives"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return got.select(
        F.lit(float(threshold)).alias("threshold"), "true_positives", "false_positives", "true_negatives", "false_negatives", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"),
        F.round(f1, 4).alias("f1"), "good_scores_mean", "bad_scores_mean", "min_good_score", "max_bad_score",
    )


def accuracy(rows: DataFrame, category: str = "category", ok: str = "ok") -> DataFrame:
    """total, passed and accuracy_pct (one decimal) of each category, and of all in a row with a null category. Null outcomes count as failures."""
    got = rows.select(F.coalesce(F.col(category), F.lit("")).alias("category"), F.coalesce(F.col(ok), F.lit(False)).alias("ok")).rollup("category")
    return got.agg(F.count("*").alias("total"), F.count_if("ok").alias("passed")).withColumn("accuracy_pct", F.round(100 * F.col("passed") / F.col("total"), 1))


def batch_totals(results: DataFrame) -> DataFrame:
    """converted and errors of conversion results (success, markdown): a success without text counts as an error."""
    good = F.coalesce(F.col("success") & (F.col("markdown") != ""), F.lit(False))
    return results.agg(F.count_if(good).alias("converted"), F.count_if(~good).alias("errors"), F.count("*").alias("files"))


def latest(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The n rows of highest order."""
    return df.orderBy(F.desc(order)).limit(n)


def merge_info(*infos: Column) -> Column:
    """Structs merged field by field: a later one's fields win where they are not null."""
    fields: dict[str, list[Column]] = {}
    for info, names in infos:
        for f in names:
            fields.setdefault(f, []).insert(0, info[f])
    return F.struct(*[F.coalesce(*cs).alias(f) for f, cs in fields.items()])


def first_key(m: Column, keys: list[str]) -> Column:
    """The value of the first of these keys that a map holds."""
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])
