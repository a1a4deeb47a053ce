"""Intermediate results that are kept: written once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT_BYTES = 32 << 20  # of a table that each task holds


def written(df: DataFrame) -> DataFrame:
    """df as rows in the folder of spark.checkpoint.dir, without its lineage.

    Where the setting is absent a folder is made only if driver and executors are one process; on a cluster this raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-written-"))
    return df.checkpoint()


def sent(df: DataFrame, size: int | None = None) -> DataFrame:
    """df, for each task to hold where all of it is at most so many bytes (SENT_BYTES)."""
    held = df.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(64)))).first()[0]
    return F.broadcast(df) if (held or 0) <= (SENT_BYTES if size is None else size) else df
