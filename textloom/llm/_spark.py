"""Spark plumbing shared by the operators: table reading, checkpoints, connected components."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with the session's Arrow batches held to this many rows: texts are long, and a batch is held
    several times over in the JVM and in Python. Spark has this setting for a session only; it is lowered, never raised."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialize df in the shared folder of spark.checkpoint.dir and cut its lineage.

    The folder is the session's. One is made only where the setting is absent and driver and executors are one
    process; on a cluster without the setting this raises, as a folder of one machine would lose the rows.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-ckpt-"))
    return df.checkpoint()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) pairs that span the same components as the edges; at most one per node."""
    nodes, inv = np.unique(np.concatenate([src, dst]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(src)
    for a, b in zip(inv[:half].tolist(), inv[half:].tolist()):
        a, b = find(a), find(b)
        if a != b:
            if a > b:
                a, b = b, a
            parent[b] = a
    roots = np.fromiter((find(i) for i in range(len(nodes))), np.int64, len(nodes))
    other = roots != np.arange(len(nodes))
    return nodes[roots[other]], nodes[other]


def local_forest(batches, chunk: int = 1_000_000):
    """mapInArrow body: (a, b) edges of one partition -> spanning forest edges. Memory is bounded by chunk edges."""
    src, dst, held = [], [], 0
    for batch in batches:
        src.append(batch.column(0).to_numpy(zero_copy_only=False))
        dst.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= chunk:
            a, b = _forest(np.concatenate(src), np.concatenate(dst))
            if len(a) > chunk // 2:  # little to contract: pass it on rather than hold it
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                src, dst, held = [], [], 0
            else:
                src, dst, held = [a], [b], len(a)
    if held:
        a, b = _forest(np.concatenate(src), np.concatenate(dst))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def beside_minimum(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges (u, v) with the m of low (u, m): an inner join that deals a node's edges to SALTS tasks, so that no hub meets in one."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return left.join(low.withColumn("salt", salts), ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of long columns (a, b): node, component (the smallest node reachable).

    Alternating large-star and small-star rounds, each a group-by-min and a join, so no
    neighbourhood is gathered in one task and nothing but one count a round reaches the driver. The joins are salted.
    Partitions first replace their edges by a spanning forest. Nodes without an edge to another
    node are absent. Nulls on either side are dropped. Raises if max_rounds do not settle it.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.where(F.col("a") != F.col("b")).mapInArrow(local_forest, "a long, b long")
    e = checkpoint(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("top")).where("top > u").drop("top")
        large = beside_minimum(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = beside_minimum(large, low).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.u", "x.v").where("u != v").distinct()
        nxt = checkpoint(small)
        same = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        before = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        e = nxt
        if tuple(same) == tuple(before):
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
