"""Costly answers given once a distinct content, joined back to every row that holds it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.operators.written import written

#: Contents of at least this share of the rows are common: there are at most as many as its inverse.
COMMON = 10_000
#: Common answers up to this many bytes are sent to the tasks; beyond it they are joined like the rest, on rows spread over SPREAD parts.
SENT_BYTES = 64 << 20
SPREAD = 64


def answer_once(rows: DataFrame, content: str, answer: Callable[[list], list], kind: str, within: tuple[str, ...] = (), name: str = "answer") -> DataFrame:
    """rows with a column `name` of type kind: answer(distinct contents of a batch), called once for each distinct content.

    Contents are told apart by SHA-256 and length, and by the columns `within` (answers once in each document, say); null contents get
    a null answer and are not asked about. Answers are written before they are joined, so that no retry and no later reader of
    the result asks again. Contents that many rows share meet their answers without a shuffle of these rows. A column of that name is replaced.
    """
    own = [c for c in rows.columns if c.lower() != name.lower()]
    digest = F.struct(F.unhex(F.sha2(F.col(content).cast("binary"), 256)).alias("h"), F.octet_length(content).alias("size"), *[F.col(c) for c in within])
    held = rows.select(*own, F.when(F.col(content).isNotNull(), digest).alias("_asked"))
    asked = held.where("_asked IS NOT NULL").groupBy("_asked").agg(F.any_value(content).alias("c"), F.count("*").alias("n"))
    key = asked.schema["_asked"].dataType.simpleString()

    arrow = to_arrow_type(rows.sparkSession.createDataFrame([], f"a {kind}").schema["a"].dataType)

    def run(batches):
        for batch in batches:
            said = pa.array(answer(batch.column("c").to_pylist()), type=arrow)
            yield pa.RecordBatch.from_arrays([batch.column("_asked"), batch.column("n"), said], ["_asked", "n", "a"])

    answers = written(asked.mapInArrow(run, f"_asked {key}, n long, a {kind}"))
    total = answers.agg(F.sum("n").alias("n")).first()["n"] or 0
    common = (F.col("n") > 1) & (F.col("n") * COMMON >= total)
    few = answers.where(common)
    size = few.agg(F.sum(F.length(F.to_json(F.struct("a"))) + 200).alias("b")).first()["b"] or 0
    none = held.where("_asked IS NULL").select(*own, F.lit(None).cast(kind).alias(name))
    if size > SENT_BYTES:
        # a busy content is asked for from SPREAD keys, by a hash of the whole row
        salted = held.where("_asked IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(SPREAD)))
        busy = answers.where(common).select("_asked", F.col("a").alias(name))
        spread = busy.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
        rare = held.where("_asked IS NOT NULL").join(busy.select("_asked"), "_asked", "left_anti").join(answers.where(~common).select("_asked", F.col("a").alias(name)), "_asked")
        often = salted.join(spread, ["_asked", "_salt"])
        return rare.select(*own, name).unionByName(often.select(*own, name)).unionByName(none)
    sent = F.broadcast(few.select("_asked", F.col("a").alias(name)))
    often = held.join(sent, "_asked").select(*own, name)
    rare = held.where("_asked IS NOT NULL").join(F.broadcast(few.select("_asked")), "_asked", "left_anti").join(answers.where(~common).select("_asked", F.col("a").alias(name)), "_asked").select(*own, name)
    return often.unionByName(rare).unionByName(none)
