"""Document translation as joins: segments, memory, engine, rejoin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from textloom.functions import segment
from textloom.operators import memory as tm
from textloom.operators.slices import parts, slices

#: texts of one batch to their translations
Engine = Callable[[list[str]], list[str]]


def same(texts: list[str]) -> list[str]:
    """An engine that leaves texts as they are."""
    return texts


def pieces(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a segment of docs (doc_id, text): doc_id, pos, text, label, kind."""
    return docs.select("doc_id", F.inline(segment.segments(F.col("text"), keep)))


def _turns(got: list[tuple[str, str, str]], wanted: set[str]) -> tuple[list[tuple[str, str, str]], str, int]:
    """Pieces of a text as turns (what stands before, piece to be translated, its blanks behind), what stands after the last, and the number of pieces."""
    out, held = [], []
    for t, label, _ in got:
        if label in wanted:
            source = t.strip(" ")
            begin = t.index(source)
            out.append(("".join([*held, t[:begin]]), source, t[begin + len(source) :]))
            held = []
        else:
            held.append(t)
    return out, "".join(held), len(got)


def _sources(docs: DataFrame, target: str, keep: tuple[str, ...]) -> DataFrame:
    """source: distinct pieces to be translated, without blanks at their ends."""
    wanted = set(segment.WANTED[target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column(0), segment.SLICE_BYTES):
                found = dict.fromkeys(source for t in part.to_pylist() for _, source, _ in _turns(segment.segment(t, keep), wanted)[0])
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["source"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "source string").distinct()


def _cut(docs: DataFrame, target: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, own, pos, lead, source, tail, todo, n: a row for each piece to be translated, with all text before it, the last one's also with what comes after; n counts
    a text's pieces, on one of its rows. A text without such pieces is one row of lead; its source is its id, so that a join deals such rows out,
    and its own a number of its own, else 0, so that rows of one id without such pieces stay apart."""
    wanted = set(segment.WANTED[target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1, segment.SLICE_BYTES):
                rows = []
                for i, t in enumerate(part.column(1).to_pylist()):
                    turns, rest, n = _turns(segment.segment(t, keep), wanted)
                    if turns:
                        rows += [(i, 0, k, *turn, True, 0) for k, turn in enumerate(turns[:-1])]
                        lead, source, tail = turns[-1]
                        rows.append((i, 0, len(turns) - 1, lead, source, tail + rest, True, n))
                    else:
                        number += 1
                        rows.append((i, number, 0, rest, str(part.column(0)[i]), "", False, n))
                at, *columns = zip(*rows)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
                arrays = [part.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "own", "pos", "lead", "source", "tail", "todo", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, own long, pos long, lead string, source string, tail string, todo boolean, n long")


def translate(docs: DataFrame, target: str, memory: DataFrame | None = None, engine: Engine = same, glossary: list[tuple[str, str]] | None = None, keep: tuple[str, ...] = (), floor: float | None = 0.9) -> DataFrame:
    """docs (doc_id, text) as doc_id, text, segments, translated, from_memory.

    A segment in the other language is looked up in memory (source_text, direction, target_text), first as it is, then among
    texts of the direction that are similar from floor up (None: not); what is still missing
    goes through the engine once per distinct text, with glossary terms replaced before and after. All
    other segments, and the order, stay. A document without such segments comes back as it was; null is
    empty. A text is cut once for the distinct segments and once for its own; what stays travels with the segment behind it. Memory must hold one row for a text and direction.
    """
    words = _sources(docs, target, keep).withColumn("direction", F.lit(f"to_{target}"))
    if memory is not None:
        found = tm.exact_lookup(words, memory)
    else:
        found = words.withColumn("target_text", F.lit(None).cast("string"))

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(engine(list(texts)))

    fix = lambda c: tm.override_terms(c, glossary)[0] if glossary else c
    missed = found.where(F.col("target_text").isNull()).select("source")
    if memory is not None and floor is not None:
        own = memory.where(F.col("direction") == f"to_{target}").select(F.xxhash64("source_text").alias("mem_id"), F.col("source_text").alias("text"), "target_text")
        near = tm.fuzzy_lookup(missed.select(F.xxhash64("source").alias("id"), "source"), own.select("mem_id", "text"), floor).join(own.select("mem_id", "target_text"), "mem_id")
        missed = missed.withColumn("id", F.xxhash64("source")).join(near.select("id", F.col("target_text").alias("near")), "id", "left").select("source", "near")
    else:
        missed = missed.withColumn("near", F.lit(None).cast("string"))
    made = missed.where("near is null").select("source", fix(run(fix(F.col("source")))).alias("target_text"), F.lit(False).alias("hit"))
    missed = made.unionByName(missed.where("near is not null").select("source", F.col("near").alias("target_text"), F.lit(True).alias("hit")))
    known = found.where(F.col("target_text").isNotNull()).select("source", "target_text", F.lit(True).alias("hit")).unionByName(missed)
    known = known.select(F.col("source").alias("asked"), "target_text", "hit")
    rows = _cut(docs, target, keep).join(known, F.col("todo") & (F.col("source") == F.col("asked")), "left")
    text = F.when(F.col("todo"), F.concat("lead", F.coalesce("target_text", "source"), "tail")).otherwise(F.col("lead"))
    return rows.groupBy("doc_id", "own").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))), lambda s: s["text"]), "").alias("text"),
        F.sum("n").alias("segments"), F.count_if("todo").alias("translated"), F.count_if(F.coalesce("hit", F.lit(False))).alias("from_memory"),
    ).drop("own")
