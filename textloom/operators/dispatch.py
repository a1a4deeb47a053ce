"""Dispatch of rows to readers by priority: a join of guesses with a registry, then rounds in which failures go to the next reader."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.written import written

#: Contents of one batch to (text, error) each; exactly one of the two is null.
Reader = Callable[[list], list[tuple[str | None, str | None]]]

#: A registry up to this many readers is sent to the tasks.
MAX_READERS = 10_000


def registry(spark: SparkSession, readers: Iterable[tuple[str, float, list[str], list[str]]]) -> DataFrame:
    """Readers (name, priority, extensions, types by prefix) in order of registration: reg, name, priority, extensions, mimes."""
    rows = [(i, name, float(priority), [e.lower() for e in extensions], [m.lower() for m in mimes]) for i, (name, priority, extensions, mimes) in enumerate(readers)]
    return spark.createDataFrame(rows, "reg int, name string, priority double, extensions array<string>, mimes array<string>")


def candidates(guesses: DataFrame, readers: DataFrame, key: str) -> DataFrame:
    """key, readers: for each key the names of the readers that take one of its guesses (key, seq, extension, mimetype), in the order of tries.

    A reader takes a guess of one of its extensions or of a type that begins with one of its types, without case. Order: seq of the
    guess, lower priority, newer registration; a reader stands once, at its best guess. Keys that no reader takes, and null keys, are absent.
    """
    n = readers.count()
    if n > MAX_READERS:
        raise ValueError(f"{n} readers; at most {MAX_READERS} are sent to the tasks")
    takes = F.expr("array_contains(extensions, lower(extension)) OR exists(mimes, m -> startswith(lower(mimetype), m))")
    met = guesses.where(F.col(key).isNotNull()).select(key, "seq", "extension", "mimetype").join(F.broadcast(readers), takes)
    best = met.groupBy(key, "name").agg(F.min(F.struct("seq", "priority", (-F.col("reg")).alias("newer"))).alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", "name")))
    return best.groupBy(key).agg(F.transform(order, lambda x: x["name"]).alias("readers"))


def rounds(rows: DataFrame, order: DataFrame, readers: dict[str, Reader], key: str, content: str = "content") -> DataFrame:
    """key, reader, success, text, tries, errors: each row's content read by the first reader of its order (candidates()) that succeeds.

    Each round tries one reader a row, all rows of a reader in a batch with one call, and is written before the next, so that no
    reader sees a row twice. Contents move once, to meet their order; those that failed are written for the next round. A reader that raises, or
    gives back another number of answers, fails all rows of that call one by one. Rows without a reader, and those that all fail, come back
    with success = false and all errors. Keys must be unique; a null content is read as null.
    """
    schema = rows.select(key, content).schema
    kind = {f.name: f.dataType.simpleString() for f in schema}
    result = f"`{key}` {kind[key]}, `{content}` {kind[content]}, readers array<string>, tries int, errors array<string>, success boolean, text string"

    def one(read: Reader, c) -> tuple[str | None, str | None]:
        try:
            (answer,) = read([c])
            return answer
        except Exception as e:  # a reader's failure passes the row on
            return None, f"{type(e).__name__}: {e}"

    def answers(name: str, contents: list) -> list[tuple[str | None, str | None]]:
        read = readers.get(name)
        if read is None:
            return [(None, "not here")] * len(contents)
        try:
            got = list(read(contents))
            if len(got) == len(contents):
                return got
        except Exception:  # found row by row
            pass
        return [one(read, c) for c in contents]

    def run(batches):
        for batch in batches:
            row = batch.to_pydict()  # values as Spark holds them: a pandas column would make numbers with nulls floats
            tried = [names[t] for names, t in zip(row["readers"], row["tries"])]
            said: list = [None] * len(tried)
            for name in dict.fromkeys(tried):
                at = [i for i, n in enumerate(tried) if n == name]
                for i, answer in zip(at, answers(name, [row[content][i] for i in at])):
                    said[i] = answer
            row["text"], row["success"] = [t for t, _ in said], [e is None for _, e in said]
            row["errors"] = [[*old, *([f"{n}: {e}"] if e is not None else [])] for old, n, (_, e) in zip(row["errors"], tried, said)]
            row[content] = [c if e is not None else None for c, (_, e) in zip(row[content], said)]  # needed no more
            row["tries"] = [t + 1 for t in row["tries"]]
            out = batch.schema.append(pa.field("success", pa.bool_())).append(pa.field("text", pa.string()))
            yield pa.RecordBatch.from_pydict(row, schema=out)

    start = rows.select(key, content).join(order, key, "left")
    start = start.select(key, content, F.coalesce("readers", F.array().cast("array<string>")).alias("readers"), F.lit(0).alias("tries"), F.array().cast("array<string>").alias("errors"))
    final = lambda d: d.select(key, F.when(F.col("success"), F.get("readers", F.col("tries") - 1)).alias("reader"), "success", "text", "tries", "errors")
    more = F.col("tries") < F.size("readers")
    out = final(start.where(~more).select("*", F.lit(False).alias("success"), F.lit(None).cast("string").alias("text")))
    left, empty = start.where(more), False
    while not empty:
        done = written(left.mapInArrow(run, result))
        out = out.unionByName(final(done.where(F.col("success") | ~more)))
        left = done.where(~F.col("success") & more).select(key, content, "readers", "tries", "errors")
        empty = left.isEmpty()
    return out
