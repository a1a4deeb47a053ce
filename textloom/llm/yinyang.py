"""Vector code compression: product-quantisation codebooks learned by Yinyang Lloyd in exact integers.

A component x becomes floor(1024 * x); vectors are cut into PARTS equal parts, each with a codebook of up to K entries. A round
assigns every part to its nearest entry (squared distance, ties to the lower index) and moves each entry to the
componentwise floor of the mean of its parts.

Yinyang filtering: a codebook's entries are clustered into groups once. Each vector keeps, for each part, its entry and one
lower bound of the distance to each group's other entries. When entries move, a bound falls by its group's largest drift;
only groups whose bound no longer exceeds the exact distance to the kept entry are scanned, in exact integers, so that ties are
decided by integers and a group is skipped only if nothing in it can tie. Bounds are rounded down, drifts up.

Rows with a null vector, or null or non-finite components, are dropped; all others are returned, those without vec_id and repeated
ones too. Of rows of one vec_id the smallest vector starts the codebook. Vectors shorter than the widest, or of a width
that PARTS does not divide, count as filled up with zeros. Fewer than K ids give a shorter codebook; no rows give no rows. Components so large
that a distance would not fit 62 bits raise.

Scale. A round is one pass over checkpointed rows (entries and bounds beside the integers) and one sum by entry, which tasks
sum up first; only codebooks, PARTS * K entries, pass through the driver and to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import checkpoint

SCALE = 1024
PARTS = 4
K = 256
GROUPS = 16
ROUNDS = 4
SALTS = 16
DOWN, UP, SLACK = 1 - 2.0**-20, 1 + 2.0**-20, 2.0**-10  # more than doubles and single floats lose
IDS = "vec_id long, label {label}"


def _integers(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """vec_id, label and the vector as int64, filled up to width."""
    most = int((2**62 / (4 * max(width, 1))) ** 0.5)
    for batch in batches:
        out = []
        for v in batch.column("v").to_pylist():
            x = np.zeros(width, np.int64)
            y = np.floor(np.array(v, np.float64) * SCALE)
            if len(y) and np.abs(y).max() > most:
                raise ValueError(f"a component is beyond {most / SCALE:g}, too large for exact distances")
            x[: len(y)] = y
            out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "ints"])


def group_entries(book: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """A group for each entry, by a few rounds of k-means over the codebook; groups may stay empty."""
    n = len(book)
    groups = max(1, min(groups, n))
    centres = book[np.linspace(0, n - 1, groups).astype(int)].astype(np.float64)
    for _ in range(rounds):
        home = ((book[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (home == g).any():
                centres[g] = book[home == g].mean(0)
    return home


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of book, as int64."""
    top = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * top * top * max(1, x.shape[1]) < 2**52:  # every product and sum is an integer that a double holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in book], 1)


def assign(
    x: np.ndarray, book: np.ndarray, home: np.ndarray, entry: np.ndarray | None, bounds: np.ndarray | None, drift: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of the rows of x: (entry, bounds, exact squared distance, groups scanned).

    home is each entry's group; entry and bounds are those of the last round (None in the first), drift how far each
    group's entries have moved at most since.
    """
    n, groups = len(x), int(home.max(initial=0)) + 1
    if entry is None:
        entry, bounds = np.zeros(n, np.int64), np.zeros((n, groups), np.float32)
        best = ((x - book[0]) ** 2).sum(1)
        todo = np.ones((n, groups), bool)
    else:
        bounds = np.maximum((bounds - drift[None]) * DOWN, 0).astype(np.float32)
        best = ((x - book[entry]) ** 2).sum(1)
        todo = bounds * DOWN <= np.sqrt(best)[:, None] * UP + SLACK
    was, had = entry.copy(), best.copy()
    second = np.zeros((n, groups), np.float64)  # distance to the nearest entry of a scanned group that is not its first
    first = np.full((n, groups), -1, np.int64)
    nearest = np.zeros((n, groups), np.float64)
    for g in range(groups):
        members, rows = np.flatnonzero(home == g), np.flatnonzero(todo[:, g])
        if not len(members):
            bounds[:, g] = np.inf
            continue
        if not len(rows):
            continue
        d = _squares(x[rows], book[members])
        k = d.argmin(1)  # members ascend, so of ties the lowest index
        low = d[np.arange(len(rows)), k]
        first[rows, g], nearest[rows, g] = members[k], np.sqrt(low)
        d[np.arange(len(rows)), k] = np.iinfo(np.int64).max
        rest = d.min(1)
        second[rows, g] = np.where(rest == np.iinfo(np.int64).max, np.inf, np.sqrt(rest))
        better = (low < best[rows]) | ((low == best[rows]) & (members[k] < entry[rows]))
        best[rows[better]], entry[rows[better]] = low[better], members[k][better]
    for g in range(groups):
        rows = todo[:, g] & (first[:, g] >= 0)
        low = np.where(first[:, g] == entry, second[:, g], nearest[:, g])
        bounds[rows, g] = (low[rows] * DOWN).astype(np.float32)
    left = np.flatnonzero(was != entry)  # the entry that a row has left is one of its group's others now
    g = home[was[left]]
    bounds[left, g] = np.minimum(bounds[left, g], (np.sqrt(had[left]) * DOWN).astype(np.float32))
    return entry, bounds, best, int(todo.sum())


def _assign_rows(batches: Iterable[pa.RecordBatch], books: list, homes: list, drifts: list | None) -> Iterator[pa.RecordBatch]:
    groups = [int(h.max(initial=0)) + 1 for h in homes]
    d = books[0].shape[1]
    for batch in batches:
        n = batch.num_rows
        x = np.frombuffer(b"".join(batch.column("ints").to_pylist()), np.int64).reshape(n, PARTS * d)
        if drifts:
            old = np.frombuffer(b"".join(batch.column("entries").to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
            low = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float32).reshape(n, sum(groups))
        found, kept, error, at = np.zeros((n, PARTS), np.uint8), [], np.zeros(n, np.int64), 0
        for p in range(PARTS):
            mine = (old[:, p], low[:, at : at + groups[p]], drifts[p]) if drifts else (None, None, None)
            at += groups[p]
            entry, bounds, best, _ = assign(x[:, p * d : (p + 1) * d], books[p], homes[p], *mine)
            found[:, p] = entry
            kept.append(bounds)
            error += best
        kept = np.concatenate(kept, 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), batch.column("ints"), pa.array([r.tobytes() for r in found], pa.binary()),
             pa.array([r.tobytes() for r in kept], pa.binary()), pa.array(error)],
            names=["vec_id", "label", "ints", "entries", "bounds", "error"],
        )


def _sums(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """A task's counts and sums of parts by part and entry."""
    count, total = np.zeros((PARTS, K), np.int64), np.zeros((PARTS, K, d), np.int64)
    for batch in batches:
        n = batch.num_rows
        x = np.frombuffer(b"".join(batch.column("ints").to_pylist()), np.int64).reshape(n, PARTS, d)
        e = np.frombuffer(b"".join(batch.column("entries").to_pylist()), np.uint8).reshape(n, PARTS)
        for p in range(PARTS if n else 0):
            count[p] += np.bincount(e[:, p], minlength=K)
            order = np.argsort(e[:, p], kind="stable")
            entry, at = np.unique(e[order, p], return_index=True)
            total[p, entry] += np.add.reduceat(x[order, p], at, axis=0)
    p, e = np.nonzero(count)
    if len(p):
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[p, e].ravel()), d) if d else pa.array([[]] * len(p), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), sums.cast(pa.list_(pa.int64()))], names=["part", "entry", "n", "total"]
        )


def _moved(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks moved to the floors of their parts' means; PARTS * K rows reach the driver."""
    d = books[0].shape[1]
    sums = state.select("ints", "entries").mapInArrow(lambda b: _sums(b, d), "part int, entry int, n long, total array<long>")
    by = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(d)))
    books = [b.copy() for b in books]
    for r in by.collect():
        books[r[0]][r[1]] = [t // r[2] for t in r[3:]]
    return books


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def quantise(df: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, entries as PARTS bytes, error; codebooks) of df (vec_id, embedding, label)."""
    v = df["embedding"].cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(v.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(df["vec_id"].cast("long").alias("vec_id"), df["label"].alias("label"), v.alias("v"))
    ids_schema = IDS.format(label=rows.schema["label"].dataType.simpleString())
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-width // PARTS) * PARTS
    d = width // PARTS
    ints = checkpoint(rows.mapInArrow(lambda b: _integers(b, width), f"{ids_schema}, ints binary"))
    ids = ints.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(K)
    start = ints.join(F.broadcast(ids), "vec_id").select("vec_id", "ints").distinct().mapInArrow(_as_lists, "vec_id long, x array<long>")
    start = start.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    if not start:
        start = [(None, [0] * width)]  # no ids: one entry of zeros, so that rows without vec_id still have a code
    first = np.array([r[1] for r in start], np.int64).reshape(len(start), PARTS, d)
    books = [first[:, p].copy() for p in range(PARTS)]
    homes = [group_entries(b) for b in books]
    state, drifts = ints, None
    for step in range(rounds + 1):
        schema = f"{ids_schema}, ints binary, entries binary, bounds binary, error long"
        state = state.mapInArrow(lambda b, books=books, drifts=drifts: _assign_rows(b, books, homes, drifts), schema)
        if step == rounds:
            break
        state = checkpoint(state)
        moved = _moved(state, books)
        drifts = [_drift(a, b, h) for a, b, h in zip(books, moved, homes)]
        books = moved
    return state.select("vec_id", "label", "entries", "error"), books


def _as_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.frombuffer(b, np.int64).tolist() for b in batch.column("ints").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(x, pa.list_(pa.int64()))], names=["vec_id", "x"])


def _drift(old: np.ndarray, new: np.ndarray, home: np.ndarray) -> np.ndarray:
    """How far the entries of each group have moved at most, rounded up."""
    far = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * UP
    return np.array([far[home == g].max(initial=0) for g in range(int(home.max(initial=0)) + 1)])


def compress(df: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (sum over equal labels, nulls together), codebooks_sha256.

    Errors are summed by label in tasks; the join back is salted, so that a label of a third of all rows is spread.
    """
    state, books = quantise(df, rounds)
    state = checkpoint(state)
    salt = F.pmod(F.xxhash64("vec_id", "entries"), F.lit(SALTS)).cast("int")
    rows = state.select("vec_id", "label", F.lower(F.hex("entries")).alias("code"), "error", salt.alias("salt"))
    sums = state.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
