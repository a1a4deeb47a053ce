"""N-gram Jaccard self-join by set-relation skipping.

Three steps, exact sets throughout:

1. One pass hashes every text's k-word shingles. Equal sets (same size and 128-bit fingerprint)
   become one class; only class representatives go on.
2. Classes that collide in one of BANDS signatures of ROWS minima each are put in one cluster. A pair
   at similarity s collides with probability 1 - (1 - s^ROWS)^BANDS: a link is missed with
   chance 6e-11 at 0.85 and 5e-8 at 0.8, so clusters hold all links while most unlike texts part.
3. Inside a cluster the join is exact. Clusters over BLOCK classes are cut by size (a pair whose
   sizes differ by more than the threshold allows is skipped unseen) and then by hash, and pairs of
   blocks are joined as separate groups, so that no group exceeds two blocks. `skip_join` indexes
   each block's sets, skips blocks of the index lists by size and position, and derives a set's answer
   incrementally from that of a highly similar set that was answered before.

Each group returns spanning links only, never all pairs of a group of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import beside_minimum, checkpoint, components, small_batches
from textloom.llm._text import distinct_sets, minima, mix, shingles, sums, words

BANDS, ROWS = 32, 4
BLOCK = 512

_rng = np.random.default_rng(4)
_MUL = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def _signer(k: int):
    def sign(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for w in words(text):
                h, first = shingles(w, k)
                h, first = distinct_sets(h, first)
                short = (h >> np.uint64(32)).astype(np.uint32)
                keys = np.empty((w.hi - w.lo, BANDS), np.uint64)
                for b in range(BANDS):
                    key = np.full(w.hi - w.lo, b + 1, np.uint64)
                    for r in range(b * ROWS, b * ROWS + ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima(short * _MUL[r] + _ADD[r], first, np.uint32(0)))
                    keys[:, b] = key
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(w.lo, w.hi - w.lo),
                        pa.array(n),
                        pa.array(sums(mix(h ^ np.uint64(1)), first).view(np.int64)),
                        pa.array(sums(mix(h ^ np.uint64(2)), first).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(w.hi - w.lo + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return sign


class SkipIndex:
    """Index lists of a block of sets, cut into blocks by size and read by position.

    Sets are numbered by size; an element's position in a set counts the set's rarer elements. The list of
    an element holds (size, position, set) in that order, so its entries of one size are a block that is skipped whole if the
    size cannot link, and read only up to the last position from which the overlap can still be reached.
    A second order of the same lists, by set alone, serves to count overlaps inside a range of sets.
    read and skipped count the entries of the lists that were looked at.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        m = len(sets)
        self.num, self.den = num, den
        self.size = np.array([len(s) for s in sets])
        _, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), self.size)
        rank = np.empty(len(df), np.int64)  # rarest first
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        element = rank[inv]
        by_set = np.lexsort((element, owner))
        owner, element = owner[by_set], element[by_set]
        position = np.arange(len(owner)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        shared = np.sort(df)[element] > 1  # elements of one set only meet no list
        owner, element, position = owner[shared], element[shared], position[shared]
        self.at = np.searchsorted(owner, np.arange(m + 1))
        lists, self.element = np.unique(element, return_inverse=True)
        self.place = position
        self.sizes = np.unique(self.size)
        kind = np.searchsorted(self.sizes, self.size)[owner]
        self.m, self.kinds, self.top = m, len(self.sizes), int(self.size.max()) + 1
        block = (self.element * self.kinds + kind) * self.top + position
        order = np.argsort(block, kind="stable")
        self.block, self.holder = block[order], owner[order]
        self.by_owner = np.sort(self.element * m + owner)
        self.held = np.zeros(len(lists), bool)
        self.read = self.skipped = 0

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def of(self, x: int) -> np.ndarray:
        return self.element[self.at[x] : self.at[x + 1]]

    def candidates(self, x: int, low: int) -> np.ndarray:
        """How often sets low..x-1 stand in the blocks of x's prefix that size and position do not rule out."""
        mine, place = self.of(x), self.place[self.at[x] : self.at[x + 1]]
        first, last = np.searchsorted(self.sizes, [self.size[low], self.size[x] + 1])
        kinds = np.arange(first, last)
        need = self.need(self.size[x], self.sizes[kinds])
        i, k = np.nonzero(place[:, None] <= (self.size[x] - need)[None, :])  # x's own position leaves enough
        if not len(i):
            return np.zeros(self.m, np.int64)
        base = (mine[i] * self.kinds + kinds[k]) * self.top
        begin = np.searchsorted(self.block, base)
        end = np.searchsorted(self.block, base + (self.sizes[kinds] - need)[k] + 1)
        total = int((np.searchsorted(self.block, (mine + 1) * self.kinds * self.top) - np.searchsorted(self.block, mine * self.kinds * self.top)).sum())
        out = np.bincount(self.holder[_spots(begin, end)], minlength=self.m)
        self.read += int((end - begin).sum())
        self.skipped += total - int((end - begin).sum())
        out[:low] = 0
        out[x:] = 0
        return out

    def overlaps(self, elements: np.ndarray, low: int, high: int) -> np.ndarray:
        """How often each of the sets low..high-1 is in these elements' lists; the lists before and after are skipped."""
        begin = np.searchsorted(self.by_owner, elements * self.m + low)
        end = np.searchsorted(self.by_owner, elements * self.m + high)
        return np.bincount(self.by_owner[_spots(begin, end)] % self.m - low, minlength=high - low)

    def difference(self, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        """Shared elements that only x holds, and those that only y holds."""
        a, b = self.of(x), self.of(y)
        self.held[a] = True
        only_b = b[~self.held[b]]
        self.held[a] = False
        self.held[b] = True
        only_a = a[~self.held[a]]
        self.held[b] = False
        return only_a, only_b


def _spots(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The indexes begin[0]..end[0]-1, begin[1]..end[1]-1 and so on."""
    n = end - begin
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def skip_join(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int, stats: dict | None = None) -> list[tuple[int, int]]:
    """Links that span the components of {(i, j): den * |i & j| >= num * |i | j|}.

    sets: sorted distinct hashes, none empty. side: if given, only pairs on different sides are asked for (others
    are answered in other groups); links inside a component found here already are left out.

    Sets are taken by size. A set with a candidate in the index blocks that are not skipped gets an answer: its
    overlaps with all sets in the range of sizes that could link, earlier and later. The closest answered candidate's
    answer gives it incrementally, by adding and subtracting the lists of the elements in which the two differ; without one, or
    if they differ in more elements than the set has, its own lists are counted. stats receives how many entries were
    read and skipped, and how many answers were derived and counted.
    """
    m = len(sets)
    if m < 2:
        return []
    order = np.argsort([len(s) for s in sets], kind="stable")
    side = None if side is None else side[order]
    index = SkipIndex([sets[i] for i in order], num, den)
    size = index.size
    low = np.searchsorted(size, -(-num * size // den))  # first set that is large enough
    high = np.searchsorted(size, den * size // num, "right")  # past the last that is small enough
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    answers: dict[int, np.ndarray] = {}  # over the sets low[x]..high[x]-1
    is_answered = np.zeros(m, bool)
    out: list[tuple[int, int]] = []
    derived = counted = 0
    for x in range(m):
        if low[x] == x:
            continue
        near = index.candidates(x, int(low[x]))
        if not near.any():
            continue
        lo, hi = int(low[x]), int(high[x])
        known = np.where(is_answered, near, 0)
        best = int(known.argmax())
        answer = None
        if known[best]:
            new, gone = index.difference(x, best)
            if len(new) + len(gone) < len(index.of(x)):
                # low and high rise with size, so the answer of a smaller set covers lo..high[best]; the rest is counted
                mid = min(hi, int(high[best]))
                answer = np.concatenate([
                    answers[best][lo - int(low[best]) : mid - int(low[best])] + index.overlaps(new, lo, mid) - index.overlaps(gone, lo, mid),
                    index.overlaps(index.of(x), mid, hi) if mid < hi else np.zeros(0, np.int64),
                ])
                derived += 1
        if answer is None:
            answer = index.overlaps(index.of(x), lo, hi)
            counted += 1
        answers[x], is_answered[x] = answer, True
        y = np.flatnonzero((den + num) * answer[: x - lo] >= num * (size[x] + size[lo:x])) + lo
        if side is not None:
            y = y[side[y] != side[x]]
        for other in y.tolist():
            a, b = find(x), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(order[x]), int(order[other])))
    if stats is not None:
        stats.update(read=index.read, skipped=index.skipped, derived=derived, counted=counted)
    return out


def _joiner(k: int, num: int, den: int):
    def join(tab: pa.Table) -> pa.Table:
        ids = tab.column("rep").to_numpy()
        part = tab.column("part").to_numpy()
        sets: list[np.ndarray] = []
        for chunk in tab.column("text").chunks:
            for w in words(chunk):
                h, first = distinct_sets(*shingles(w, k))
                sets += [h[first[i] : first[i + 1]] for i in range(w.hi - w.lo)]
        pairs = skip_join(sets, part if part.any() else None, num, den)
        a = np.array([ids[i] for i, _ in pairs], np.int64)
        b = np.array([ids[j] for _, j in pairs], np.int64)
        return pa.table({"a": a, "b": b})

    return join


def _clusters(classes: DataFrame) -> DataFrame:
    """rep, cluster of every class that shares a signature with another one."""
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    keyed = keyed.select(F.col("key").alias("u"), F.col("rep").alias("v"))
    low = keyed.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    edges = beside_minimum(keyed, low).where("m != v").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return components(edges).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id long unique, text string).

    Texts link when den * |A & B| >= num * |A | B| over their sets of k-word shingles; component_id is
    the smallest doc_id that links reach. Null and empty texts and texts of white space have an empty
    set and link with nothing; shorter texts than k words have one shingle. Other columns are ignored.
    Rows with a null doc_id are dropped. An empty table gives an empty result.
    """
    base = small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = checkpoint(base.mapInArrow(_signer(k), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"))
    some = signed.where("n_shingles > 0")
    classes = checkpoint(some.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    cluster = checkpoint(_clusters(classes).join(classes.select("rep", "n_shingles"), "rep"))
    # size bucket s holds sizes whose ratio is above the threshold; linked sets are in the same or adjacent buckets
    sized = cluster.withColumn("s", F.floor(F.log(F.col("n_shingles")) / F.lit(float(np.log(den / num)) * 1.000001)).cast("int"))
    whole = sized.groupBy("cluster").agg(F.count("*").alias("all"))
    cell = sized.groupBy("cluster", "s").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("cuts"))
    beside = cell.select("cluster", (F.col("s") - 1).alias("s"), F.col("cuts").alias("above"))
    below = cell.select("cluster", (F.col("s") + 1).alias("s"), F.col("cuts").alias("under"))
    cell = cell.join(beside, ["cluster", "s"], "left").join(below, ["cluster", "s"], "left").join(whole, "cluster")
    placed = sized.join(cell, ["cluster", "s"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    key = lambda s, i, t, j: F.struct(F.col("cluster").alias("cluster"), s.alias("s"), i.alias("i"), t.alias("t"), j.alias("j"))
    zero, one = F.lit(0), F.lit(1)
    upto = lambda n: F.sequence(zero, n - 1)
    group = F.when(
        F.col("all") <= BLOCK, F.array(F.struct(key(zero, zero, zero, zero).alias("g"), zero.alias("part")))
    ).otherwise(
        F.concat(
            F.transform(upto(F.col("cuts")), lambda j: F.struct(key(F.col("s"), F.least("i", j), F.col("s"), F.greatest("i", j)).alias("g"), (F.col("i") > j).cast("int").alias("part"))),
            F.when(F.col("above").isNull(), F.array()).otherwise(F.transform(upto(F.coalesce("above", one)), lambda j: F.struct(key(F.col("s"), F.col("i"), F.col("s") + 1, j).alias("g"), zero.alias("part")))),
            F.when(F.col("under").isNull(), F.array()).otherwise(F.transform(upto(F.coalesce("under", one)), lambda j: F.struct(key(F.col("s") - 1, j, F.col("s"), F.col("i")).alias("g"), one.alias("part")))),
        )
    )
    tasks = placed.select("rep", F.explode(group).alias("x")).select("rep", "x.g", "x.part")
    full = base.withColumnRenamed("doc_id", "rep").join(tasks, "rep")
    links = full.select("g", "rep", "part", "text").groupBy("g").applyInArrow(_joiner(k, num, den), "a long, b long")
    found = components(links).select(F.col("node").alias("rep"), F.col("component"))
    named = classes.drop("bands").join(found, "rep", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    linked = some.drop("bands").join(named, ["n_shingles", "f1", "f2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents of which each component's smallest doc_id stays; columns as given.

    Rows with a null doc_id have no identity to group by and stay.
    """
    found = jaccard_components(docs, k, num, den).where("doc_id != component_id").select(F.col("doc_id").alias("__drop"))
    return docs.join(found, docs["doc_id"] == found["__drop"], "left_anti")
