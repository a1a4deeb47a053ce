"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every 3-word shingle of the benchmark items is counted over all documents; a shingle's weight is its
information, log(documents / documents that hold it). In a second pass the items' shingles seed
matches in each document: the hits of one item that stand close together form a window, and a
window whose distinct seeds weigh at least SEED_BITS goes to local alignment of words (match 2,
mismatch -1, gap -1). A lighter window goes there too unless it holds too few of the item's words for the
threshold, so passages copied into any share of the documents are found. The score is the alignment's share of a perfect one.

Items of fewer than N words have no seeds; they match where all their words stand consecutively.

Items are the broadcast side. Their size is checked: beyond SLICE_CHARS they are dealt into
slices, each matched against all documents in turn. Seeds that many items share are expanded for a range of items at a
time, so memory is bounded whatever their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import checkpoint, small_batches
from textloom.llm._text import Words, shingles, words

N = 3
SEED_BITS = 4.0
THRESHOLD = 0.5
SLICE_CHARS = 8 << 20
SPREAD = 2 << 20  # places of seeds in items held at once for a chunk of text


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score of hashes a against b (match 2, mismatch -1, gap -1) and its end in each.

    Of equal scores the first in a, then in b. Rows are vectorized; a gap along a row is a running maximum.
    """
    at = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best, end_a, end_b = 0, 0, 0
    for i, x in enumerate(a):
        up = row - 1
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == x, 2, -1))
        up = np.maximum(up, 0)
        up[0] = 0
        row = np.maximum.accumulate(up + at) - at
        j = int(row.argmax())
        if row[j] > best:
            best, end_a, end_b = int(row[j]), i + 1, j
    return best, end_a, end_b


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """(share of a perfect alignment, first and last + 1 word of text that it covers)."""
    best, end_i, end_t = smith_waterman(item, text)
    if not best:
        return 0.0, 0, 0
    _, _, back = smith_waterman(item[:end_i][::-1], text[:end_t][::-1])
    return best / (2 * len(item)), end_t - back, end_t


class _Items:
    """A slice of the benchmark: word hashes of each item, and its seeds as sorted (hash, item, place)."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.words: list[np.ndarray] = []
        seeds, item, place = [], [], []
        n = 0
        for w in words(pa.array([t for _, t in rows], pa.string())):
            h, first = shingles(w, N)
            for i in range(w.hi - w.lo):
                own = w.hash[w.first[i] : w.first[i + 1]]
                self.words.append(own)
                if len(own) >= N:
                    s = h[first[i] : first[i + 1]]
                    seeds.append(s)
                    item.append(np.full(len(s), n))
                    place.append(np.arange(len(s)))
                n += 1
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.seeds, self.item, self.place = cat(seeds, np.uint64), cat(item, np.int64), cat(place, np.int64)
        order = np.lexsort((self.place, self.item, self.seeds))
        self.seeds, self.item, self.place = self.seeds[order], self.item[order], self.place[order]
        self.uniq, which = np.unique(self.seeds, return_inverse=True)
        self.order = which * max(1, len(self.words)) + self.item  # rises: places of a seed in a range of items are a slice
        self.short = {k: self._whole(k) for k in range(1, N)}
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.sorted = [np.unique(x, return_counts=True) for x in self.words]

    def _whole(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the items of k words, sorted, and their numbers."""
        own = [i for i, x in enumerate(self.words) if len(x) == k]
        if not own:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        line = np.concatenate([self.words[i] for i in own])
        h, _ = shingles(Words(0, len(own), line[:0].view(np.uint8), line, line, line, np.arange(len(own) + 1) * k), k)
        order = np.argsort(h, kind="stable")
        return h[order], np.array(own)[order]

    def most(self, i: int, text: np.ndarray) -> float:
        """Bound on the share of a perfect alignment of item i that text can reach: its words that text holds, anywhere."""
        own, n = self.sorted[i]
        at = np.minimum(np.searchsorted(own, text), len(own) - 1)
        there = np.zeros(len(own), bool)
        there[at[own[at] == text]] = True
        return n[there].sum() / self.size[i]


def _counter(items: _Items):
    def count(batches):
        total = np.zeros(len(items.uniq), np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for w in words(batch.column(0)):
                h, first = shingles(w, N)
                hit = np.minimum(np.searchsorted(items.uniq, h), max(0, len(items.uniq) - 1))
                good = np.flatnonzero(items.uniq[hit] == h) if len(items.uniq) else np.zeros(0, np.int64)
                owner = np.searchsorted(first, good, "right") - 1
                pair = np.unique(owner * len(items.uniq) + hit[good])
                total += np.bincount(pair % max(1, len(items.uniq)), minlength=len(items.uniq))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["seed", "n"])

    return count


def _matcher(items: _Items, weight: np.ndarray, threshold: float):
    def match(batches):
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1)):
                out = _match_chunk(items, weight, w, threshold)
                if out:
                    doc, item, score, n, lo, hi = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.array(doc, np.int64) + w.lo)), pa.array(items.ids[list(item)]), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                        names=["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"],
                    )

    return match


def _match_short(items, w):
    """Places where an item of fewer than N words stands whole: the first of each document and item."""
    out = []
    for k, (own, number) in items.short.items():
        if not len(own):
            continue
        h, first = shingles(w, k)
        lo, hi = np.searchsorted(own, h), np.searchsorted(own, h, "right")
        owner = np.searchsorted(first, np.arange(len(h)), "right") - 1
        seen = set()
        for at in np.flatnonzero((hi > lo) & (np.diff(w.first)[owner] >= k)).tolist():
            d = int(owner[at])
            place = int(at - first[d])
            for i in number[lo[at] : hi[at]].tolist():
                if (d, i) not in seen:
                    seen.add((d, i))
                    out.append((d, i, 1.0, 1, place, place + k))
    return out


def _match_chunk(items, weight, w, threshold):
    out = _match_short(items, w)
    if not len(items.uniq):
        return out
    h, first = shingles(w, N)
    hit = np.minimum(np.searchsorted(items.uniq, h), len(items.uniq) - 1)
    at = np.flatnonzero(items.uniq[hit] == h)
    if not len(at):
        return out
    ranges = [(0, len(items.words))]
    while ranges:
        lo, hi = ranges.pop()
        begin = np.searchsorted(items.order, hit[at] * len(items.words) + lo)
        many = np.searchsorted(items.order, hit[at] * len(items.words) + hi) - begin
        total = int(many.sum())
        if total > SPREAD and hi - lo > 1:
            ranges += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
        elif total:
            out += _match_range(items, weight, w, threshold, first, at, hit[at], begin, many)
    return out


def _match_range(items, weight, w, threshold, first, at, seed, begin, many):
    """Matches of the items in whose places (begin, many) the seeds found at `at` are looked up."""
    doc = np.searchsorted(first, at, "right") - 1
    pos = at - first[doc]
    spot = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc, pos, seed = np.repeat(doc, many), np.repeat(pos, many), np.repeat(seed, many)
    item, begin = items.item[spot], pos - items.place[spot]  # begin: where the item would start
    order = np.lexsort((pos, begin, item, doc))
    doc, item, begin, pos, seed = doc[order], item[order], begin[order], pos[order], seed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > np.maximum(4, items.size[item[1:]] // 2))
    group = np.cumsum(new) - 1
    pair, back = np.unique(group * len(items.uniq) + seed, return_index=True)  # a seed counts once in a window
    bits = np.bincount(group[back], weights=weight[seed[back]], minlength=group[-1] + 1)
    n_seeds = np.bincount(group[back], minlength=group[-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    found: dict[tuple[int, int], tuple] = {}
    for g, light in enumerate((bits < SEED_BITS).tolist()):
        d, i = int(doc[head[g]]), int(item[head[g]])
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        slack = int(items.size[i]) // 2 + 4
        # hits far apart on one drifting chain of windows would make a long one; cut it into item-sized steps
        for s, e in _steps(int(begin[head[g]]), int(begin[tail[g]]), int(items.size[i])):
            a, b = max(lo, lo + s - slack), min(hi, lo + e + int(items.size[i]) + slack)
            if light and items.most(i, w.hash[a:b]) < threshold:
                continue
            score, x, y = align(items.words[i], w.hash[a:b])
            if score >= threshold and score > found.get((d, i), (0,))[0]:
                found[d, i] = (score, int(n_seeds[g]), a - lo + x, a - lo + y)
    return [(d, i, *v) for (d, i), v in sorted(found.items())]


def _steps(first: int, last: int, size: int):
    step = max(1, 4 * size)
    at = first
    while True:
        yield at, min(last, at + step)
        if at + step >= last:
            return
        at += step


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, n_seeds, start_word, end_word of documents that hold an item, whole or edited.

    One row per row of docs and row of items: its best window, the first of equal ones; repeated documents and repeated items
    each get their rows. score, threshold to 1, is the share of a perfect alignment. Items of fewer than N words match
    only whole (score 1, the first place). Null texts and texts without words, on either side, match nothing; rows with
    a null doc_id or item_id are dropped. Texts of any length are matched whole. Other columns are ignored; empty tables give no rows.
    A window is aligned if it shares a seed with the item; an edit that leaves no N consecutive words of it is not found.
    """
    d = small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    b = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = b.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(chars / SLICE_CHARS))
    out = None
    for k in range(slices):
        rows = sorted((r.item_id, r.text) for r in b.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).collect())
        own = _Items(rows)
        counted = d.select("text").mapInArrow(_counter(own), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
        held = {r.seed: r.n for r in counted}
        total = max(1, held.get(-1, 1))
        weight = np.array([math.log2(total / max(1, held.get(i, 1))) if total > 1 else SEED_BITS for i in range(len(own.uniq))])
        part = d.mapInArrow(_matcher(own, weight, threshold), "doc_id long, item_id long, score double, n_seeds long, start_word long, end_word long")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item; columns and rows as given, repeated ones included.

    Rows with a null doc_id have no identity to be found by and stay; so do null and empty texts. Every row of a doc_id goes if one does.
    """
    found = checkpoint(find_contamination(docs, items, threshold).select(F.col("doc_id").alias("__drop")).distinct())
    return docs.join(found, docs["doc_id"] == found["__drop"], "left_anti")
