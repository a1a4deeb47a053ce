"""chrF++ and BLEU by their published definitions, by sentence and over a corpus."""

from __future__ import annotations

import functools
import math
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from textloom.operators.slices import byte_batches, parts

CHARS, WORDS, BETA = 6, 2, 2.0
ORDERS = 4  # of BLEU
COUNTS = 3 * (CHARS + WORDS) + 2 + 2 * ORDERS  # of a pair, for both
CELLS = 1 << 18  # of a table of n-grams; beyond it they are searched
HELD, SLICE = 16 << 20, 1 << 17  # bytes of pairs whose rows meet by reference, and of texts counted at once


class _Places:
    """n-grams of a reference up to an order as numbers from 1; an n-gram's is found from that of its first n - 1 members and its last one.

    Equal n-grams have equal numbers, and 0 is any that the reference lacks, so that shared counts are exact.
    """

    def __init__(self, ids: np.ndarray, size: int, orders: int):
        self.size, self.length, self.levels, at = size + 1, len(ids), [], ids
        for n in range(1, orders + 1):
            if n > 1:
                at = at[: max(len(ids) - n + 1, 0)] * self.size + ids[n - 1 :]
            keys, at, count = np.unique(at, return_inverse=True, return_counts=True)
            at = at.reshape(-1) + 1
            cells = (self.levels[-1][0].size + 1 if n > 1 else 1) * self.size
            table = None
            if cells <= CELLS:
                table = np.zeros(cells, np.int32)
                table[keys] = np.arange(1, len(keys) + 1)
            self.levels.append((keys, np.concatenate([[0], count]), table))

    def shared(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(n-grams of each row, of the reference, shared with it) for each order.

        ids: the members of rows of these sizes, a 0 after each row, so that no n-gram crosses rows; 0 also where the reference has no such member.
        """
        rows, out = len(sizes), []
        place = np.flatnonzero(ids != 0)  # of n-grams that the reference has
        row, at = np.repeat(np.arange(rows), sizes + 1).take(place), ids.take(place)
        for n, (keys, count, table) in enumerate(self.levels, 1):
            if n > 1:
                at = at * self.size + ids.take(place + (n - 1), mode="clip")
            if table is not None:
                got = table.take(at)
            elif len(keys):
                got = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
                got = np.where(keys[got] == at, got + 1, 0)
            else:
                got = np.zeros(len(at), np.int64)
            at, cells = got.astype(np.int64, copy=False), rows * len(count)
            alive = np.flatnonzero(at)
            if len(alive) < 0.9 * len(at):
                place, at, row = place.take(alive), at.take(alive), row.take(alive)
            spot = row * len(count) + at  # n-gram 0 counts for nothing
            if cells <= 4 * len(spot):
                both = np.minimum(np.bincount(spot, minlength=cells).reshape(rows, -1), count).sum(1)
            else:
                spot, seen = np.unique(spot, return_counts=True)
                both = np.bincount(spot // len(count), np.minimum(seen, count[spot % len(count)]), rows).astype(np.int64)
            out.append((np.maximum(sizes - n + 1, 0), max(self.length - n + 1, 0), both))
        return out


_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])  # the last is none, and stands for all above
_MARK = np.zeros(129, bool)
_MARK[[ord(c) for c in string.punctuation]] = True


def _codes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Texts:
    """Code points of some texts without white space, and the bounds of texts and words among them."""

    def __init__(self, texts: list[str]):
        codes = _codes("\n".join(texts) + "\n")
        solid = ~_SPACE[np.minimum(codes, len(_SPACE) - 1)]
        self.codes = codes[solid]
        before = np.cumsum(solid)
        self.stops = before[np.cumsum([len(t) + 1 for t in texts]) - 1]
        self.sizes = np.diff(self.stops, prepend=0)
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        self.words = before[edges[solid[edges]]] - 1  # where one begins
        if len(codes) and solid[0]:
            self.words = np.append(0, self.words)

    def tokens(self) -> np.ndarray:
        """Where words with one punctuation mark at an end split off begin."""
        start, end = self.words, np.append(self.words, len(self.codes))[1:]
        mark = lambda at: _MARK[np.minimum(self.codes[at], 128)]
        last = mark(end - 1)
        cut = np.where(last, end - 1, start + 1)[(end - start > 1) & (last | mark(start))]
        return np.sort(np.append(start, cut))

    def pieces(self, start: np.ndarray) -> pa.Array:
        """What begins at these places, as bytes."""
        offsets = np.append(start, len(self.codes)) * 4
        return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.codes)])


class _Names:
    """The distinct words of a text as numbers from 1."""

    def __init__(self, words: pa.Array):
        got = words.dictionary_encode()
        self.words, self.own = got.dictionary, got.indices.to_numpy().astype(np.int64) + 1

    def ids(self, words: pa.Array) -> np.ndarray:
        """The number of each of these words, 0 where it is none."""
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64) + 1


def _apart(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of rows of these sizes with a 0 after each row."""
    out = np.zeros(len(ids) + len(sizes), np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out


@functools.lru_cache(4)  # rows come sorted by reference
def _reference(ref: str) -> tuple:
    """Of a reference: its distinct characters, and places of characters, of tokens, and of words."""
    text = _Texts([ref])
    letters, ids = np.unique(text.codes, return_inverse=True)
    chars = _Places(ids.reshape(-1).astype(np.int64) + 1, len(letters), CHARS)
    tokens, words = _Names(text.pieces(text.tokens())), _Names(text.pieces(text.words))
    return letters, chars, tokens, _Places(tokens.own, len(tokens.words), WORDS), words, _Places(words.own, len(words.words), ORDERS)


def _letter_ids(letters: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The number of each character, 0 where it is none of these."""
    if not len(letters):
        return np.zeros(len(codes), np.int64)
    table = np.zeros(int(letters[-1]) + 2, np.int64)
    table[letters] = np.arange(1, len(letters) + 1)
    return table[np.minimum(codes, len(table) - 1)]


def _shared(texts: _Texts, names: _Names, places: _Places, start: np.ndarray) -> list:
    """Those of the words that begin at these places, text by text."""
    sizes = np.diff(np.searchsorted(start, texts.stops), prepend=0)
    return places.shared(_apart(names.ids(texts.pieces(start)), sizes), sizes)


def _chrf_rows(ref: str, texts: _Texts) -> np.ndarray:
    """For each text the (n-grams of it, of ref, shared) of each order."""
    letters, chars, tokens, pairs, *_ = _reference(ref)
    of_chars = chars.shared(_apart(_letter_ids(letters, texts.codes), texts.sizes), texts.sizes)
    out = []
    for x, y, shared in [*of_chars, *_shared(texts, tokens, pairs, texts.tokens())]:
        out += [x if y else np.zeros_like(x), np.full(len(x), y), shared]
    return np.stack(out, 1)


def _bleu_rows(ref: str, texts: _Texts) -> np.ndarray:
    """For each text lengths of it and of ref, then (shared, all) n-grams of it for each order."""
    *_, words, places = _reference(ref)
    got = _shared(texts, words, places, texts.words)
    out = [got[0][0], np.full(len(texts.stops), places.length)]
    for n, _, shared in got:
        out += [shared, n]
    return np.stack(out, 1)


def chrf_counts(hyp: str, ref: str) -> list[int]:
    """(n-grams of hyp, of ref, shared) for each order: characters 1 to 6, then words 1 and 2."""
    return _chrf_rows(ref, _Texts([hyp]))[0].tolist()


def chrf_score(counts) -> float:
    """Mean over the orders that both sides have of F with beta 2, in percent."""
    precision = recall = 0.0
    orders = 0
    for h, r, m in zip(counts[::3], counts[1::3], counts[2::3]):
        if h and r:
            precision, recall, orders = precision + m / h, recall + m / r, orders + 1
    if not orders or not precision + recall:
        return 0.0
    precision, recall = precision / orders, recall / orders
    return 100 * (1 + BETA**2) * precision * recall / (BETA**2 * precision + recall)


@pandas_udf(DoubleType())
def _chrf(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([round(chrf_score(chrf_counts(h, r)), 2) if h and r else 0.0 for h, r in zip(hyp, ref)])


def chrf(hyp: Column, ref: Column) -> Column:
    """Sentence chrF++ in percent, two decimals; 0 where a side is null or empty."""
    return _chrf(hyp, ref)


def drift(original: Column, back: Column, floor: float = 40.0) -> Column:
    """struct(score, drifted): a back translation that scores below floor has drifted."""
    score = chrf(back, original)
    return F.struct(score.alias("score"), (score < floor).alias("drifted"))


def bleu_counts(hyp: str, ref: str) -> list[int]:
    """Lengths of hyp and ref, then (shared, all) n-grams of hyp for orders 1 to 4, over white-space tokens."""
    return _bleu_rows(ref, _Texts([hyp]))[0].tolist()


def bleu_score(counts) -> float:
    """Geometric mean of the four precisions (an order without a match halves 1/n each time) with the brevity penalty, in percent."""
    hyp, ref, logs, halves = counts[0], counts[1], 0.0, 1.0
    for m, n in zip(counts[2::2], counts[3::2]):
        if not n:
            return 0.0
        halves *= 1 if m else 2
        logs += math.log(m / n if m else 1 / (halves * n))
    return 100 * math.exp(logs / 4) * (1.0 if hyp >= ref else math.exp(1 - ref / hyp)) if any(counts[2::2]) else 0.0


@pandas_udf(DoubleType())
def _score_chrf(counts: pd.Series) -> pd.Series:
    return pd.Series([round(chrf_score(list(c)), 2) for c in counts])


@pandas_udf(DoubleType())
def _score_bleu(counts: pd.Series) -> pd.Series:
    return pd.Series([round(bleu_score(list(c)), 2) for c in counts])


def _sums(batches):
    """Rows of groups, hyp, ref: sums of both counts for each group and reference of some batches; a reference is read once for all its rows there."""

    def added(held):
        rows = pa.Table.from_batches(held)
        by = rows.column_names[:-2]
        kinds = rows.append_column("__at", pa.array(np.arange(len(rows)))).group_by([*by, "ref"], use_threads=False).aggregate([("__at", "list")])
        kinds = kinds.sort_by("ref")  # groups of one reference follow one another
        hyps, sums = rows.column("hyp"), []
        for ref, at in zip(kinds.column("ref").to_pylist(), kinds.column("__at_list")):
            total = np.zeros(1 + COUNTS, np.int64)
            for part in parts(pc.fill_null(hyps.take(at.values), "").combine_chunks(), SLICE):
                texts = _Texts(part.to_pylist())
                total[0] += len(part)
                total[1:] += np.concatenate([_chrf_rows(ref or "", texts), _bleu_rows(ref or "", texts)], 1).sum(0)
            sums.append(total)
        n = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * (1 + COUNTS), pa.int32()), pa.array(np.concatenate(sums)))
        return pa.RecordBatch.from_arrays([*[kinds.column(k).combine_chunks() for k in by], n], names=[*by, "n"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= HELD:
            yield added(held)
            held, size = [], 0
    if held:
        yield added(held)


def corpus_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """chrF++ and BLEU of pairs (hyp, ref) for each group: counts of rows are summed, then scored once."""
    by = by or []
    byte_batches(pairs.sparkSession)
    rows = pairs.select(*by, "hyp", "ref")
    rows = rows.mapInArrow(_sums, StructType([*[rows.schema[k] for k in by], StructField("n", ArrayType(LongType()))]))
    got = rows.groupBy(*by).agg(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)).alias(f"__{i}") for i in range(1 + COUNTS)])
    array = lambda a, b: F.array(*[f"__{i}" for i in range(a, b)])
    return got.select(*by, F.col("__0").alias("pairs"), _score_chrf(array(1, 1 + 3 * (CHARS + WORDS))).alias("chrf"), _score_bleu(array(1 + 3 * (CHARS + WORDS), 1 + COUNTS)).alias("bleu"))
