"""Nearest words of a vocabulary by matching-block ratio, and spelling reports made from them.

The ratio of two words of a and b letters is 2m / (a + b), m the letters in their matching blocks. Two bounds hold for m. Blocks
have no more of a letter than both words, so m is at most the common letters. And m letters in j blocks share m - j pairs of
neighbours, while each of the j - 1 gaps costs one of the a + b - 2m letters left over: with p common pairs, 3m is at most p + 1 + a + b.
A word is a row of zeros and ones over (letter, occurrence) and (pair, occurrence), pairs hashed, which only raises p; matrix
products of a block of words with the vocabulary give both bounds for all of it. What they leave gets a third: the blocks are a
common subsequence, so m is at most the longest one, found for all these words at once. Pairs of words are compared best bound first, until no bound left reaches the cutoff or the k-th ratio found.

The vocabulary is counted before it is collected and sent: more than MAX_WORDS distinct words raise. Words of the corpus are made
distinct first, so each is looked up once however often it stands there; nothing else is shuffled.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import places, script
from textloom.operators.written import sent, written

MAX_WORDS = 500_000
BLOCK = 128  # words looked up at once
SLICE = 20_000  # of the vocabulary compared at once: a product has BLOCK * SLICE cells
BITS = 64
BUCKETS, TIMES = 256, 2  # of pairs of neighbours; a pair that stands more often counts as common as often as it does
NEAREST = "word string, match string, ratio double, rank long"


class Vocabulary:
    """Distinct words ready for bounds."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        self.columns: dict[tuple[str, int], int] = {}
        for w in self.words:
            for c, n in Counter(w).items():
                for k in range(n):
                    self.columns.setdefault((c, k), len(self.columns))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self._slices: list[tuple] = []
        self.number = {c: i for i, c in enumerate(sorted({c for c, _ in self.columns}), 1)}
        self._grid: np.ndarray | None = None

    def _rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters, pairs, pairs beyond TIMES) of words."""
        letters, pairs = np.zeros((len(words), len(self.columns)), np.uint8), np.zeros((len(words), BUCKETS * TIMES), np.uint8)
        beyond = np.zeros(len(words), np.float32)
        for i, w in enumerate(words):
            for c, n in Counter(w).items():
                for k in range(n):
                    j = self.columns.get((c, k))
                    if j is None:
                        break
                    letters[i, j] = 1
            for h, n in Counter((31 * ord(x) + ord(y)) % BUCKETS for x, y in zip(w, w[1:])).items():
                pairs[i, h * TIMES : h * TIMES + min(n, TIMES)] = 1
                beyond[i] += max(0, n - TIMES)
        return letters, pairs, beyond

    def bounds(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(first vocabulary word, upper bounds of the ratios of words with a slice of the vocabulary)."""
        if not self._slices:
            self._slices = [self._rows(self.words[at : at + SLICE]) for at in range(0, len(self.words), SLICE)]
        letters, pairs, beyond = self._rows(words)
        letters, pairs, sizes = letters.astype(np.float32), pairs.astype(np.float32), np.array([len(w) for w in words])
        for k, (theirs, their_pairs, their_beyond) in enumerate(self._slices):
            at = k * SLICE
            both = sizes[:, None] + self.sizes[None, at : at + SLICE]
            p = pairs @ their_pairs.T.astype(np.float32) + np.minimum(beyond[:, None], their_beyond[None])
            m = np.minimum(letters @ theirs.T.astype(np.float32), np.floor((p + 1 + both) / 3))
            yield at, np.where(both > 0, 2.0 * m / np.maximum(both, 1), 1.0)

    def _common(self, word: str, options: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of a word of up to BITS letters and some vocabulary words (BITS for longer ones): a bit for each
        letter of the word, all vocabulary words advance one letter at a time."""
        if self._grid is None:
            width = min(int(self.sizes.max(initial=0)), BITS)
            self._grid = np.zeros((len(self.words), width), np.int32)
            for i, w in enumerate(self.words):
                if len(w) <= BITS:
                    self._grid[i, : len(w)] = [self.number[c] for c in w]
        masks = np.zeros(len(self.number) + 1, np.uint64)
        for i, c in enumerate(word):
            if c in self.number:
                masks[self.number[c]] |= np.uint64(1 << i)
        own = masks[self._grid[options]]
        left = np.full(len(options), np.iinfo(np.uint64).max, np.uint64)  # bits not yet matched
        for j in range(min(int(self.sizes[options].max(initial=0)), own.shape[1])):
            met = left & own[:, j]
            left = (left + met) | (left - met)
        return np.where(self.sizes[options] > BITS, BITS, 64 - np.bitwise_count(left).astype(np.int64))

    def nearest(self, words: list[str], k: int, cutoff: float) -> tuple[list[list[tuple[str, float]]], int]:
        """For each word at most k (match, ratio) of cutoff at least, highest ratio first and of equal ones the greater word; and how many pairs were compared."""
        parts = list(self.bounds(words))
        upper = np.concatenate([p for _, p in parts], 1) if parts else np.zeros((len(words), 0))
        out, compared = [], 0
        for word, bound in zip(words, upper):
            options = np.flatnonzero(bound >= cutoff - 1e-9)
            if 0 < len(word) <= BITS and len(options):
                bound = bound.copy()
                bound[options] = np.minimum(bound[options], 2.0 * self._common(word, options) / (len(word) + self.sizes[options]))
                options = options[bound[options] >= cutoff - 1e-9]
            options = options[np.argsort(-bound[options], kind="stable")]
            matcher = difflib.SequenceMatcher()
            matcher.set_seq2(word)
            best: list[tuple[float, str]] = []
            for j in options.tolist():
                if len(best) == k and bound[j] < best[-1][0] - 1e-9:
                    break
                matcher.set_seq1(self.words[j])
                compared += 1
                ratio = matcher.ratio()
                if ratio >= cutoff:
                    best = sorted([*best, (ratio, self.words[j])], reverse=True)[:k]
            out.append([(w, r) for r, w in best])
        return out, compared


def vocabulary_of(words: DataFrame) -> Vocabulary:
    """The distinct non-empty words of a column word, at most MAX_WORDS."""
    words = words.select("word").where("word != ''").distinct()
    n = words.count()
    if n > MAX_WORDS:
        raise ValueError(f"a vocabulary of {n} words; at most {MAX_WORDS} are sent to tasks")
    return Vocabulary(r[0] for r in words.collect())


def nearest(words: DataFrame, vocabulary: DataFrame, k: int = 4, cutoff: float = 0.6) -> DataFrame:
    """The k nearest vocabulary words of each distinct word: word, match, ratio, rank (from 1); words without one are absent.

    Both frames have a column word; null and empty words match nothing. Of equal ratios the greater word by code points comes first.
    """
    return _lookup(words.select("word").where("word != ''").distinct(), vocabulary_of(vocabulary), k, cutoff)


def _lookup(words: DataFrame, vocabulary: Vocabulary, k: int, cutoff: float) -> DataFrame:
    """nearest() of distinct words in a vocabulary already collected."""
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    words = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # short rows, long work: not to be coalesced by their bytes

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_pylist()
            for at in range(0, len(every), BLOCK):
                block = every[at : at + BLOCK]
                found, _ = sent.value.nearest(block, k, cutoff)
                flat = [(w, m, r, i + 1) for w, near in zip(block, found) for i, (m, r) in enumerate(near)]
                if flat:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*flat), (pa.string(), pa.string(), pa.float64(), pa.int64()))], names=["word", "match", "ratio", "rank"]
                    )

    return words.mapInArrow(rows, NEAREST)


def spelling(docs: DataFrame, vocabulary: DataFrame, k: int = 4, pattern: str = "[ঀ-৿]+", endings: str = script.SUFFIX.pattern) -> DataFrame:
    """Words outside a vocabulary with their places: doc_id, line, col (from 1), word, suggestions.

    docs has doc_id and text, vocabulary a column word. Words are runs of pattern of two letters or more that are not all digits of the script, in
    composed form. Suggestions are the k nearest of ratio 0.6, else of 0.55 to the word without its ending; a word of more than
    two letters that has no suggestion and whose stem is known is none of the report. Null texts have no words.
    """
    vocabulary = written(vocabulary.select("word").distinct())  # this and the words' forms are read several times: else each reader's plan holds all of the others'
    known = vocabulary_of(vocabulary)
    words = docs.select("doc_id", F.explode(places.places(F.col("text"), pattern)).alias("p")).select("doc_id", "p.line", "p.col", F.col("p.text").alias("word"))
    words = words.where((F.length("word") > 1) & ~F.col("word").rlike("^[০-৯]+$")).withColumn("form", script.nfc("word"))
    forms = words.select("form", (F.length("word") > 2).alias("long")).groupBy("form").agg(F.max("long").alias("long"))
    forms = written(forms.join(vocabulary.select(F.col("word").alias("form")), "form", "left_anti"))
    stem = F.regexp_replace("form", endings, "")
    first = _suggested(_lookup(forms.select(F.col("form").alias("word")), known, k, 0.6), "form", "direct")
    forms = written(forms.join(first, "form", "left")).withColumn("stem", F.when(F.col("direct").isNull() & F.col("long"), stem))
    missed = forms.where("stem IS NOT NULL").select(F.col("stem").alias("word")).distinct()
    second = _suggested(_lookup(missed, known, k, 0.55), "stem", "retried")
    stems = vocabulary.select(F.col("word").alias("stem"), F.lit(True).alias("is_known")).where("stem != ''").distinct()
    forms = forms.join(second, "stem", "left").join(stems, "stem", "left").where("is_known IS NULL")
    forms = written(forms.select("form", F.coalesce("direct", "retried", F.array().cast("array<string>")).alias("suggestions")))
    # Spark takes the words of texts for no more than the texts are in their file, and would send them all: only forms are sent, by their own size
    return words.hint("merge").join(sent(forms), "form").select("doc_id", "line", "col", "word", "suggestions")


def _suggested(found: DataFrame, key: str, name: str) -> DataFrame:
    """nearest() rows as one array a word, best first; at most k each."""
    ranked: Column = F.array_sort(F.collect_list(F.struct("rank", "match")))
    return found.groupBy(F.col("word").alias(key)).agg(F.transform(ranked, lambda s: s["match"]).alias(name))
