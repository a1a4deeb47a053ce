"""Vectorized word and shingle hashing over Arrow string columns.

Words are maximal runs of characters other than space and \\x09-\\x0D, A-Z lower-cased. Everything
works on the UTF-8 bytes of an Arrow column, chunk by chunk, so that memory follows chunk size
(or the longest single text) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(0x319642B2D24D8EC3)
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(0x96DE1B173F119089)
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def joined(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Hashes of words a and b written as one, from their hashes and sizes in bytes."""
    powers = np.ones(int(a_size.max(initial=0)) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    left, right = (unmix(h) - n.astype(np.uint64) for h, n in ((a, a_size), (b, b_size)))
    return mix(left + powers[a_size] * right + (a_size + b_size).astype(np.uint64))


@dataclass
class Words:
    """The words of texts lo..hi of a column: byte bounds, hashes, and per text the first word's index."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # hi - lo + 1 entries
    prefix: dict = field(default_factory=dict)  # length: (word indexes, hashes)


def _buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    large = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def words(arr: pa.Array, chunk: int = CHUNK_BYTES, space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> Iterator[Words]:
    """Words of a string column, some texts at a time. Null and empty texts have none.

    space: which bytes part words. prefixes: lengths in bytes; each word longer than that also gets
    the hash of its prefix, which is that of the same bytes as a word.
    """
    n = len(arr)
    if not n:
        return
    raw, off = _buffers(arr)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + chunk, "right")) - 1)
        hi = min(hi, n)
        yield _chunk(raw, off, lo, hi, space, prefixes)
        lo = hi


def _chunk(raw: np.ndarray, off: np.ndarray, lo: int, hi: int, space: np.ndarray, prefixes: tuple[int, ...]) -> Words:
    base = int(off[lo])
    data = raw[base : int(off[hi])]
    bounds = off[lo : hi + 1] - base
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(lo, hi, data, z, z, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64))
    solid = ~space[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    cuts = bounds[:-1]
    before[cuts[cuts < len(data)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:] & before[1:]
    end = np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(start, bounds).astype(np.int64)
    if not len(start):
        return Words(lo, hi, data, start, end, np.zeros(0, np.uint64), first)
    size = end - start
    where = np.flatnonzero(solid)
    begins = np.cumsum(size) - size
    place = np.arange(len(where)) - np.repeat(begins, size)
    powers = np.ones(int(size.max()), np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    parts = _BYTE[data[where]] * powers[place]
    h = np.add.reduceat(parts, begins)
    out = Words(lo, hi, data, start, end, mix(h + size.astype(np.uint64)), first)
    for p in prefixes:
        long = size > p
        h = np.add.reduceat(np.where(place < p, parts, np.uint64(0)), begins)
        out.prefix[p] = (np.flatnonzero(long), mix(h[long] + np.uint64(p)))
    return out


def hash_pieces(data: np.ndarray, owner: np.ndarray, n: int, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Hashes of n words given as bytes with their (rising) word number; and for each prefix length the longer words and their prefixes' hashes."""
    size = np.bincount(owner, minlength=n)
    begin = np.cumsum(size) - size
    place = np.arange(len(data)) - begin[owner]
    powers = np.ones(int(size.max()) if n else 1, np.uint64)
    powers[1:] = _BASE
    parts = _BYTE[data] * np.cumprod(powers, dtype=np.uint64)[place] if len(data) else np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
    out = mix(total[begin + size] - total[begin] + size.astype(np.uint64))
    long = [np.flatnonzero(size > p) for p in prefixes]
    return out, long, [mix(total[begin[at] + p] - total[begin[at]] + np.uint64(p)) for at, p in zip(long, prefixes)]


def hash_word(word: str) -> np.uint64:
    """The hash that words() gives to this word."""
    return next(words(pa.array([word]))).hash[0]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and per text the first one's index.

    A text of 1 to k-1 words has one shingle, its whole sequence; a text without words has none.
    """
    per = np.diff(w.first)
    count = np.where(per >= k, per - k + 1, (per > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.uint64), first
    at = np.arange(total) - np.repeat(first[:-1], count) + np.repeat(w.first[:-1], count)
    left = np.repeat(np.minimum(per, k), count)
    h = left.astype(np.uint64) * _STEP[63]
    last = len(w.hash) - 1
    for j in range(k):
        h += np.where(left > j, w.hash[np.minimum(at + j, last)] * _STEP[j], np.uint64(0))
    return mix(h), first


def distinct_sets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats, flat, and the new first indexes."""
    n = len(first) - 1
    if not len(h):
        return h, first
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the (wrapping) sum of its values."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[first[1:]] - total[first[:-1]]


def minima(values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """Per text the smallest value."""
    out = np.full(len(first) - 1, empty, values.dtype)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.minimum.reduceat(values, first[:-1][some])
    return out
