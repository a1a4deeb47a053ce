"""Glyphs of the legacy font read into Unicode as a finite-state transducer over flat arrays of code points.

First pass: a trie in an array walks from all places at once and gives the longest glyph at each; of glyphs that overlap
the leftmost stays. Second pass: syllables in the order of the page (sign, letters, signs, r) are found by the classes of
their code points and written in the order of speech. Both take a whole batch of texts as one buffer, in pieces of bounded size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from textloom.functions import bengali
from textloom.functions.legacy_glyphs import BELOW, HALVES, LETTERS, RUNS, SIGNS, WHOLE

REPH = ""
DIGITS = dict(zip("0123456789", bengali.DIGITS))
GLYPHS = LETTERS | DIGITS | SIGNS | HALVES | BELOW | WHOLE | RUNS | {"©": REPH}
#: Parts of a syllable; fixed values.
BEFORE, VOWELS, MARKS, CANDRA = "িেৈ", "াোৌৗুূীৃ", "ংঃ", "ঁ"
TAKES_ER = "নণগরয়য"

#: Code points of a piece; pieces end behind a line end or a space.
PIECE = 1 << 19
VIRAMA, E, N, R, Y = (ord(c) for c in "্েনরয")
_INERT = 0x200000  # added to Bengali letters that are no glyphs: no class holds them
_TABLE = 1 << 16


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _class(members) -> np.ndarray:
    table = np.zeros(_TABLE + 1, dtype=bool)
    table[[ord(c) for c in members]] = True
    return table


_span = lambda a, z: [chr(c) for c in range(ord(a), ord(z) + 1)]
_WHOLE_LETTERS = ["ড়", "ঢ়", "য়"]
_CONSONANT = _class(_span("ক", "হ") + _WHOLE_LETTERS + ["ৎ"])
_LETTER = _CONSONANT | _class(_span("অ", "ঔ"))
_BEFORE, _VOWEL, _MARK, _TAIL, _TAKES = map(_class, (BEFORE, VOWELS, MARKS, VOWELS + MARKS + CANDRA + REPH, TAKES_ER))


@lru_cache(maxsize=1)
def _trie() -> tuple[np.ndarray, ...]:
    """symbol by code point, next state by (state, symbol), glyph by state (-1 none), and start, length and code points of what each glyph writes."""
    symbols = {c: i + 1 for i, c in enumerate(sorted({c for g in GLYPHS for c in g}))}
    steps: list[dict[int, int]] = [{}, {}]  # state 0: nothing fits; 1: the root
    ends = [-1, -1]
    for k, g in enumerate(GLYPHS):
        at = 1
        for c in g:
            if symbols[c] not in steps[at]:
                steps[at][symbols[c]] = len(steps)
                steps.append({})
                ends.append(-1)
            at = steps[at][symbols[c]]
        ends[at] = k
    symbol = np.zeros(_TABLE + 1, dtype=np.int32)
    for c, i in symbols.items():
        symbol[ord(c)] = i
    follow = np.zeros((len(steps), len(symbols) + 1), dtype=np.int32)
    for i, s in enumerate(steps):
        for c, j in s.items():
            follow[i, c] = j
    written = [codes(u) for u in GLYPHS.values()]
    length = np.array([len(w) for w in written], dtype=np.int64)
    return symbol, follow, np.array(ends, dtype=np.int32), np.cumsum(length) - length, length, np.concatenate(written)


def _longest(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest glyph from each place: its number (-1 none) and its length (1 where none)."""
    _, follow, ends, *_ = _trie()
    n = len(symbol)
    glyph, length = np.full(n, -1, dtype=np.int32), np.ones(n, dtype=np.int64)
    at, state, k = np.arange(n), np.ones(n, dtype=np.int32), 0
    while len(at):
        state = follow[state, symbol[at + k]]
        k += 1
        done = ends[state] >= 0
        glyph[at[done]], length[at[done]] = ends[state[done]], k
        on = (state > 0) & (at + k < n)
        at, state = at[on], state[on]
    return glyph, length


def _leftmost(length: np.ndarray) -> np.ndarray:
    """Whether a glyph begins at each place when glyphs are taken from the left; clusters of overlapping glyphs advance side by side."""
    starts = np.ones(len(length), dtype=bool)
    long = np.flatnonzero(length > 1)
    if not len(long):
        return starts
    ends = long + length[long]
    first = np.ones(len(long), dtype=bool)
    first[1:] = long[1:] >= np.maximum.accumulate(ends)[:-1]
    cluster, lane = np.cumsum(first), np.flatnonzero(first)
    while len(lane):
        for k in range(1, int(length[long[lane]].max())):
            starts[(long[lane] + k)[length[long[lane]] > k]] = False
        after = np.searchsorted(long, ends[lane])
        on = after < len(long)
        on[on] = cluster[after[on]] == cluster[lane[on]]
        lane = after[on]
    return starts


def _read_glyphs(text: np.ndarray) -> np.ndarray:
    """Glyphs as Unicode in the order of the page, runs of viramas as one."""
    symbol, _, _, first, size, written = _trie()
    glyph, length = _longest(symbol[np.minimum(text, _TABLE)])
    starts = _leftmost(length)
    glyph, text = glyph[starts], text[starts]
    count = np.where(glyph >= 0, size[glyph], 1)
    source = np.repeat(np.arange(len(text)), count)
    within = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
    out = np.where(glyph[source] >= 0, written[np.where(glyph[source] >= 0, first[glyph[source]] + within, 0)], text[source])
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != VIRAMA) | (out[:-1] != VIRAMA)
    return out[keep]


def _speech_order(x: np.ndarray) -> np.ndarray:
    """Syllables in the order of speech; the genitive ending that was typed after its word joins it."""
    n = len(x)
    padded = np.concatenate((x, np.zeros(4, dtype=x.dtype)))
    kind = np.minimum(padded, _TABLE)
    letter, consonant, tail, vowel = _LETTER[kind], _CONSONANT[kind], _TAIL[kind], _VOWEL[kind]
    virama = padded == VIRAMA
    goes_on = np.zeros(len(padded), dtype=bool)
    goes_on[2:] = consonant[2:] & virama[1:-1] & letter[:-2]
    start = np.flatnonzero(letter & ~goes_on)
    if not len(start):
        return x
    # a chain of letters ends where the next letter does not go on; a virama behind it belongs to it
    last = np.flatnonzero(letter & ~np.concatenate((goes_on[2:], [False, False])))
    end = last + virama[last + 1]
    free = np.flatnonzero(~tail)
    stop = free[np.searchsorted(free, end + 1)]
    count = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    held = lambda mask: (c := count(mask))[stop] > c[end + 1]
    reph, candra = held(padded == ord(REPH)), held(padded == ord(CANDRA))
    latest = np.maximum.accumulate(np.where(vowel, np.arange(len(padded)), -1))[stop - 1]
    sounded = latest > end
    signed = np.concatenate(([False], _BEFORE[kind[:-1]]))[start]
    takes = _TAKES[kind[start]] & ((end == start) | ((end == start + 2) & (padded[end] == Y)))
    joins = padded[stop] == E
    of_n, of_r = joins & (padded[stop + 1] == N) & (padded[stop + 2] == R), joins & (padded[stop + 1] == R)
    before, follower = signed, np.searchsorted(start, stop + 1)
    while True:
        bare = ~before & ~sounded
        ner, er = bare & of_n & (reph | takes), bare & of_r & reph
        now = signed.copy()
        now[follower[er]] = False
        if (now == before).all():
            break
        before = now
    # six slots a place: r and virama, the code point itself, the sign before, the vowel, the candrabindu
    slots = np.zeros((n, 6), dtype=np.uint32)
    slots[:, 2] = x + 1  # 0 marks an empty slot
    edge = np.zeros(n + 5, dtype=np.int64)
    np.add.at(edge, end + 1, 1)
    np.add.at(edge, stop, -1)
    slots[(np.cumsum(edge)[:n] > 0) & ~_MARK[kind[:n]], 2] = 0
    slots[start[signed] - 1, 2] = 0
    slots[stop[ner], 2] = slots[stop[ner] + 1, 2] = 0
    slots[stop[er], 2] = 0
    slots[start[reph], 0], slots[start[reph], 1] = R + 1, VIRAMA + 1
    slots[end[before], 3] = padded[start[before] - 1] + 1
    slots[end[ner | er], 3] = E + 1
    slots[end[sounded], 4] = padded[latest[sounded]] + 1
    slots[end[candra], 5] = ord(CANDRA) + 1
    # the letter n of an ending that joined is a syllable of its own no more
    gone = stop[ner] + 1
    slots[gone] = 0
    flat = slots.ravel()
    return flat[flat > 0] - 1


def convert(text: str) -> str:
    """All glyphs of a buffer read; Bengali letters in it stay as they are, and glyphs and syllables never reach over them."""
    out, x, at = [], codes(text), 0
    while at < len(x):
        stop = min(at + PIECE, len(x))
        if stop < len(x):
            gaps = np.flatnonzero((x[at:stop] == 32) | (x[at:stop] == 10))
            if not len(gaps):
                gaps = np.flatnonzero((x[at:] == 32) | (x[at:] == 10))[:1]
            stop = at + int(gaps[-1]) + 1 if len(gaps) else len(x)
        piece = x[at:stop]
        own = (piece >= 0x980) & (piece <= 0x9FF)
        spoken = _speech_order(_read_glyphs(piece + np.where(own, _INERT, 0).astype(np.uint32)))
        out.append(np.where(spoken >= _INERT, spoken - _INERT, spoken).astype("<u4"))
        at = stop
    return (np.concatenate(out).tobytes().decode("utf-32-le", "surrogatepass") if out else "").replace(REPH, "র্")
