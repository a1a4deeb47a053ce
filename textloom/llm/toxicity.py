"""Toxicity scores over noisy-channel restored text.

Three passes over the documents. The first counts character trigrams of all words (the language model)
and, over labelled training rows, in how many toxic and other rows each word and word prefix stands. The
second collects which of the telling features each training row has, and a logistic regression is
fitted to them on the driver. The third scores every text.

Words that look disguised (digits or symbols among letters, letters repeated, letters set apart) go
through a character lattice: each sign may stand for letters, a repeated letter may be dropped,
separators may be skipped. Viterbi search finds the most likely letters under channel costs and the
language model, and the restored words give features like any others. Plain words need no search.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import checkpoint, small_batches
from textloom.llm._text import hash_pieces, joined, words

#: Bound on the labelled rows the classifier learns from (those of smallest hash of doc_id).
MAX_LABELLED = 20_000
MAX_FEATURES = 4_000
PREFIXES = (4, 5, 6, 7)
FOLDS = 5
#: Features stand in at least MIN_ROWS labelled rows. How far their log-odds of a toxic row must be from 0 (ODDS), and the
#: inverse variance of the weights' prior (PRIORS), are chosen by folds of the training rows.
MIN_ROWS, ODDS, PRIORS, CHOICE_FOLDS = 3, (3.0, 2.0, 4.0), (0.2, 0.05, 1.0), 4

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Letters that a sign may stand for; fixed values.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
_GAPS = set(".-_*~'^,/ ")
_SIGN_COST, _GAP_COST, _REPEAT_COST, _SAME_COST, _DOUBT_COST = 1.0, 0.4, 0.3, 0.05, 2.0
#: Paths kept in a state, and readings taken of a disguised token.
KEPT, N_BEST = 3, 8
#: Doubled letters of a word up to which all ways to drop them are looked up before it is decoded.
SUBSETS = 4


# ---- language model ---------------------------------------------------------------------------

_SYMBOLS = 28  # word edge, a-z, any other letter
_CODE = np.full(256, 27, np.int64)
for _i in range(26):
    _CODE[65 + _i] = _CODE[97 + _i] = _i + 1


def trigram_counts(w) -> np.ndarray:
    """Counts of (x, y, z) over the letters of each word between two edges."""
    size = w.end - w.start
    if not len(size):
        return np.zeros(_SYMBOLS**3, np.int64)
    total = int((size + 3).sum())
    line = np.zeros(total, np.int64)
    at = np.cumsum(size + 3) - (size + 3) + 2
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    line[np.repeat(at, size) + place] = _CODE[w.data[np.repeat(w.start, size) + place]]
    code = (line[:-2] * _SYMBOLS + line[1:-1]) * _SYMBOLS + line[2:]
    counts = np.bincount(code, minlength=_SYMBOLS**3)
    counts[0] = 0
    return counts


class CharModel:
    """Interpolated character trigrams."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(float)
        uni = c.sum((0, 1)) + 1.0
        uni /= uni.sum()
        two = c.sum(0)
        bi = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
        tri = (c + 10 * bi[None]) / (c.sum(2, keepdims=True) + 10)
        self.log = np.log(tri).tolist()

    @staticmethod
    def code(ch: str) -> int:
        return ord(ch) - 96 if "a" <= ch <= "z" else 27


def readings(lm: CharModel, token: str, n: int = 1) -> list[str]:
    """The n most likely letters behind a disguised token, best first: Viterbi over its lattice, whose states are the last two letters.

    Each state keeps its KEPT best paths (or 1, if one reading is asked for), so the first reading is exact and the others are its
    neighbours. Letters stand for themselves, a sign for each of its letters or for nothing, a repeat may be dropped. Linear in the token.
    """
    log, kept = lm.log, 1 if n == 1 else KEPT
    # state: last two codes -> best (score, path), path: (path before, letter)
    beam: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {(0, 0): [(0.0, None)]}
    for ch in token.lower():
        nxt: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {}
        letter = ch.isalpha()
        reads = [(ch, _SAME_COST)] if letter else [(x, _SIGN_COST) for x in SIGNS.get(ch, "")]
        skip = 0.0 if letter else _GAP_COST if ch in _GAPS or ch not in SIGNS else _DOUBT_COST
        for (a, b), paths in beam.items():
            row = log[a][b]
            for score, path in paths:
                for x, cost in reads:
                    c = CharModel.code(x)
                    nxt.setdefault((b, c), []).append((score - cost + row[c], (path, x)))
                if path and any(x == path[1] for x, _ in reads):  # a repeat that adds nothing
                    nxt.setdefault((a, b), []).append((score - _REPEAT_COST, path))
                if not letter:
                    nxt.setdefault((a, b), []).append((score - skip, path))
        if nxt:
            beam = {k: v if len(v) <= kept else sorted(v, key=_first, reverse=True)[:kept] for k, v in nxt.items()}
    ends = sorted(((s + log[a][b][0], path) for (a, b), paths in beam.items() for s, path in paths), key=_first, reverse=True)
    out: list[str] = []
    for _, path in ends:
        letters = []
        while path:
            path, x = path
            letters.append(x)
        word = "".join(reversed(letters))
        if word not in out:
            out.append(word)
            if len(out) == n:
                break
    return out


def _first(x: tuple) -> float:
    return x[0]


def restore(lm: CharModel, token: str) -> str:
    """The most likely letters behind a disguised token."""
    return readings(lm, token)[0]


_SIGN_IN = re.compile(r"[A-Za-z](?:[.\-_*~'^/][A-Za-z0-9@$!|]){2,}|[0134567@$!|+(<€£*89#]")
_REPEAT = re.compile(r"([A-Za-z])\1\1")
_SOFT = re.compile(r"([A-Za-z])\1|[A-Za-z][.\-_*~'^/][A-Za-z]", re.I)


def disguised(token: str) -> str:
    """The part of a token that hides letters behind signs, sets them apart or repeats them three times or more; or an empty string."""
    core = token.strip("\"'.,;:?()[]{}").rstrip("!#%&")
    if len(core) < 3 or not any(c.isascii() and c.isalpha() for c in core) or "://" in core or core.count("@") == 1 and "." in core.split("@")[1]:
        return ""
    return core if _REPEAT.search(core) or not (core.isascii() and core.isalpha()) and _SIGN_IN.search(core) else ""


def doubtful(token: str) -> str:
    """The part of a token with a doubled letter or one separator inside, which plain words have as well; or an empty string."""
    core = token.strip("\"'.,;:?!()[]{}#%&")
    return core if len(core) > 3 and _SOFT.search(core) else ""


# ---- features ---------------------------------------------------------------------------------


_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS if ord(c) < 128]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in ".-_*~'^/"]] = True


def _strange(w) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of white-space words to look at closely: those with signs or long repeats, and those with just a doubled letter or one separator.

    Signs count next to a letter (an exclamation mark only before one), repeats from three, separators from two between letters.
    """
    data = w.data
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = data | 0x20
    alpha = (low >= 97) & (low <= 122)
    sign = _SIGN[data]
    hard = np.zeros(len(data), bool)
    hard[:-1] = sign[:-1] & alpha[1:]
    hard[1:] |= sign[1:] & (data[1:] != 33) & (alpha[:-1] | sign[:-1])
    same = np.zeros(len(data), bool)
    same[1:] = alpha[1:] & (low[1:] == low[:-1])
    hard[1:] |= same[1:] & same[:-1]
    between = np.zeros(len(data), bool)
    between[1:-1] = _SEPARATOR[data[1:-1]] & alpha[:-2] & (alpha[2:] | sign[2:])
    count = lambda mask: (t := np.concatenate([[0], np.cumsum(mask)]))[w.end] - t[w.start]
    apart = count(between)
    high = (data[w.start] == 0xE2) | (data[w.start] == 0xC2)
    strong = (count(hard) > 0) | (apart > 1) | high
    soft = ~strong & ((apart == 1) | (count(same) > 0)) & (w.end - w.start > 3)
    return np.flatnonzero(strong), np.flatnonzero(soft)


def _plain_hits(w, idx: np.ndarray, classifier: Classifier) -> np.ndarray:
    """Which of the words idx may be read as telling words, or as words that start like one, by their letters with any of their doubled ones single.

    Every way to drop doubled letters is hashed, for words with up to SUBSETS of them; words with more may be read in any way, and pass.
    """
    size = w.end[idx] - w.start[idx]
    begin = np.cumsum(size) - size
    flat = np.repeat(w.start[idx] - begin, size) + np.arange(int(size.sum()))
    owner = np.repeat(np.arange(len(idx)), size)
    byte = w.data[flat]
    letter = ~_NOT_LETTER[byte]
    byte, owner = byte[letter], owner[letter]
    low = byte | 0x20
    twice = np.zeros(len(byte), bool)
    twice[1:] = (byte[1:] < 128) & (low[1:] == low[:-1]) & (owner[1:] == owner[:-1])
    many = np.bincount(owner, weights=twice, minlength=len(idx)).astype(np.int64)
    seen = np.cumsum(twice) - twice
    first = np.searchsorted(owner, np.arange(len(idx)))
    nth = seen - np.concatenate([seen, [0]])[first][owner]
    out = many > SUBSETS
    for dropped in range(1 << min(SUBSETS, int(many.max(initial=0)))):
        some = (many[owner] <= SUBSETS) & (1 << many[owner] > dropped) & ~(twice & (dropped >> np.minimum(nth, 62) & 1 == 1))
        h, long, prefixes = hash_pieces(byte[some], owner[some], len(idx), PREFIXES)
        real = (many <= SUBSETS) & (1 << many > dropped)
        out |= real & (classifier.hits(h) >= 0)
        for at, x in zip(long, prefixes):
            out[at[real[at] & (classifier.hits(x) >= 0)]] = True
    return out


def _split_words(w, classifier: Classifier) -> list[tuple[int, str]]:
    """(text, both parts with a space) of neighbouring letter words, one sign apart, that are a telling word if written as one. w: letter words."""
    if len(w.hash) < 2:
        return []
    owner = np.searchsorted(w.first, np.arange(len(w.hash)), "right") - 1
    near = np.flatnonzero((w.start[1:] == w.end[:-1] + 1) & (owner[1:] == owner[:-1]))
    size = w.end - w.start
    hit = near[classifier.hits(joined(w.hash[near], size[near], w.hash[near + 1], size[near + 1])) >= 0]
    text = lambda i: bytes(w.data[w.start[i] : w.end[i]]).decode("utf-8", "replace")
    return [(int(owner[i]) + w.lo, f"{text(i)} {text(i + 1)}") for i in hit.tolist()]


def _spaced(w) -> list[tuple[int, int, int]]:
    """(text, first word, last word + 1) of runs of at least three one-letter words."""
    one = (w.end - w.start) == 1
    runs = []
    if not one.any():
        return runs
    owner = np.searchsorted(w.first, np.arange(len(one)), "right") - 1
    idx = np.flatnonzero(one)
    cut = np.flatnonzero((np.diff(idx) > 1) | (np.diff(owner[idx]) > 0)) + 1
    for part in np.split(idx, cut):
        if len(part) >= 3:
            runs.append((int(owner[part[0]]), int(part[0]), int(part[-1]) + 1))
    return runs


def _of_letters(w) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, text indexes) of the letter words and their prefixes."""
    owner = np.searchsorted(w.first, np.arange(len(w.hash)), "right") - 1
    hashes, owners = [w.hash], [owner]
    for at, h in w.prefix.values():
        hashes.append(h)
        owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners)


class Reader:
    """Telling features of disguised words, found by decoding their lattices; remembered per word.

    Words of signs or long repeats give their N_BEST readings. Words with just a doubled letter or one separator are as
    often plain, so they are decoded only if some way to read their letters is a telling word, and give their N_BEST readings then.
    Neighbouring words that are a telling word if written as one are decoded as one.
    """

    def __init__(self, lm: CharModel, classifier: Classifier):
        self.lm, self.classifier = lm, classifier
        self.known: dict[int, tuple[int, ...]] = {}

    def look(self, token: str) -> list[str]:
        """Readings of a word that needs a closer look; empty for an undisguised one."""
        core = disguised(token)
        if core:
            return readings(self.lm, core, N_BEST)
        core = doubtful(token)
        return readings(self.lm, core, N_BEST) if core else []

    def _hits(self, texts: list[str]) -> list[tuple[int, ...]]:
        """The telling features of each word."""
        out: list[list[int]] = [[] for _ in texts]
        for w in words(pa.array(texts, pa.string()), space=_NOT_LETTER, prefixes=PREFIXES):
            h, owner = _of_letters(w)
            hit = self.classifier.hits(h)
            for o, x in zip((owner[hit >= 0] + w.lo).tolist(), hit[hit >= 0].tolist()):
                out[o].append(x)
        return [tuple(sorted(set(x))) for x in out]

    def _learn(self, fresh: dict[int, str]) -> None:
        """Remember the features of these words, by hash."""
        if len(self.known) > 400_000:
            self.known.clear()
        read = [(h, x) for h, token in fresh.items() for x in self.look(token)]
        self.known.update(dict.fromkeys(fresh, ()))
        for (h, _), hits in zip(read, self._hits([x for _, x in read]) if read else ()):
            if hits:
                self.known[h] = tuple(sorted({*self.known[h], *hits}))

    def rejoined(self, pairs: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(text indexes, features) of words split in two, each decoded as one."""
        read = {t: restore(self.lm, t) for t in {t for _, t in pairs}}
        hits = dict(zip(read, self._hits(list(read.values())) if read else ()))
        both = [(o, x) for o, t in pairs for x in hits[t]]
        return np.array([o for o, _ in both], np.int64), np.array([x for _, x in both], np.int64)

    def restored(self, arr) -> tuple[np.ndarray, np.ndarray]:
        """(text indexes, features) of all disguised words of a column."""
        owners, hits = [], []
        for w in words(arr):
            strong, soft = _strange(w)
            if len(soft):
                strong = np.concatenate([strong, soft[_plain_hits(w, soft, self.classifier)]])
            uniq, first, inv = np.unique(w.hash[strong], return_index=True, return_inverse=True)
            fresh = {h: bytes(w.data[w.start[i] : w.end[i]]).decode("utf-8", "replace") for h, i in zip(uniq.tolist(), strong[first].tolist()) if h not in self.known}
            self._learn(fresh)
            telling = [self.known.get(h, ()) for h in uniq.tolist()]
            some = np.array([bool(x) for x in telling], bool)
            if some.any():
                owner = np.searchsorted(w.first, strong, "right") - 1 + w.lo
                for k in np.flatnonzero(some[inv]).tolist():
                    for x in telling[inv[k]]:
                        owners.append(int(owner[k]))
                        hits.append(x)
            spaced = []
            for o, a, b in _spaced(w):
                token = bytes(w.data[w.start[a:b]]).decode("ascii", "replace")
                if sum(c.isalpha() for c in token) >= 3:
                    # a one-letter word of the sentence may stand before or after the spaced word
                    spaced += [(w.lo + o, x) for t in (token, token[1:], token[:-1]) for x in readings(self.lm, t, N_BEST) if len(x) > 2]
            for (o, _), own in zip(spaced, self._hits([x for _, x in spaced]) if spaced else ()):
                owners += [o] * len(own)
                hits += own
        return np.array(owners, np.int64), np.array(hits, np.int64)


def _gatherer(lm_only_labels: dict[int, int]):
    """First pass: trigram counts (kind 0), and feature counts in toxic and other training rows (kind 1)."""

    def gather(batches):
        trigrams = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for w in words(batch.column(1), space=_NOT_LETTER, prefixes=PREFIXES):
                trigrams += trigram_counts(w)
                label = np.array([lm_only_labels.get(i, -1) for i in ids[w.lo : w.hi]])
                if (label < 0).all():
                    continue
                h, owner = _of_letters(w)
                use = label[owner] >= 0
                h, owner = h[use], owner[use]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, owner = h[keep], owner[keep]
                if not len(h):
                    continue
                head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                toxic = np.add.reduceat((label[owner] == 1).astype(np.int64), head)
                n = np.diff(np.append(head, len(h)))
                yield _rows(np.ones(len(head), np.int64), h[head].view(np.int64), toxic, n - toxic)
        some = np.flatnonzero(trigrams)
        yield _rows(np.zeros(len(some), np.int64), some, trigrams[some], np.zeros(len(some), np.int64))

    return gather


def _rows(*columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "pos", "neg"])


class Classifier:
    """Logistic regression over the presence of telling features (hashes)."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Index of the feature of each hash, or -1."""
        if not len(self.features):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        return np.where(self.features[at] == h, at, -1)

    def score(self, n: int, owner: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Scores of n texts that have these features; a feature counts once in a text."""
        width = max(1, len(self.features))
        pair = np.unique(owner[hit >= 0] * width + hit[hit >= 0])
        z = np.full(n, self.bias) + np.bincount(pair // width, weights=self.weights[pair % width] if len(pair) else None, minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _present(features: np.ndarray, labels: dict[int, int]):
    """Second pass: (doc_id, label, features) of each training row."""
    probe = Classifier(features, np.zeros(len(features)), 0.0)

    def present(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for w in words(batch.column(1), space=_NOT_LETTER, prefixes=PREFIXES):
                label = np.array([labels.get(i, -1) for i in ids[w.lo : w.hi]])
                if (label < 0).all():
                    continue
                h, owner = _of_letters(w)
                hit = probe.hits(h)
                use = (hit >= 0) & (label[owner] >= 0)
                pair = np.unique(owner[use] * max(1, len(features)) + hit[use])
                rows = [[] for _ in range(w.hi - w.lo)]
                for p in pair.tolist():
                    rows[p // len(features)].append(p % len(features))
                keep = np.flatnonzero(label >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([ids[w.lo + i] for i in keep], pa.int64()), pa.array(label[keep]), pa.array([rows[i] for i in keep], pa.list_(pa.int64()))], names=["doc_id", "label", "has"])

    return present


def log_odds(pos: np.ndarray, neg: np.ndarray, toxic: int, rest: int) -> np.ndarray:
    """Log-odds of a toxic row, by feature, from the toxic and other rows that hold it."""
    return np.log((pos + 0.5) / (toxic + 1.0)) - np.log((neg + 0.5) / (rest + 1.0))


def choose(rows: list[tuple[int, int, list[int]]], width: int) -> tuple[float, float]:
    """(odds, prior) of the least log loss over CHOICE_FOLDS folds of the training rows (doc_id, label, features).

    Each fold's features are chosen and weighed by the other folds alone. Ties, and rows too few to tell, take the first of ODDS and PRIORS.
    """
    fold = np.array([zlib.crc32(str(r[0]).encode()) // FOLDS % CHOICE_FOLDS for r in rows], np.int64)
    label = np.array([r[1] for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]).astype(np.int64)
    col = np.array([x for r in rows for x in r[2]], np.int64)
    best = (math.inf, ODDS[0], PRIORS[0])
    if not label.any() or label.all():
        return best[1:]
    counts = [[np.bincount(col[(fold[owner] != k) & (label[owner] == y)], minlength=width) for y in (1, 0)] for k in range(CHOICE_FOLDS)]
    for odds in ODDS:
        for prior in PRIORS:
            loss = 0.0
            for k, (pos, neg) in enumerate(counts):
                ours, theirs = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                toxic = int(label[ours].sum())
                use = (np.abs(log_odds(pos, neg, toxic, len(ours) - toxic)) > odds) & (pos + neg >= MIN_ROWS)
                has = use[col]
                w, b = fit_columns(label[ours], np.searchsorted(ours, owner[has & (fold[owner] != k)]), col[has & (fold[owner] != k)], width, prior, 100)
                mine = has & (fold[owner] == k)
                z = b + np.bincount(np.searchsorted(theirs, owner[mine]), weights=w[col[mine]], minlength=len(theirs))
                loss += float(np.logaddexp(0, np.where(label[theirs] == 1, -z, z)).sum())
            if loss < best[0] - 1e-9:
                best = (loss, odds, prior)
    return best[1:]


def fit_logistic(rows: list[tuple[int, list[int]]], width: int, prior: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """fit_columns of rows (label, features); without rows all texts are clean."""
    if not rows:
        return np.zeros(width), -3.0
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows]).astype(np.int64)
    return fit_columns(np.array([r[0] for r in rows]), owner, np.array([x for r in rows for x in r[1]], np.int64), width, prior, rounds)


def fit_columns(y: np.ndarray, owner: np.ndarray, col: np.ndarray, width: int, prior: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of rows owner that hold features col, by full-batch gradient steps with momentum, each weight at the pace of its count; a normal prior of variance 1 / prior."""
    w, v, vb = np.zeros(width), np.zeros(width), 0.0
    count = np.bincount(col, minlength=width) + 1.0
    b = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        z = b + np.bincount(owner, weights=w[col], minlength=len(y))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, weights=e[owner], minlength=width) / count + prior * w / count
        v = 0.9 * v - 0.3 * g
        w += v
        vb = 0.9 * vb - 0.3 * e.mean()
        b += vb
    return w, float(b)


class ToxicityModel:
    def __init__(self, lm: CharModel, classifier: Classifier):
        self.lm, self.classifier = lm, classifier

    def reader(self) -> Reader:
        return Reader(self.lm, self.classifier)

    def score_column(self, arr, reader: Reader) -> np.ndarray:
        """Scores of a column of texts, from their plain words and what the reader restores."""
        owners, hits = [], []
        for w in words(arr, space=_NOT_LETTER, prefixes=PREFIXES):
            h, owner = _of_letters(w)
            hit = self.classifier.hits(h)
            owners.append(owner[hit >= 0] + w.lo)
            hits.append(hit[hit >= 0])
            split = _split_words(w, self.classifier)
            if split:
                o, x = reader.rejoined(split)
                owners.append(o)
                hits.append(x)
        if len(self.classifier.features):
            more, which = reader.restored(arr)
            owners.append(more)
            hits.append(which)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return self.classifier.score(len(arr), cat(owners), cat(hits))

    def scorer(self):
        def score(batches):
            reader = self.reader()
            for batch in batches:
                if batch.num_rows:
                    s = self.score_column(batch.column(1), reader)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

        return score


def held_out(doc_id) -> object:
    """crc32 of the id as text, modulo FOLDS, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model from all texts (language model) and at most MAX_LABELLED labelled training rows (classifier).

    labels: doc_id, toxic 0/1; held-out ids, null ids and null labels are left out; an id with both labels counts as toxic.
    """
    d = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    label = {r.doc_id: r.toxic for r in known.collect()}
    counts = checkpoint(d.mapInArrow(_gatherer(label), "kind long, key long, pos long, neg long").groupBy("kind", "key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    trigrams = np.zeros(_SYMBOLS**3, np.int64)
    for r in counts.where("kind = 0").collect():  # at most 28^3 rows
        trigrams[r.key] = r.pos
    toxic, rest = sum(label.values()), len(label) - sum(label.values())
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1.0)) - F.log((F.col("neg") + 0.5) / (rest + 1.0))
    telling = counts.where(f"kind = 1 and pos + neg >= {MIN_ROWS}").withColumn("odds", odds).where(F.abs("odds") > min(ODDS))
    telling = telling.orderBy(F.desc(F.abs("odds") * F.sqrt(F.greatest("pos", F.col("neg") * (toxic + 1.0) / (rest + 1.0)))), "key").limit(MAX_FEATURES).collect()
    telling.sort(key=lambda r: r.key % 2**64)
    features = np.array([r.key for r in telling], np.int64).view(np.uint64)
    has = d.mapInArrow(_present(features, label), "doc_id long, label long, has array<long>").groupBy("doc_id").agg(F.first("label").alias("label"), F.max("has").alias("has"))
    rows = sorted((r.doc_id, r.label, r.has) for r in has.collect())  # at most MAX_LABELLED: of a repeated id, one row
    least, prior = choose(rows, len(features))
    use = np.array([abs(r.odds) > least for r in telling], bool)
    place = np.cumsum(use) - 1
    weights, bias = fit_logistic([(y, [int(place[x]) for x in has if use[x]]) for _, y, has in rows], int(use.sum()), prior)
    features = features[use]
    return ToxicityModel(CharModel(trigrams), Classifier(features, weights, bias))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; score never sees labels, language, source or id.

    Null and empty texts have no feature and get the base rate. Every row gives one row, repeated and
    null ids included (a null id counts as not held out). Texts and words of any length are read whole. Other columns are
    ignored; an empty table gives no rows, and without labels all scores are equal.
    """
    model = train(docs, labels)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = d.mapInArrow(model.scorer(), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5; columns as given, whatever their names.

    Null and empty texts have the base rate and stay (it is under 0.5 unless most labelled rows are toxic). Every row is judged
    by its own text, repeated and null ids included; without labels all stay.
    """
    model = train(docs, labels)
    at = docs.columns.index("text")

    def keep(batches):
        reader = model.reader()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score_column(batch.column(at).cast(pa.string()), reader) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
