"""Language-model scores: corpus word counts, and a causal self-attention model over subword ids.

Counts. Texts are dealt into chunks of neighbouring rows. A chunk sends each of its distinct word hashes
once, so that the count table is a sum over chunks and its answers travel back once a chunk; chunk
and answers then meet in one group of bounded size. The words that make up more than one in HEAD of all tokens, at most HEAD
by that rule, go to every task with the code instead: they stand in nearly every chunk, and would be the join's hot keys.

Model. A public tokenizer's vocabulary gives subword ids (words with a space before them, A-Z
lowered, and an end id). One attention layer with relative position biases reads the previous ids and predicts the
next one's class; an id's share of its class comes from counts over all training texts, so the
probabilities of all ids sum to 1. It is trained in numpy by Adam: a first fit on a bounded sample of
passages gives a common start, then every id of every training text is learned from once: a task cuts the windows of its
texts, with a past of STRIDE to 2 * STRIDE - 1 ids as in scoring, into groups that are learned from side by side and averaged. Scoring takes windows of 2 * STRIDE ids that overlap by half: each id is scored once, with STRIDE to
2 * STRIDE - 1 ids of context where the text has them, in masked batches.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import checkpoint, small_batches
from textloom.llm._text import Words, mix, words

FOLDS = 10
CHUNK_ROWS, CHUNK_CHARS = 4096, 6 << 20
HEAD = 100_000
END = np.uint64(0x5E5E5E5E00000001)  # the end token's hash

#: Bounds of the model and of what it is trained on.
SAMPLE_TEXTS, PASSAGE, SAMPLE_IDS = 1500, 4000, 160_000  # training texts, characters of a passage somewhere in each, ids in all
WIDTH, ROWS, CLASSES, STRIDE = 16, 4096, 64, 16
STEPS, BATCH = 260, 96

#: Windows of all training texts: each id is a target once; those of a started STRETCH characters are a row. A text is learned from in
#: one of ROUNDS rounds. Groups of GROUP windows, LESSON at once, are learned from side by side, and their changes averaged.
STRETCH, LESSON, GROUP, ROUNDS, PARTS = 4000, 512, 512 * STEPS // 2, 2, 16


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _held_out(c):
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


# ---- subword ids ------------------------------------------------------------------------------


def default_vocabulary() -> str:
    """Place of the public vocabulary file; any tiktoken rank file may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Subwords:
    """Ids of words: each with a space before it, A-Z lowered."""

    def __init__(self, path: str):
        self.encoding, self.end = _encoder(path)
        pieces = [self.encoding.decode_single_token_bytes(i) for i in range(self.end)]
        self.spaced = np.array([x[:1] == b" " for x in pieces])
        self.width = np.array([len(x) for x in pieces], np.int64)

    def of(self, w: Words, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and first indexes of distinct words; where: an index of each in w.

        The words are encoded as one line. A word's first id is the only one that starts with a space,
        which gives the bounds; words of exotic white space, where it does not, are encoded one by one.
        """
        n = len(where)
        if not n:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        size = w.end[where] - w.start[where]
        begin = np.cumsum(size + 1) - (size + 1)
        line = np.full(int((size + 1).sum()), 32, np.uint8)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        line[np.repeat(begin + 1, size) + place] = _LOWER[w.data[np.repeat(w.start[where], size) + place]]
        ids = np.array(self.encoding.encode_ordinary(line.tobytes().decode("utf-8", "replace")), np.int64)
        first = np.flatnonzero(self.spaced[ids])
        if len(first) == n and first[0] == 0 and np.array_equal(np.add.reduceat(self.width[ids], first), size + 1):
            return ids, np.append(first, len(ids))
        lists = [self.encoding.encode_ordinary(bytes(line[b : b + k + 1]).decode("utf-8", "replace")) for b, k in zip(begin.tolist(), size.tolist())]
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return np.fromiter((x for own in lists for x in own), np.int64, int(first[-1])), first

    def sequences(self, w: Words, distinct: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each closed by the end id, and first indexes. distinct: an index of each distinct word, and each word's number among them."""
        n = len(w.first) - 1
        per_text = np.diff(w.first)
        where, inv = distinct or np.unique(w.hash, return_index=True, return_inverse=True)[1:]
        flat, first = self.of(w, where)
        size = np.diff(first)[inv] if len(inv) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n), per_text)
        length = np.bincount(owner, weights=size, minlength=n).astype(np.int64) + 1
        begin = np.concatenate([[0], np.cumsum(length)])
        out = np.full(int(begin[-1]), self.end, np.int64)
        if len(inv):
            total = int(size.sum())
            inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            source = flat[np.repeat(first[:-1][inv], size) + inside]
            # the ids of a text start after the end ids of those before it
            out[np.arange(total) + np.repeat(np.repeat(np.arange(n), per_text), size)] = source
        return out, begin


# ---- the model --------------------------------------------------------------------------------


@functools.cache
def _ones(n: int) -> np.ndarray:
    return np.ones((n, 1), np.float32)


def _longest(vectors: np.ndarray, axis: int) -> float:
    """The largest length of a table's vectors."""
    return math.sqrt(np.einsum("ij,ij->i" if axis else "ij,ij->j", vectors, vectors).max())


def _row_sums(rows: np.ndarray, *parts: np.ndarray) -> list[np.ndarray]:
    """Tables of ROWS sums of the vectors of each part by row; the vectors are put in order of rows first."""
    rows = rows.ravel().astype(np.uint16)
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    out = []
    for d in parts:
        table = np.zeros((ROWS, d.shape[-1]), d.dtype)
        table[rows[first]] = np.add.reduceat(d.reshape(-1, d.shape[-1]).take(order, 0), first, axis=0)
        out.append(table)
    return out


class AttentionModel:
    """One causal self-attention layer over id embeddings; a softmax over classes, and unigram shares within them."""

    def __init__(self, id_counts: np.ndarray, seed: int = 0):
        n = len(id_counts)
        order = np.argsort(-id_counts, kind="stable")
        self.row = np.empty(n, np.int64)  # frequent ids have rows of their own, the others share
        self.row[order] = np.arange(n)
        over = self.row >= ROWS // 2
        self.row[over] = ROWS // 2 + (mix(self.row[over].astype(np.uint64)) % np.uint64(ROWS // 2)).astype(np.int64)
        smooth = id_counts + 0.1
        alone = CLASSES // 2  # the most frequent ids are a class each; the rest is cut into classes of equal mass
        self.klass = np.empty(n, np.int64)
        self.klass[order[:alone]] = np.arange(min(alone, n))
        rest = order[alone:]
        mass = np.cumsum(smooth[rest])
        if len(rest):
            self.klass[rest] = alone + np.minimum((mass / mass[-1] * (CLASSES - alone)).astype(np.int64), CLASSES - alone - 1)
        inside = np.bincount(self.klass, weights=smooth, minlength=CLASSES)
        self.share = np.log10(smooth / inside[self.klass])
        r = np.random.default_rng(seed)
        g = lambda *s: (r.normal(0, 0.1, s)).astype(np.float32)
        start = np.log(np.maximum(inside / inside.sum(), 1e-12)).astype(np.float32)
        self.p = {"q": g(ROWS, WIDTH), "k": g(ROWS, WIDTH), "v": g(ROWS, WIDTH), "h": g(ROWS, WIDTH), "dist": np.zeros(2 * STRIDE, np.float32), "out": g(WIDTH, CLASSES), "bias": start}
        s = np.arange(STRIDE)[:, None] + STRIDE  # places of the scored ids in a window
        t = np.arange(2 * STRIDE)[None, :]
        self.gap = np.clip(s - t, 0, 2 * STRIDE - 1)
        self.future = t > s

    def gradient(self, x, valid, y, scored):
        """Mean negative log-likelihood of classes y where scored, and its gradient.

        x: rows of ids (B, 2 * STRIDE), valid: which are there; the classes after the last STRIDE of them are predicted.
        """
        p, n, last = self.p, max(1, int(scored.sum())), x[:, STRIDE:]
        k, v = p["k"].take(x, 0), p["v"].take(x, 0)
        scale = k.dtype.type(1 / math.sqrt(WIDTH))
        q = (p["q"] * scale).take(last, 0)
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += self._bias()
        some = np.flatnonzero(~valid.all(1))
        a[some] += np.where(valid[some], np.float32(0), np.float32(-1e9))[:, None, :]
        if not self._bounded():
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a /= np.maximum(np.matmul(a, _ones(a.shape[2])), np.float32(1e-37))  # an id that is not there may see none
        ctx = np.matmul(a, v)
        h = (ctx + p["h"].take(last, 0)).reshape(-1, WIDTH)
        z = h @ p["out"]
        z += p["bias"]
        if not self._bounded_output():
            z -= z.max(1, keepdims=True)
        spot = np.arange(len(z)) * z.shape[1] + y.ravel()
        got = z.take(spot)
        np.exp(z, out=z)
        total = z @ _ones(z.shape[1])
        loss = float(((np.log(total[:, 0]) - got) * scored.ravel()).sum()) / n
        z *= scored.reshape(-1, 1) / (total * total.dtype.type(n))
        z.ravel()[spot] -= scored.ravel() / z.dtype.type(n)
        g = {"out": h.T @ z, "bias": z.sum(0)}
        dh = (z @ p["out"].T).reshape(ctx.shape)
        ds = np.matmul(dh, v.transpose(0, 2, 1))
        ds -= (dh * ctx).sum(2, keepdims=True)
        ds *= a
        g["dist"] = np.bincount(self.gap.ravel(), weights=ds.sum(0).ravel(), minlength=2 * STRIDE)
        g["k"], g["v"] = _row_sums(x, np.matmul(ds.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), dh))
        g["q"], g["h"] = _row_sums(last, np.matmul(ds, k), dh)
        g["q"] *= scale
        return loss, g

    def _bias(self) -> np.ndarray:
        """Distance biases, the future masked."""
        out = self.p["dist"][self.gap]
        out[self.future] = -1e9
        return out

    def target_log(self, x: np.ndarray, fresh: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Natural log-probability of class goal (B, STRIDE) after each of the last STRIDE ids of x.

        fresh: windows at a text's start, whose first half is not there. The same sums as forward(), with fewer passes.
        """
        p = self.p
        last = x[:, STRIDE:]
        s = np.matmul(p["q"].take(last, 0), p["k"].take(x, 0).transpose(0, 2, 1))
        s *= np.float32(1 / math.sqrt(WIDTH))
        s += self._bias()
        s[fresh, :, :STRIDE] = -1e9
        if not self.tame:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        h = np.matmul(s, p["v"].take(x, 0))
        h /= np.matmul(s, _ones(s.shape[2]))  # sums by products: short rows are slow to reduce
        h += p["h"].take(last, 0)
        z = h.reshape(-1, WIDTH) @ p["out"]
        z += p["bias"]
        if not self.tame_output:
            z -= z.max(1, keepdims=True)
        got = z.take(np.arange(len(z)) * z.shape[1] + goal.ravel())
        np.exp(z, out=z)
        return (got - np.log(z @ _ones(z.shape[1])[:, 0])).reshape(goal.shape)

    def _bounded(self) -> bool:
        """No score can overflow exp in single precision."""
        p = self.p
        return _longest(p["q"], 1) * _longest(p["k"], 1) / math.sqrt(WIDTH) + float(np.abs(p["dist"]).max()) < 80

    def _bounded_output(self) -> bool:
        """Nor can a class's."""
        p = self.p
        return (_longest(p["v"], 1) + _longest(p["h"], 1)) * _longest(p["out"], 0) + float(np.abs(p["bias"]).max()) < 80

    tame, tame_output = functools.cached_property(_bounded), functools.cached_property(_bounded_output)  # once the weights stay

    def windows(self, begin: np.ndarray, ids: np.ndarray, end: int):
        """Blocks of all texts: input rows, which are there, places of the targets and which are there."""
        length = np.diff(begin)
        blocks = -(-length // STRIDE)
        text = np.repeat(np.arange(len(length)), blocks)
        at = (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STRIDE
        return text, at, length

    def batch(self, ids, begin, text, at, length, end):
        place = at[:, None] + np.arange(-STRIDE, STRIDE)[None, :]  # target places; the input is the id before
        source = begin[text][:, None] + place - 1
        inp = np.where(place > 0, ids[np.clip(source, 0, len(ids) - 1)], end)
        valid = (place >= 0) & (place < length[text][:, None])
        valid[:, STRIDE] = True
        target = np.clip(source + 1, 0, len(ids) - 1)[:, STRIDE:]
        return self.row[inp], valid, target, valid[:, STRIDE:]

    def fit(self, ids: np.ndarray, begin: np.ndarray, end: int, steps: int = STEPS, seed: int = 1) -> AttentionModel:
        """Adam over random windows of the sample."""
        r = np.random.default_rng(seed)
        text, at, length = self.windows(begin, ids, end)
        if not len(text):
            return self

        def draw():
            pick = r.integers(0, len(text), BATCH)
            x, valid, target, scored = self.batch(ids, begin, text[pick], at[pick], length, end)
            return x, valid, self.klass[ids[target]], scored

        self._adam([draw] * steps, lambda step: 0.02 * min(1.0, 2 * (1 - step / (steps + 1))))
        return self

    def learn(self, seq: np.ndarray, end: int, part: int) -> None:
        """Adam once over the rows, those of part `part` of ROUNDS: 2 * STRIDE + 1 ids, -1 where there is none, end + 1 before a text's first; the last STRIDE are scored."""
        batches = [seq[i : i + LESSON] for i in range(0, len(seq), LESSON)]

        def draw(rows):
            inp, goal = rows[:, :-1], rows[:, STRIDE + 1 :]
            scored = (goal >= 0) & (goal <= end)
            return self.row.take(np.where((inp >= 0) & (inp <= end), inp, end)), inp >= 0, self.klass.take(np.where(scored, goal, end)), scored

        turns = len(batches) * ROUNDS
        self._adam([functools.partial(draw, x) for x in batches], lambda step: 0.01 * (1 - (part * len(batches) + step) / (turns + 1)))

    def _adam(self, draws: list, pace) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step, draw in enumerate(draws, 1):
            _, g = self.gradient(*draw())
            rate, late, wide = pace(step), 1 - 0.9**step, math.sqrt(1 - 0.98**step)
            for k, x in g.items():
                x = x.astype(np.float32, copy=False)
                m[k] *= np.float32(0.9)
                m[k] += np.float32(0.1) * x
                s[k] *= np.float32(0.98)
                s[k] += np.float32(0.02) * x * x
                move = np.sqrt(s[k])
                move *= np.float32(1 / wide)
                move += np.float32(1e-8)
                np.divide(m[k], move, out=move)
                move *= np.float32(rate / late)
                self.p[k] -= move

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float32)

    def unflat(self, line: np.ndarray) -> None:
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k], line = line[:n].reshape(self.p[k].shape).astype(np.float32), line[n:]

    def score(self, ids: np.ndarray, begin: np.ndarray, end: int, size: int = 1024) -> np.ndarray:
        """log10 probability of each text's ids; every id is scored in exactly one window."""
        text, at, length = self.windows(begin, ids, end)
        out = np.zeros(len(length))
        rows, klass, share = self.row[ids], self.klass[ids], self.share[ids]
        steps = np.arange(-STRIDE, STRIDE)
        top = len(ids) - 1
        for lo in range(0, len(text), size):
            t, a = text[lo : lo + size], at[lo : lo + size]
            goal = np.minimum((begin[t] + a)[:, None] + steps[None, STRIDE:], top)
            source = np.clip((begin[t] + a)[:, None] + steps[None, :] - 1, 0, top)
            x = rows.take(source)
            x[a == 0, STRIDE] = self.row[end]
            x[a == STRIDE, 0] = self.row[end]  # stands before a text's first id
            got = self.target_log(x, a == 0, klass.take(goal)) / math.log(10) + share.take(goal)
            there = a[:, None] + steps[None, STRIDE:] < length[t][:, None]
            out += np.bincount(t, weights=(got * there).sum(1), minlength=len(length))
        return out


# ---- passes over the documents ----------------------------------------------------------------


def _chunked(batches):
    """Rows as they come, dealt into chunks; a chunk's number depends only on partition and place in it."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    for batch in batches:
        lo = 0
        text = batch.column(1)
        sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)) if batch.num_rows else np.zeros(0)
        ends = np.cumsum(sizes)
        while lo < batch.num_rows:
            past = ends[lo - 1] if lo else 0
            hi = min(lo + CHUNK_ROWS, max(lo + 1, int(np.searchsorted(ends, past + CHUNK_CHARS, "right"))), batch.num_rows)
            yield number, batch.slice(lo, hi - lo)
            number += 1
            lo = hi


def _chunk_words(text: pa.Array) -> Words:
    """All words of a chunk at once."""
    got = list(words(text, chunk=1 << 62))
    return got[0]


def _add_chunk(batches):
    for number, part in _chunked(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, number)), part.column(0), part.column(1)], names=["chunk", "doc_id", "text"])


def _counter(path: str):
    """Distinct words of each chunk with their training count (kind 0), and subword counts (kind 1)."""

    def count(batches):
        subwords = Subwords(path)
        ids_total = np.zeros(subwords.end + 1, np.int64)
        for number, part in _chunked(batches):
            w = _chunk_words(part.column(1))
            train = np.array([not is_held_out(i) for i in part.column(0).to_pylist()])
            uniq, where, inv = np.unique(w.hash, return_index=True, return_inverse=True)
            n = np.bincount(inv, weights=np.repeat(train, np.diff(w.first)), minlength=len(uniq)).astype(np.int64)
            flat, first = subwords.of(w, where)
            ids_total += np.bincount(flat, weights=np.repeat(n, np.diff(first)), minlength=len(ids_total)).astype(np.int64)
            ids_total[subwords.end] += int(train.sum())
            keys = np.append(uniq, END).view(np.int64)
            yield _kinds(0, number, keys, np.append(n, int(train.sum())))
        some = np.flatnonzero(ids_total)
        yield _kinds(1, 0, some, ids_total[some])

    return count


def _distinct(head: np.ndarray):
    """Each chunk's distinct words that are not in the (sorted) head (kind 0), and a fingerprint of all (kind 1)."""

    def distinct(batches):
        for number, part in _chunked(batches):
            keys = np.unique(np.append(_chunk_words(part.column(1)).hash, END))
            mark = _fingerprint(keys)
            keys = np.append(keys[~_among(keys, head)], mark).view(np.int64)
            kind = np.zeros(len(keys), np.int8)
            kind[-1] = 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number)), pa.array(keys), pa.array(kind)], names=["chunk", "key", "kind"])

    return distinct


def _fingerprint(keys: np.ndarray) -> np.uint64:
    return mix(np.add.reduce(mix(keys), keepdims=True, dtype=np.uint64))[0]


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _kinds(kind, chunk, key, n):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(np.full(len(key), chunk, np.int64)), pa.array(key), pa.array(n)], names=["kind", "chunk", "key", "n"])


def _scorer(model: AttentionModel, path: str, total: int, distinct: int, head: np.ndarray, head_counts: np.ndarray):
    bottom = math.log10(total + 0.1 * (distinct + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        subwords = _shared_subwords(path)
        keys, counts = right.column("key").to_numpy().view(np.uint64), right.column("c").to_numpy()
        marks = keys[counts < 0]
        keys, counts = np.concatenate([keys[counts >= 0], head]), np.concatenate([counts[counts >= 0], head_counts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        text = left.column("text").combine_chunks()
        text = text if isinstance(text, pa.Array) else text.chunk(0)
        n = left.num_rows

        def known(h):
            if not len(keys):
                return np.zeros(len(h), np.int64)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[at] == h, counts[at], 0)

        end_count = int(known(np.array([END]))[0])
        base, tokens, seen, model_score = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        every = [np.array([END])]
        for w in words(text):
            uniq, where, inv = np.unique(w.hash, return_index=True, return_inverse=True)
            every.append(uniq)
            c = known(uniq)
            owner = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))
            size = w.hi - w.lo
            base[w.lo : w.hi] = np.bincount(owner, weights=np.log10(c + 0.1)[inv] if len(inv) else None, minlength=size)
            seen[w.lo : w.hi] = np.bincount(owner, weights=(c > 0)[inv] if len(inv) else None, minlength=size)
            tokens[w.lo : w.hi] = np.diff(w.first)
            ids, begin = subwords.sequences(w, (where, inv))
            model_score[w.lo : w.hi] = model.score(ids, begin, subwords.end)
        if not len(marks) or marks[0] != _fingerprint(np.unique(np.concatenate(every))):
            raise RuntimeError("a chunk's answers are for other words: the documents came in another order; read them from files or checkpoint them")
        base += math.log10(end_count + 0.1) - (tokens + 1) * bottom
        return pa.table({
            "doc_id": left.column("doc_id"), "n_tokens": tokens + 1, "n_known": seen + int(end_count > 0),
            "train_tokens": np.full(n, total, np.int64), "base_score": base, "score": model_score,
        })

    return score


@functools.cache
def _shared_subwords(path: str) -> Subwords:
    return Subwords(path)


def _sample(d: DataFrame, texts: int) -> list[str]:
    """Passages of the SAMPLE_TEXTS filled training texts of the smallest hashes; texts is the number of training texts.

    Only rows below a hash that about twice as many texts pass are sorted: else every task would send the
    driver its own SAMPLE_TEXTS rows. The bound is raised where empty texts or equal ids leave too few.
    """
    h, share = F.xxhash64("doc_id"), min(1.0, 2 * SAMPLE_TEXTS / max(texts, 1))
    passage = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, text), greatest(length(text) - {PASSAGE}, 1)) as int), {PASSAGE})").alias("text")
    train = d.where(~_held_out(F.col("doc_id")) & (F.length("text") > 0))
    while True:
        some = train.where(h < int((share - 0.5) * 2**64)) if share < 1 else train
        rows = some.select(passage, h.alias("h"), "doc_id").orderBy("h", "doc_id").limit(SAMPLE_TEXTS).collect()
        if len(rows) == SAMPLE_TEXTS or share == 1:
            return [r.text for r in rows]
        share = min(1.0, 8 * share)


def _windower(path: str, part: int | None = None):
    """All windows of the training texts (of one of ROUNDS parts of the texts): every id is a target of one window.

    Blocks of STRIDE targets are laid from a text's end, so that only its first window can lack ids. A row has the windows of one
    started STRETCH characters: order (a hash), ids as int32.
    """

    def cut(batches):
        subwords = _shared_subwords(path)
        for batch in batches:
            texts, seeds = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if is_held_out(i):
                    continue
                seed = zlib.crc32(t[:PASSAGE].encode("utf-8", "replace"), zlib.crc32(str(i).encode()))
                if part is None or seed % ROUNDS == part:
                    texts.append(t)
                    seeds.append(seed)
            if not texts:
                continue
            for w in words(pa.array(texts, pa.string())):
                ids, begin = subwords.sequences(w)
                length = np.diff(begin)
                blocks = -(-length // STRIDE)
                text = np.repeat(np.arange(len(length)), blocks)
                turn = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                place = (length[text] - STRIDE * (blocks[text] - turn))[:, None] + np.arange(-STRIDE - 1, STRIDE)[None, :]
                out = np.where(place >= 0, ids.take(np.maximum(begin[text][:, None] + place, 0)), -1).astype(np.int32)
                out[place == -1] = subwords.end + 1  # before a text's first id stands the end id, which is no target there
                stretches = np.minimum(blocks, np.maximum(1, [-(-len(t) // STRETCH) for t in texts[w.lo : w.hi]]))
                owner = np.repeat(np.arange(len(length)), stretches)
                turn = np.arange(int(stretches.sum())) - np.repeat(np.cumsum(stretches) - stretches, stretches)
                first = (np.cumsum(blocks) - blocks)[owner] + turn * blocks[owner] // stretches[owner]
                ends = np.append(first[1:], len(out))
                key = mix((np.array(seeds[w.lo : w.hi], np.uint64)[owner] << np.uint64(32)) + turn.astype(np.uint64)) >> np.uint64(1)
                rows = [out[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(rows, pa.binary())], names=["key", "ids"])

    return cut


def _learner(model: AttentionModel, start: np.ndarray, part: int, end: int, path: str):
    """A task's texts of one part: each group of windows changes a copy of the model; sums of the changes and of the windows behind them, by part of the weights."""

    def learn(batches):
        change, weight = np.zeros(len(start)), np.zeros(len(start))

        def group(seq):
            seq = seq[np.random.default_rng(len(seq)).permutation(len(seq))]
            model.unflat(start)
            model.learn(seq, end, part)
            moved = model.flat() - start
            change[:] += moved * float(len(seq))
            weight[:] += (moved != 0) * float(len(seq))

        kept, size = [], 0
        for batch in _windower(path, part)(batches):
            for line in batch.column(1):
                kept.append(np.frombuffer(line.as_buffer(), np.int32).reshape(-1, 2 * STRIDE + 1))
                size += len(kept[-1])
                if size >= GROUP:
                    group(np.concatenate(kept))
                    kept, size = [], 0
        if kept:
            group(np.concatenate(kept))
        task = TaskContext.get()
        g = np.full(PARTS, task.partitionId() if task else 0)
        lines = lambda x: pa.array([y.tobytes() for y in np.array_split(x, PARTS)], pa.binary())
        if weight.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(g.astype(np.int64)), lines(change), lines(weight)], names=["part", "g", "change", "weight"])

    return learn


def _mean_change(group: pa.Table) -> pa.Table:
    """Of one part of the weights, over the windows that changed each."""
    total, n = 0.0, 0.0
    rows = group.sort_by("g")
    for x, w in zip(rows.column("change"), rows.column("weight")):
        total, n = total + np.frombuffer(x.as_py()), n + np.frombuffer(w.as_py())
    return pa.table({"part": group.column("part").slice(0, 1), "change": pa.array([(total / np.maximum(n, 1)).astype(np.float32).tobytes()], pa.binary())})


def _teach(model: AttentionModel, docs: DataFrame, end: int, path: str) -> None:
    """ROUNDS times: every group of windows of a part of the texts changes a copy of the model; each weight moves by the mean of its changes."""
    for part in range(ROUNDS):
        start = model.flat()
        moved = docs.mapInArrow(_learner(model, start, part, end, path), "part int, g long, change binary, weight binary")
        got = moved.groupBy("part").applyInArrow(_mean_change, "part int, change binary").collect()
        if got:
            model.unflat(start + np.concatenate([np.frombuffer(r.change, np.float32) for r in sorted(got, key=lambda r: r.part)]))


def lm_scores(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words and one end a text are the tokens of the base score, an add-0.1 unigram over the rows whose
    crc32(doc_id as text) mod 10 is not 0; score is the attention model's log10 probability of the text's
    subword ids and end. Null and empty texts are just an end. Every row gives one row; a null
    doc_id counts as training. Other columns are ignored; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    d = small_batches(docs, CHUNK_ROWS).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = d.mapInArrow(_counter(path), "kind byte, chunk long, key long, n long")
    counts = checkpoint(counted.groupBy("kind", "key").agg(F.sum("n").alias("c")).where("c > 0"))
    total, distinct = counts.where("kind = 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = Subwords(path).end
    id_counts = np.zeros(end + 1, np.int64)
    for r in counts.where("kind = 1").collect():  # at most one row an id of the vocabulary
        id_counts[r.key] = r.c
    model = AttentionModel(id_counts)
    texts = _sample(d, int(counts.where("kind = 0").where(F.col("key") == int(END.view(np.int64))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]))
    if texts:
        ids, begin = Subwords(path).sequences(_chunk_words(pa.array(texts)))
        last = max(1, int(np.searchsorted(begin, SAMPLE_IDS, "right")) - 1)
        model.fit(ids[: begin[last]], begin[: last + 1], end)
        _teach(model, d, end, path)
    common = counts.where("kind = 0").where(F.col("c") > int(total) // HEAD).select("key", "c").collect()  # fewer than HEAD
    head, head_counts = np.array([r.key for r in common], np.int64).view(np.uint64), np.array([r.c for r in common], np.int64)
    order = np.argsort(head)
    head, head_counts = head[order], head_counts[order]
    need = d.mapInArrow(_distinct(head), "chunk long, key long, kind byte")
    answers = need.join(counts.where("kind = 0").select("key", "c"), "key", "left").where("c is not null or kind = 1")
    answers = answers.select("chunk", "key", F.when(F.col("kind") == 1, F.lit(-1)).otherwise(F.col("c")).alias("c"))
    parts = d.mapInArrow(_add_chunk, "chunk long, doc_id long, text string")
    out = parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _scorer(model, path, int(total), int(distinct), head, head_counts), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
