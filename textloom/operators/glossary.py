"""Glossary overrides and kept terms: one multi-pattern automaton for all terms, sent to the tasks that read the texts.

Terms are matched by an Aho-Corasick automaton held in numpy arrays. A task lays texts of an Arrow batch end to end, SLICE_CHARS at once, cuts
the line into lanes that overlap by the longest term, and advances all lanes one character at a time, so the
cost is that of the characters and not of the terms, and its arrays are those of a slice and not of a batch. There is no shuffle.

At most MAX_TERMS rows of a glossary are collected; more raise. Up to DENSE cells the automaton is a full table
of states by letters, beyond that sorted keys that are searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.slices import slices

MAX_TERMS = 200_000
DENSE = 1 << 23
LANES = 4096
SLICE_CHARS = 1 << 20  # of the texts that are laid end to end at once; a longer text is a slice of its own
CODES = 0x110000
SPANS = "array<struct<start:long,end:long,term:long>>"
TOTALS = "struct<n:long,covered:long,first:long>"


def fold(c: str) -> str:
    """A character without case, as one character."""
    for other in (c.casefold(), c.lower()):
        if len(other) == 1:
            return other
    return c


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Letters:
    """What is known of each character met so far, by its code: its folded form, and whether it belongs to words."""

    def __init__(self):
        self.met, self.word = np.zeros(CODES, bool), np.zeros(CODES, bool)
        self.folded = np.zeros(CODES, np.uint32)

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(folded codes, whether \\w) of codes."""
        for code in np.unique(codes[~self.met[codes]]).tolist():
            c = chr(code)
            self.met[code], self.folded[code], self.word[code] = True, ord(fold(c)), c.isalnum() or c == "_"
        return self.folded[codes], self.word[codes]


class Automaton:
    """All places of many terms in many texts, case folded; terms are given by their place in the list."""

    def __init__(self, terms: list[str], dense: int = DENSE):
        self.lengths = np.array([len(t) for t in terms], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        folded = ["".join(map(fold, t)) for t in terms]
        letters = sorted(set("".join(folded)))
        self.letter = np.zeros(CODES, np.int32)  # class 0 is any other letter
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: i + 1 for i, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, term in enumerate(folded):
            state = 0
            for c in term:
                nxt = children[state].get(number[c])
                if nxt is None:
                    nxt = children[state][number[c]] = len(children)
                    children.append({})
                    ends.append([])
                state = nxt
            if term:
                ends[state].append(i)
        # breadth first: a state's moves are those of its fallback, overlaid with its own
        fallback, moves, queue = [0] * len(children), [dict(children[0])] + [{}] * (len(children) - 1), list(children[0].values())
        for state in queue:
            moves[state] = moves[fallback[state]] | children[state]
            ends[state] = ends[state] + ends[fallback[state]]
            for c, nxt in children[state].items():
                fallback[nxt] = moves[fallback[state]].get(c, 0)
                queue.append(nxt)
        self.classes = len(letters) + 1
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
        self.found = np.array([i for e in ends for i in e], np.int64)
        self.table = self.keys = None
        if len(children) * self.classes <= dense:
            self.table = np.zeros((len(children), self.classes), np.int32)
            for state, m in enumerate(moves):
                self.table[state, list(m)] = list(m.values())
        else:
            root = moves[0]
            self.root = np.zeros(self.classes, np.int64)
            self.root[list(root)] = list(root.values())
            pairs = sorted((s * self.classes + c, n) for s, m in enumerate(moves) for c, n in m.items() if root.get(c, 0) != n)
            self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
            self.values = np.array([n for _, n in pairs] or [0], np.int64)

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state, letter]
        key = state.astype(np.int64) * self.classes + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.root[letter])

    def scan(self, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, term) of every match in one line of folded codes, by end; terms may overlap."""
        n = len(folded)
        letter = self.letter[folded]
        size = max(-(-n // LANES), 1)
        lanes = -(-n // size)
        before = min(self.longest - 1, n)  # a lane warms up on what stands before it
        letter = np.concatenate([np.zeros(before, letter.dtype), letter, np.zeros(lanes * size - n, letter.dtype)])
        start = np.arange(lanes) * size
        state, ends, states = np.zeros(lanes, np.int64), [], []
        final = np.diff(self.first) > 0
        for k in range(before + size):
            state = self._step(state, letter[start + k])
            if k >= before and (hit := np.flatnonzero(final[state])).size:
                ends.append(start[hit] + k - before)
                states.append(state[hit])
        if not ends:
            return (np.zeros(0, np.int64),) * 3
        end, state = np.concatenate(ends), np.concatenate(states).astype(np.int64)
        count = self.first[state + 1] - self.first[state]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        term = self.found[np.repeat(self.first[state], count) + offset]
        end = np.repeat(end, count) + 1
        order = np.argsort(end, kind="stable")
        return (end - self.lengths[term])[order], end[order], term[order]


def laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one line of codes, parted by a sign that is in no word, and where each starts; one start more closes the last."""
    return _codes("\x00" + "".join(t + "\x00" for t in texts)), np.cumsum([1] + [len(t) + 1 for t in texts])


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place in it) of the members of groups of these sizes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Matcher:
    """Matches of a list of terms in a batch of texts: whole words or anywhere, with or without case for each term."""

    def __init__(self, terms: list[str], exact: list[bool], whole_words: bool, dense: int = DENSE):
        self.terms, self.exact, self.whole = terms, np.array(exact, bool), whole_words
        self.plain = np.array(["".join(map(fold, t)) == t for t in terms], bool)
        self.automaton, self.letters = Automaton(terms, dense), _Letters()
        self.codes, self.begin = _codes("".join(terms)), np.cumsum([0] + [len(t) for t in terms])

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end, term) of all matches; places are code points of their text. In no order but that of ends within a text."""
        line, starts = laid(texts)
        text, start, end, term = self.find_laid(line, starts)
        return text, start - starts[text], end - starts[text], term

    def find_laid(self, line: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """find() in texts that were laid(); places are those of the line."""
        folded, word = self.letters.look(line)
        start, end, term = self.automaton.scan(folded)
        text = np.searchsorted(starts, start, "right") - 1
        keep = (text >= 0) & (end < starts[np.minimum(text + 1, len(starts) - 1)])  # a term with the parting sign in it does not reach over
        if self.whole:
            keep &= (word[start] != word[start - 1]) & (word[end - 1] != word[np.minimum(end, len(line) - 1)])
        changed = np.concatenate([[0], np.cumsum(line != folded)])
        keep &= ~(self.exact[term] & self.plain[term] & (changed[end] > changed[start]))
        text, start, end, term = text[keep], start[keep], end[keep], term[keep]
        unsure = np.flatnonzero(self.exact[term] & ~self.plain[term])  # terms with capitals, to be met as they are written
        owner, inside = _spread(end[unsure] - start[unsure])
        other = line[start[unsure][owner] + inside] != self.codes[self.begin[term[unsure]][owner] + inside]
        wrong = unsure[np.bincount(owner[other], minlength=len(unsure)) > 0]
        if len(wrong):
            text, start, end, term = (np.delete(x, wrong) for x in (text, start, end, term))
        return text, start, end, term

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, term) for each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for t, *span in zip(*(x.tolist() for x in self.find(texts))):
            out[t].append(tuple(span))
        return out


class Overrides:
    """Entries (term, translation, case_sensitive) applied as if one after another: longest term first, then in given order.

    A whole-word match of a term is replaced; what a longer term has replaced is not the text of a shorter one any more, but a
    replacement may bring a shorter term in or change what stands at a word's edge. Entries whose target can do so are marked, and a
    text that holds one is replaced term by term; all other texts are replaced in one pass over their matches.
    """

    def __init__(self, entries: list[tuple[str, str, bool]], reverse: bool = False, dense: int = DENSE):
        ordered = sorted((e for e in entries if e[0] and e[1]), key=lambda e: -len(e[0]))
        self.source = [e[1] if reverse else e[0] for e in ordered]
        self.target = [e[0] if reverse else e[1] for e in ordered]
        self.exact = [bool(e[2]) for e in ordered]
        self.matcher = Matcher(self.source, self.exact, True, dense)
        self.risky = self._risky()
        self.sizes = np.array([len(t) for t in self.target], np.int64)
        self.codes, self.begin = _codes("".join(self.target)), np.cumsum(self.sizes) - self.sizes

    def _risky(self) -> np.ndarray:
        """Whether a target holds a term, is part of one, begins or ends as one ends or begins, or has other edges than its term."""
        folded = lambda s: "".join(map(fold, s))
        word = lambda c: c.isalnum() or c == "_"
        sources, targets = [folded(s) for s in self.source], [folded(t) for t in self.target]
        heads = {s[:k] for s in sources for k in range(1, len(s) + 1)}
        tails = {s[-k:] for s in sources for k in range(1, len(s) + 1)}
        longest = max(map(len, sources), default=0)
        inside = Matcher(self.source, [False] * len(self.source), False).spans(self.target) if self.source else []
        within = Matcher(self.target, [False] * len(self.target), False).spans(self.source) if self.source else []
        part = {k for found in within for _, _, k in found}
        out = np.zeros(len(targets), bool)
        for i, (t, s) in enumerate(zip(targets, self.source)):
            edges = word(t[0]) == word(s[0]) and word(t[-1]) == word(s[-1])
            joins = any(t[-k:] in heads or t[:k] in tails for k in range(1, min(len(t), longest) + 1))
            out[i] = not edges or bool(inside[i]) or joins or i in part
        return out

    def _one_by_one(self, text: str) -> tuple[str, int]:
        count = 0
        for source, target, exact in zip(self.source, self.target, self.exact):
            text, n = re.subn(rf"\b{re.escape(source)}\b", lambda _, t=target: t, text, flags=0 if exact else re.IGNORECASE)
            count += n
        return text, count

    def _replaced(self, line: np.ndarray, start: np.ndarray, end: np.ndarray, term: np.ndarray, marks: np.ndarray) -> tuple[str, np.ndarray]:
        """The line with its matches (ascending, apart) replaced, and where the places in marks, none inside a match, have moved."""
        size = self.sizes[term]
        shift = np.concatenate([[0], np.cumsum(size - (end - start))])  # of what stands behind so many matches
        stay = np.ones(len(line), bool)
        owner, inside = _spread(end - start)
        stay[start[owner] + inside] = False
        place = np.flatnonzero(stay)
        out = np.empty(len(line) + int(shift[-1]), np.uint32)
        out[place + shift[np.searchsorted(end, place, "right")]] = line[place]
        owner, inside = _spread(size)
        out[(start + shift[:-1])[owner] + inside] = self.codes[self.begin[term[owner]] + inside]
        return out.tobytes().decode("utf-32-le", "surrogatepass"), marks + shift[np.searchsorted(end, marks, "right")]

    def apply(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """(replaced texts, replacements in each)."""
        if not texts or not self.source:
            return list(texts), [0] * len(texts)
        line, starts = laid(texts)
        text, start, end, term = self.matcher.find_laid(line, starts)
        risky = np.bincount(text[self.risky[term]], minlength=len(texts)) > 0
        sure = ~risky[text]
        start, end, term = _first_held(start[sure], end[sure], term[sure])
        counts = np.bincount(np.searchsorted(starts, start, "right") - 1, minlength=len(texts)).tolist()
        new, moved = self._replaced(line, start, end, term, starts)
        out = [new[a : b - 1] for a, b in zip(moved[:-1].tolist(), moved[1:].tolist())]
        for i in np.flatnonzero(risky).tolist():
            out[i], counts[i] = self._one_by_one(texts[i])
        return out, counts

def _first_held(start: np.ndarray, end: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches in order of their start without those that meet one of an earlier term, or of the same term further left, that stays."""
    order = np.lexsort((term, start))
    start, end, term = start[order], end[order], term[order]
    if not len(start):
        return start, end, term
    past = np.maximum.accumulate(end)
    meets = np.concatenate([[False], start[1:] < past[:-1]])  # begins inside one before it
    held = ~(meets | np.concatenate([meets[1:], [False]]))  # alone
    group = np.cumsum(~meets)
    some = np.flatnonzero(~held)
    own: list[tuple[int, list]] = []
    for g, k, a, b, i in zip(group[some].tolist(), term[some].tolist(), start[some].tolist(), end[some].tolist(), some.tolist()):
        if not own or own[-1][0] != g:
            own.append((g, []))
        own[-1][1].append((k, a, b, i))
    for _, members in own:
        taken: list[tuple[int, int]] = []
        for _, a, b, i in sorted(members):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                held[i] = True
    return start[held], end[held], term[held]


def _collected(entries: DataFrame, *columns: str) -> list:
    """The rows of a glossary, at most MAX_TERMS; in the order of seq where it has one, else of its columns."""
    order = ["seq", *columns] if "seq" in entries.columns else list(columns)
    rows = entries.orderBy(*order).select(*columns).limit(MAX_TERMS + 1).collect()  # one pass over what the entries are made from
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a glossary of more than {MAX_TERMS} rows; at most so many are sent to tasks")
    return rows


def override(df: DataFrame, entries: DataFrame, column: str = "text", reverse: bool = False) -> DataFrame:
    """df with column replaced by the glossary's entries (term, translation, case_sensitive; seq: their order), and replacements (long).

    Terms are whole words, matched with or without case as their entry says; of entries that share a term (without case, where
    neither is case sensitive) the last one holds. reverse replaces translations by terms. Order is by length of the term in
    both directions. Entries without term or translation are left out; null texts stay null with 0 replacements.
    """
    last: dict[str, tuple[str, str, bool]] = {}
    for term, translation, exact in _collected(entries, "term", "translation", "case_sensitive"):
        term, translation = (term or "").strip(), (translation or "").strip()
        if term and translation:
            last[term if exact else term.lower()] = (term, translation, bool(exact))
    if not last:
        return df.withColumn("replacements", F.lit(0).cast("long"))
    sent = df.sparkSession.sparkContext.broadcast(Overrides(list(last.values()), reverse))
    return _with_texts(df, column, sent, "replacements long", _applied)


def _applied(overrides: Overrides, texts: list[str]) -> tuple[list[str], pa.Array]:
    new, counts = overrides.apply(texts)
    return new, pa.array(counts, pa.int64())


def _kept(terms: DataFrame) -> list[str]:
    return sorted({t for (t,) in _collected(terms.select("term").where("term != ''").distinct(), "term")}, key=lambda t: (-len(t), t))


def term_spans(df: DataFrame, terms: DataFrame, column: str = "text") -> DataFrame:
    """df with spans: every place of the terms (column term) in a text, as they are written and inside words too: start and end in
    code points, the end exclusive, and the term's place among the distinct terms, longest first and then in alphabetical order. Null texts have none."""
    found = _kept(terms)
    if not found:
        return df.withColumn("spans", F.array().cast(SPANS))
    sent = df.sparkSession.sparkContext.broadcast(Matcher(found, [True] * len(found), False))

    def lists(m: Matcher, texts: list[str]) -> tuple[None, pa.Array]:
        text, start, end, term = m.find(texts)
        order = np.lexsort((term, end, start, text))
        fields = pa.StructArray.from_arrays([pa.array(x[order]) for x in (start, end, term)], names=["start", "end", "term"])
        return None, pa.ListArray.from_arrays(pa.array(np.searchsorted(text[order], np.arange(len(texts) + 1)), pa.int32()), fields)

    return _with_texts(df, column, sent, f"spans {SPANS}", lists)


def term_totals(df: DataFrame, terms: DataFrame, column: str = "text") -> DataFrame:
    """df with totals of the places that term_spans() lists: n, covered (sum of their lengths) and first (the smallest start, null without any)."""
    found = _kept(terms)
    if not found:
        return df.withColumn("totals", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("covered"), F.lit(None).cast("long").alias("first")))
    sent = df.sparkSession.sparkContext.broadcast(Matcher(found, [True] * len(found), False))

    def totals(m: Matcher, texts: list[str]) -> tuple[None, pa.Array]:
        text, start, end, _ = m.find(texts)
        n, covered = np.bincount(text, minlength=len(texts)), np.bincount(text, weights=end - start, minlength=len(texts))
        first = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(first, text, start)
        return None, pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(covered.astype(np.int64)), pa.array(first, mask=n == 0)], names=["n", "covered", "first"])

    return _with_texts(df, column, sent, f"totals {TOTALS}", totals)


def _with_texts(df: DataFrame, column: str, sent, more: str, run) -> DataFrame:
    """df with one more column, and maybe new texts, made by run(sent value, texts) a slice of a batch at a time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    place = [f.name for f in df.schema.fields].index(column)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value
        for batch in batches:
            for part in slices(batch, place, SLICE_CHARS):
                texts = part.column(place).to_pylist()
                new, extra = run(value, [t or "" for t in texts])
                arrays = list(part.columns)
                if new is not None:
                    arrays[place] = pa.array([None if old is None else t for old, t in zip(texts, new)], part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays([*arrays, extra], names=[*part.schema.names, more.split()[0]])

    return df.mapInArrow(rows, f"{schema}, {more}")
