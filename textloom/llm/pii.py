"""Personal data by fixed patterns and by a semi-Markov conditional random field.

Base spans come from four patterns over the whole text. The model adds spans: white-space tokens that hold
a digit, an @ or a secret's keyword form islands, with two tokens of context on each side; inside an
island a segment of at most MAX_TOKENS tokens is scored as a whole by features of its span, and
bounded-entity dynamic programming chooses boundaries and kinds jointly. Tokens outside
islands hold nothing an entity could consist of, so leaving them out changes no result.

The model is trained on generated labelled lines by its log-likelihood; no corpus rows are needed.
A model span that overlaps a base span is left out, so base spans always stay.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import small_batches
from textloom.llm._text import Words, words

BASE_KINDS = ["email", "ip", "card", "phone"]
MODEL_KINDS = ["email", "ip", "card", "phone", "secret", "iban", "ssn"]
KIND_ORDER = [*BASE_KINDS, "iban", "secret", "ssn"]
MAX_TOKENS = 9  # an IBAN of 34 characters in fours, the longest form the features accept
CONTEXT = 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the runs are possessive and start at a run's start: the same leftmost matches, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches that pass their check."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # no match can reach back over this @
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- the model -------------------------------------------------------------------------------

_EDGE = "\"'`,.;:!?()[]{}<>|*"
_KEY = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b")
_ASSIGN = re.compile(r"(?i)^(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?[^\s\"']{6,}[\"']?$")
_EMAILISH = re.compile(r"(?i)^[a-z0-9._%+-]+\s*(?:@|\(at\)|\[at\]|\sat\s)\s*[a-z0-9-]+(?:\s*(?:\.|\(dot\)|\[dot\]|\sdot\s)\s*[a-z0-9-]+)+$")
_PHONEISH = re.compile(r"^\+?[0-9(][0-9().\s/-]*[0-9]$")
_IPISH = re.compile(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?$")
_IBANISH = re.compile(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?$")
_SSNISH = re.compile(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
_CUES = {
    "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "telephone": "phone", "ssn": "ssn", "social": "ssn",
    "iban": "iban", "account": "iban", "card": "card", "visa": "card", "mail": "email", "email": "email", "contact": "email", "ip": "ip",
    "host": "ip", "key": "secret", "token": "secret", "password": "secret", "credential": "secret",
}


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """Edge punctuation is not part of a span, but for brackets that close inside and quotes that pair."""
    while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    while end > start and text[end - 1] in _EDGE and not (text[end - 1] in "\"'" and text[end - 1] in text[start : end - 1]) and not (text[end - 1] in ")]" and {")": "(", "]": "["}[text[end - 1]] in text[start : end - 1]):
        end -= 1
    return start, end


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(span: str, left: str, tokens: int) -> tuple[str, ...]:
    """Features of a whole candidate span and of the word before it."""
    d = _digits(span)
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", span[:64]))))[:16]
    out = [f"t{tokens}", f"s:{shape}"]
    out.append(f"d{min(20, len(d))}" if d else "d0")
    if len(span) == len(d):
        out.append("alldigits")
    if 13 <= len(d) <= 19 and re.fullmatch(r"[0-9](?:[ -]?[0-9])+", span):
        out.append("luhn" if luhn(d) else "noluhn")
    if _IPISH.match(span):
        out.append("ip" if _octets(span.split(":")[0]) else "badip")
    if _EMAILISH.match(span):
        out.append("email")
    if _PHONEISH.match(span) and 9 <= len(d) <= 15:
        out.append("phone+" if span[0] == "+" else "phone(" if span[0] == "(" else "phone-" if re.search(r"[0-9][ .-][0-9]{3}", span) else "phone?")
    if _SSNISH.match(span):
        out.append("ssn" if span[:3] not in ("000", "666") and span[0] != "9" else "badssn")
    if _IBANISH.match(span):
        out.append("iban" if _iban_ok(span) else "badiban")
    if _ASSIGN.match(span):
        out.append("assign")
    elif _KEY.search(span):
        out.append("keyword")
    if tokens == 1:
        if re.fullmatch(r"A[KS]IA[0-9A-Z]{16}", span):
            out.append("awskey")
        elif re.fullmatch(r"(?:gh[pousr]_|sk[-_]|xox[bp]-|glpat-)[A-Za-z0-9_-]{16,}", span):
            out.append("vendorkey")
        elif re.fullmatch(r"[0-9a-f]{32,}", span) and d:
            out.append("hex")
    cue = _CUES.get(left.strip(_EDGE + "=").lower())
    if cue:
        out.append(f"cue:{cue}")
    return tuple(out)


def _candidates(text: str, bounds: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int, tuple[str, ...]]]:
    """(first, last + 1 token): span and features, of segments that start and end on a telling token."""
    telling = [any(c.isascii() and c.isdigit() or c == "@" for c in text[s:e]) for s, e in bounds]
    keyed = [bool(_KEY.match(text[s:e].lstrip(_EDGE))) for s, e in bounds]
    out = {}
    for i in range(len(bounds)):
        for j in range(i + 1, min(len(bounds), i + MAX_TOKENS) + 1):
            if not any(telling[i:j]) and not keyed[i]:
                email = j - i >= 3 and re.search(r"(?i)[(\[ ]at[)\] ]", text[bounds[i][0] : bounds[j - 1][1]])
                if not email:
                    continue
            s, e = _trim(text, bounds[i][0], bounds[j - 1][1])
            if s < e:
                left = text[slice(*bounds[i - 1])] if i else ""
                out[i, j] = (s, e, features(text[s:e], left, j - i))
    return out


class SemiCRF:
    """Weights of (kind, feature) and (kind before, kind); kind 0 is a single token outside any entity."""

    def __init__(self, weights: dict[tuple, float] | None = None):
        self.w = weights or {}
        self.kinds = ["", *MODEL_KINDS]

    def scores(self, feats: tuple[str, ...]) -> list[float]:
        get = self.w.get
        return [sum(get((k, f), 0.0) for f in feats) + get((k, "bias"), 0.0) for k in range(1, len(self.kinds))]

    def edge(self, a: int, b: int) -> float:
        return self.w.get(("edge", a, b), 0.0)

    def decode(self, n: int, cands: dict) -> list[tuple[int, int, int]]:
        """Best segmentation of n tokens: (first, last + 1, kind) of its entities."""
        by_end: dict[int, list] = {}
        for (i, j), c in cands.items():
            by_end.setdefault(j, []).append((i, self.scores(c[2])))
        best = [{0: (0.0, None)}]
        for j in range(1, n + 1):
            here: dict[int, tuple] = {}

            def offer(i, kind, score):
                for prev, (before, _) in best[i].items():
                    s = before + score + self.edge(prev, kind)
                    if kind not in here or s > here[kind][0]:
                        here[kind] = (s, (i, prev))

            offer(j - 1, 0, 0.0)
            for i, scored in by_end.get(j, ()):
                for k, s in enumerate(scored, 1):
                    offer(i, k, s)
            best.append(here)
        out, j = [], n
        kind = max(best[n], key=lambda k: best[n][k][0])
        while j > 0:
            i, prev = best[j][kind][1]
            if kind:
                out.append((i, j, kind))
            j, kind = i, prev
        return out[::-1]

    def gradient(self, n: int, cands: dict, gold: list[tuple[int, int, int]]) -> dict[tuple, float]:
        """Of the log-likelihood: observed minus expected feature counts, by forward and backward sums over segmentations."""
        K = len(self.kinds)
        by_end: dict[int, list] = {}
        for (i, j), c in cands.items():
            by_end.setdefault(j, []).append((i, self.scores(c[2]), c[2]))
        edge = np.array([[self.edge(a, b) for b in range(K)] for a in range(K)])
        segs = [(j - 1, j, 0, 0.0, ()) for j in range(1, n + 1)]
        segs += [(i, j, k, s, f) for j, own in by_end.items() for i, sc, f in own for k, s in enumerate(sc, 1)]
        segs.sort(key=lambda x: (x[1], x[0]))
        lse = np.logaddexp.reduce
        fwd = np.full((n + 1, K), -np.inf)
        fwd[0, 0] = 0
        for i, j, k, s, _ in segs:
            fwd[j, k] = np.logaddexp(fwd[j, k], lse(fwd[i] + edge[:, k]) + s)
        bwd = np.full((n + 1, K), -np.inf)
        bwd[n] = 0
        for i, j, k, s, _ in sorted(segs, key=lambda x: -x[1]):
            bwd[i] = np.logaddexp(bwd[i], edge[:, k] + s + bwd[j, k])
        total = lse(fwd[n])
        g: dict[tuple, float] = {}
        for i, j, k, s, f in segs:
            p_prev = np.exp(fwd[i] + edge[:, k] + s + bwd[j, k] - total)
            for a in np.flatnonzero(p_prev > 1e-6).tolist():
                g["edge", a, k] = g.get(("edge", a, k), 0.0) - p_prev[a]
            p = float(p_prev.sum())
            if k and p > 1e-6:
                for x in (*f, "bias"):
                    g[k, x] = g.get((k, x), 0.0) - p
        at = {i: (j, k) for i, j, k in gold}
        i, prev = 0, 0
        while i < n:
            j, k = at.get(i, (i + 1, 0))
            g["edge", prev, k] = g.get(("edge", prev, k), 0.0) + 1
            if k:
                for x in (*cands[i, j][2], "bias"):
                    g[k, x] = g.get((k, x), 0.0) + 1
            i, prev = j, k
        return g


def _make_card(r: random.Random) -> str:
    d = "4" + "".join(str(r.randrange(10)) for _ in range(14))
    return next(d + str(x) for x in range(10) if luhn(d + str(x)))


def _make_iban(r: random.Random) -> str:
    """German ones, and those of other lengths and of letters (country, bank's letters, all characters)."""
    country, letters, size = r.choice([("DE", 0, 22), ("DE", 0, 22), ("NO", 0, 15), ("GB", 4, 22), ("BR", 0, 29), ("QA", 4, 29), ("JO", 4, 30), ("MT", 4, 31), ("LC", 4, 32)])
    body = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(letters)) + "".join(str(r.randrange(10)) for _ in range(size - 4 - letters))
    return next(f"{country}{x:02d}{body}" for x in range(100) if _iban_ok(f"{country}{x:02d}{body}"))


def training_lines(seed: int = 11, n: int = 700) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated lines with (start, end, kind) of each entity; a third of the fillers are digit decoys."""
    r = random.Random(seed)
    syl = ["an", "er", "tion", "the", "of", "re", "st", "que", "la", "der", "ein", "os", "ment", "ou", "ing", "ble"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    num = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def entity():
        kind = r.choice(MODEL_KINDS)
        host = f"{word()}{r.randrange(9)}.{r.choice(['example', 'mail'])}.{r.choice(['com', 'org', 'net'])}"
        if kind == "email":
            user = f"{word()}.{r.randrange(99)}"
            plain = ".".join([word(), *[r.choice(["mail", "example", word()]) for _ in range(r.choice([0, 0, 1, 1, 2]))], r.choice(["com", "org", "net"])])
            spelled = [(f" {a} ", f" {d} ") for a, d in (("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)"))]
            at, dot = r.choice(spelled)
            written = r.choice([user, word()]) + at + r.choice([host, plain]).replace(".", dot)
            return kind, r.choice([f"{user}@{host}", f"{user}@{host}", written, written, f"{user} (at) {host}"])
        if kind == "ip":
            return kind, ".".join(str(r.randrange(256)) for _ in range(4)) + r.choice(["", "", f":{r.randrange(9999)}"])
        if kind == "card":
            c = _make_card(r)
            return kind, r.choice([c, c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4))])
        if kind == "phone":
            return kind, r.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}"])
        if kind == "secret":
            return kind, r.choice(["AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), f"password={hexa(18)}", f'token = "{hexa(40)}"', f"api_key: {hexa(32)}", f"ghp_{hexa(36)}", hexa(40)])
        if kind == "iban":
            c = _make_iban(r)
            return kind, r.choice([c, " ".join(c[i : i + 4] for i in range(0, len(c), 4))])
        return kind, f"{r.randint(100, 665)}-{num(2)}-{num(4)}"

    def decoy():
        return r.choice([num(r.randint(1, 6)), f"{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"v{num(1)}.{num(2)}.{num(1)}", f"{num(2)}:{num(2)}", num(16)[:-1] + "0" if not luhn((x := num(15)) + "0") else "17", f"{word()}{num(2)}", f"{num(3)},{num(3)}", f"300.{num(3)}.1.999", f"@{word()}", f"{num(5)}%", f"#{num(4)}", "token of", "password", f"{word()} at {word()}"])  # noqa: F841

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(3, 8)):
            text += " " if text else ""
            p = r.random()
            if p < 0.3:
                kind, s = entity()
                spans.append((len(text), len(text) + len(s), kind))
                text += s + r.choice(["", "", ",", "."])
            elif p < 0.5:
                text += decoy() + r.choice(["", ",", "."])
            else:
                text += r.choice([word(), word(), word(), r.choice(list(_CUES))])
        out.append((text, spans))
    return out


def _bounds(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


@functools.cache
def trained(seed: int = 11, epochs: int = 3) -> SemiCRF:
    """The model, fitted by Adagrad on generated lines; the same weights every time."""
    crf = SemiCRF()
    square: dict[tuple, float] = {}
    data = []
    for text, spans in training_lines(seed):
        bounds = _bounds(text)
        cands = _candidates(text, bounds)
        where = {(c[0], c[1]): ij for ij, c in cands.items()}
        gold = [(*where[s, e], 1 + MODEL_KINDS.index(k)) for s, e, k in spans if (s, e) in where]
        data.append((len(bounds), cands, gold))
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(data)
        for n, cands, gold in data:
            for key, g in crf.gradient(n, cands, gold).items():
                if abs(g) > 1e-5:
                    square[key] = square.get(key, 0.0) + g * g
                    crf.w[key] = crf.w.get(key, 0.0) * (1 - 1e-4) + 0.5 * g / math.sqrt(square[key] + 1e-8)
    return crf


def island_spans(crf: SemiCRF, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) that the model finds in one island's text."""
    bounds = _bounds(text)
    cands = _candidates(text, bounds)
    if not cands:
        return []
    return [(MODEL_KINDS[k - 1], *cands[i, j][:2]) for i, j, k in crf.decode(len(bounds), cands)]


# ---- whole texts -----------------------------------------------------------------------------

_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True
_AT = re.compile(r"(?i)(?<=[\s(\[])at(?=[\s)\]])")
_DOT = re.compile(r"(?i)(?<=[\s(\[])dot(?=[\s)\]])")


_DIGIT = re.compile(r"[0-9@]")
_LOW_OPENERS = ["assword", "asswd", "pwd", "token", "secret", "key", " dot ", "dot]", "dot)", "\ndot", "\tdot", "dot\n", "dot\t"]


def _islands(text: str) -> list[tuple[int, int]]:
    """Character ranges of telling tokens with CONTEXT tokens around them, merged where they touch."""
    bounds = _bounds(text)
    tell = {i for i, (s, e) in enumerate(bounds) if any("0" <= c <= "9" or c == "@" for c in text[s:e])}
    starts = None

    def token(at: int) -> int:
        nonlocal starts
        if starts is None:
            starts = np.array([s for s, _ in bounds])
        return int(np.searchsorted(starts, at, "right")) - 1

    for m in _KEY.finditer(text):
        tell.update(range(max(0, token(m.start())), token(m.end() - 1) + 1))
    dots = np.array([token(m.start()) for m in _DOT.finditer(text)], np.int64)
    if len(dots):
        for m in _AT.finditer(text):
            a = token(m.start())  # up to the last dot that one segment with this at can hold
            k = int(np.searchsorted(dots, a + MAX_TOKENS, "left")) - 1
            if k >= 0 and dots[k] >= a and (dots[k] > a or _DOT.search(text, m.end(), bounds[a][1])):
                tell.update(range(a, int(dots[k]) + 1))
    out: list[list[int]] = []
    for i in sorted(tell):
        lo, hi = max(0, i - CONTEXT), min(len(bounds) - 1, i + CONTEXT)
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(bounds[a][0], bounds[b][1]) for a, b in out]


def find_spans(crf: SemiCRF, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind in KIND_ORDER and then by start."""
    if not _DIGIT.search(text):  # neither a pattern nor a telling token can be there
        low = text.lower()
        if not any(x in low for x in _LOW_OPENERS):
            return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
    extra = []
    for a, b in _islands(text):
        for kind, s, e in island_spans(crf, text[a:b]):
            k = int(np.searchsorted([x for x, _ in taken], e + a, "left")) if taken else 0
            if not k or ends[k - 1] <= s + a:
                extra.append((kind, s + a, e + a))
    every = sorted({*base, *extra}, key=lambda x: (KIND_ORDER.index(x[0]), x[1], x[2]))
    return base, every


def _telling(w: Words) -> np.ndarray:
    """Texts that hold a digit, an @, or a word that could open an entity without one."""
    marks = np.concatenate([[0], np.cumsum(_MARK[w.data])])
    has = np.zeros(w.hi - w.lo, bool)
    some = w.first[1:] > w.first[:-1]
    lo, hi = w.first[:-1][some], w.first[1:][some] - 1
    has[some] = marks[w.end[hi]] > marks[w.start[lo]]
    return has


def _scanner(crf: SemiCRF):
    def scan(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for w in words(text):
                has = _telling(w)
                rows = []
                low = w.data.tobytes().lower()
                if not has.all() and any(x.encode() in low for x in _LOW_OPENERS):
                    maybe = range(w.hi - w.lo)
                else:
                    maybe = np.flatnonzero(has).tolist()
                found = {i: find_spans(crf, text[w.lo + i].as_py() or "") for i in maybe}
                for i in range(w.hi - w.lo):
                    rows.append(found.get(i, ([], [])))
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in every] for _, every in rows]
                bases = [[{"kind": k, "start": s, "end": e} for k, s, e in base] for base, _ in rows]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([ids.slice(w.lo, w.hi - w.lo), pa.array(bases, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"])

    return scan


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts have none. Every row of docs gives one row, repeated or null ids included. Other
    columns are ignored. Spans are ordered by kind (KIND_ORDER), then start.
    """
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    d = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_scanner(trained()), f"doc_id long, base {span}, spans {span}")


def digest(found: DataFrame) -> DataFrame:
    """scan()'s rows as counts of base spans, a hash of them, and all spans as text."""
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def _redactor(crf: SemiCRF, at: int):
    def redact(batches):
        for batch in batches:
            text = batch.column(at)
            out = []
            for t in text.to_pylist():
                if t:
                    cut, done = [], 0
                    for s, e, k in sorted((s, e, k) for k, s, e in find_spans(crf, t)[1]):
                        if s >= done:
                            cut += [t[done:s], f"<{k.upper()}>"]
                        elif e > done:
                            cut.append(f"<{k.upper()}>")
                        done = max(done, e)
                    t = "".join([*cut, t[done:]]) if done else t
                out.append(t)
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(out, text.type))

    return redact


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; n_chars, where there is one, follows the text."""
    out = small_batches(docs).mapInArrow(_redactor(trained(), docs.columns.index("text")), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out
