"""Lossless segmentation of Markdown into protected, blank and labelled text pieces."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textloom.operators.slices import parts, structs

SLICE_BYTES = 1 << 20  # of texts whose pieces are Python objects at once
SCHEMA = "array<struct<pos: long, text: string, label: string, kind: string>>"

# Patterns of protected spans, marks of lines and abbreviations; fixed values.
PROTECTED = {
    "code_block": re.compile(r"```[^\n]*\n[\s\S]*?\n```|~~~[^\n]*\n[\s\S]*?\n~~~"),
    "inline_code": re.compile(r"`[^`\n]+`"),
    "url": re.compile(r"\b(?:https?|ftp|file)://[^\s<>\"'\)\]\}]+", re.IGNORECASE),
    "email": re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
}
HOLDS = {"code_block": ("```", "~~~"), "inline_code": ("`",), "url": ("://",), "email": ("@",)}  # what any such span has in it; texts without are not searched
PREFIX = re.compile(r"#{1,6}\s+|>\s*|\s*(?:[*+-]|\d+\.)\s+")
TABLE_RULE = re.compile(r"\s*\|(?:\s*:?-+:?\s*\|)+\s*")
RULE = re.compile(r"\s*[-*_]{3,}\s*")
SHORT = "Mr Dr Ms Prof e.g i.e vs Fig Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec Sec No Vol p".split()

# A mark that ends a sentence: not after a digit or an abbreviation, a full stop only after a word and before white space, which it takes. The looks
# behind follow the mark, so that a search skips to the marks.
_SHORT_BY_SIZE = {n: "|".join(re.escape(s) for s in SHORT if len(s) == n) for n in sorted({len(s) for s in SHORT})}
_STOP = re.compile(
    r"[।!?\n.](?:(?<!\.)|(?<=\w\.)(?=\s|\Z))(?<!\d.)" + "".join(rf"(?<!\b(?:{short}).)" for short in _SHORT_BY_SIZE.values()) + r"(?:(?<=\.)\s+)?",
    re.DOTALL,
)
_WORDS, _BENGALI, _LATIN = re.compile("[\\w\u0980-\u09ff]+"), re.compile("[\u0980-\u09ff]"), re.compile("[A-Za-z]")


def sentences(text: str) -> list[str]:
    """Sentences with their end marks and the white space after full stops; joined they are the text."""
    ends = [0, *(m.end() for m in _STOP.finditer(text)), len(text)]
    return [text[a:b] for a, b in itertools.pairwise(ends) if a < b]


def label(text: str, floor: float = 0.8) -> str:
    """bn, en or mixed: the script that has at least floor of the words, en for text without letters."""
    if not _BENGALI.search(text):
        return "en"
    bn = en = 0.0
    for word in _WORDS.findall(text):
        b, e = bool(_BENGALI.search(word)), bool(_LATIN.search(word))
        bn += 0.5 if b and e else b
        en += 0.5 if b and e else e
    if not bn + en or en >= floor * (bn + en):
        return "en"
    return "bn" if bn >= floor * (bn + en) else "mixed"


def _prose(text: str):
    if text.isspace():
        return [(text, "whitespace", "whitespace")]
    name = label if _BENGALI.search(text) else lambda _: "en"
    return [(s, "whitespace", "whitespace") if s.isspace() else (s, name(s), "text") for s in sentences(text)]


def _line(line: str):
    mark = (line, "protected", "markdown_syntax")
    prefix = PREFIX.match(line)
    if line.isspace():
        yield line, "whitespace", "whitespace"
    elif prefix:
        yield prefix[0], "protected", "markdown_syntax"
        yield from _prose(line[prefix.end() :])
    elif line.strip().startswith("|") and line.strip().endswith("|"):
        if TABLE_RULE.fullmatch(line):
            yield mark
        else:
            for cell in filter(None, re.split(r"(\|)", line)):
                yield from [("|", "protected", "markdown_syntax")] if cell == "|" else _prose(cell)
    elif RULE.fullmatch(line):
        yield mark
    else:
        yield from _prose(line)


def _plain(text: str):
    if text.isspace():
        yield text, "whitespace", "whitespace"
    else:
        for line in text.splitlines(keepends=True):
            yield from _line(line)


def segment(text: str | None, keep: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """(text, label, kind) pieces; joined they are the text. Terms in keep are protected, the longest first."""
    spans = [(m.start(), -m.end(), kind) for kind, rx in PROTECTED.items() if any(x in (text or "") for x in HOLDS[kind]) for m in rx.finditer(text)]
    for term in sorted(filter(None, keep), key=len, reverse=True):
        spans += [(m.start(), -m.end(), "do_not_translate") for m in re.finditer(re.escape(term), text or "")]
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: s[:2]):
        if start >= at:
            if start > at:
                out += _plain(text[at:start])
            out.append((text[start:-end], "protected", kind))
            at = -end
    return out + list(_plain(text[at:])) if text and at < len(text) else out


def listed(got: list[list[tuple[str, str, str]]]) -> pa.Array:
    """segment() of several texts as one Arrow array of SCHEMA."""
    text, label, kind = (pa.array(c, pa.string()) for c in (list(zip(*[x for own in got for x in own])) or [()] * 3))
    pos = pa.array([i for own in got for i in range(len(own))], pa.int64())
    return structs([len(own) for own in got], pos=pos, text=text, label=label, kind=kind)


def segments(c: Column, keep: tuple[str, ...] = ()) -> Column:
    """Pieces of a text column as an array in order; empty for null."""

    @arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in parts(texts, SLICE_BYTES):
                yield listed([segment(x, keep) for x in part.to_pylist()])

    return run(c)


def rejoin(c: Column) -> Column:
    """The text of an array of pieces."""
    return F.array_join(F.transform(c, lambda s: s["text"]), "")


WANTED = {None: ["bn", "en", "mixed"], "bn": ["en", "mixed"], "en": ["bn", "mixed"]}


def translatable(piece: Column, target: str | None = None) -> Column:
    """Whether a piece is text, and not already in the target language."""
    return piece["label"].isin(WANTED[target])


def chunks(text: str | None, budget: int = 400) -> list[str]:
    """Paragraphs with their separators; one over budget (words * 1.3) is packed by sentences unless it is a code block."""
    cost = lambda s: int(len(s.split()) * 1.3) + 1
    out: list[str] = []
    pieces = re.split(r"(\n{2,})", text or "")
    for part, gap in zip(pieces[::2], [*pieces[1::2], ""]):
        if not part:
            if gap and out:
                out[-1] += gap
            elif gap:
                out.append(gap)
            continue
        body = part.strip()
        if cost(part) <= budget or body.startswith("```") and body.endswith("```"):
            out.append(part + gap)
            continue
        packed, held, words = [], "", 0
        for s in filter(None, re.split(r"([^।!?\n]+[।!?\n]|[^.!?\n]+\.(?:\s+|$))", part)):
            n = len(s.split()) - bool(held and not held[-1].isspace() and not s[0].isspace() and s.split() and held.split())
            if held and int((words + n) * 1.3) + 1 > budget:
                packed.append(held)
                held, words = s, len(s.split())
            else:
                held, words = held + s, words + n
        out += [*packed, held + gap]
    return out
