"""Places of matches in a text: line and column, from prefix sums of line ends."""

from __future__ import annotations

import re
from bisect import bisect_right

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from textloom.operators.slices import parts, structs

SLICE_BYTES = 1 << 20  # of texts whose matches are Python objects at once
PLACES = "array<struct<line: long, col: long, start: long, end: long, text: string>>"


def line_starts(text: str) -> list[int]:
    """Where each line starts; lines end at a line feed."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


def found(text: str, rx: re.Pattern) -> list[tuple[int, int, int, int, str]]:
    """(line, col, start, end, text) of all matches."""
    starts = line_starts(text)
    out = []
    for m in rx.finditer(text):
        at = m.start()
        line = bisect_right(starts, at)
        out.append((line, at - starts[line - 1] + 1, at, m.end(), m[0]))
    return out


def _listed(texts: list[str | None], rx: re.Pattern) -> pa.Array:
    got = [[] if t is None else found(t, rx) for t in texts]
    flat = [x for own in got for x in own]
    columns = list(zip(*flat)) or [()] * 5
    kinds = {"line": pa.int64(), "col": pa.int64(), "start": pa.int64(), "end": pa.int64(), "text": pa.string()}
    return structs([len(own) for own in got], **{k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns)})


def places(c: Column, pattern: str, flags: int = 0) -> Column:
    """Matches of a pattern of Python's re in order: line and column (from 1, in code points) of their start, start and
    end in the text (from 0, end exclusive), text. A match that runs over lines has the place where it begins; null has none, an empty text what the pattern finds in it."""
    rx = re.compile(pattern, flags)

    @arrow_udf(PLACES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in parts(texts, SLICE_BYTES):
                yield _listed(part.to_pylist(), rx)

    return run(c)
