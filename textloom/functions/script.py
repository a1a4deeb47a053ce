"""Bengali text checks: graphemes, broken conjuncts, normal form, spelling, phonetic typing."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

from textloom.operators.slices import parts

SLICE_BYTES = 1 << 20  # of texts that are Python objects at once

# Classes of characters and typing rules in the order in which they are tried; fixed values.
GRAPHEME = "[অ-হৎড়-য়](?:্[অ-হড়-য়])*[া-ৌৗ]?[ঁ-ঃ]?|[^\n]"
ORPHAN = "(?<![ক-হড়-য়])্|্(?![ক-হড়-য়])"
DOUBLE = "[া-ৌ]{2,}"
NUKTA = {"য়": "য়", "ড়": "ড়", "ঢ়": "ঢ়"}
AVRO = (
    "bhl ভ্ল psh পশ bdh ব্ধ bj ব্জ bd ব্দ bb ব্ব bl ব্ল bh ভ vl ভ্ল b ব v ভ kkhN ক্ষ্ণ kShN ক্ষ্ণ kkhm ক্ষ্ম kShm ক্ষ্ম "
    "kxN ক্ষ্ণ kxm ক্ষ্ম kkh ক্ষ kSh ক্ষ ksh কশ kx ক্ষ kk ক্ক kT ক্ট kt ক্ত ks ক্স kh খ k ক gh ঘ g গ a আ i ই u উ e এ o ও m ম r র"
).split()
PROBHAT = "k ক kh খ g গ gh ঘ a আ i ই u উ e এ o ও m ম r র".split()
SUFFIX = re.compile("(টি|টা|গুলো|দের|এর|কে|তে|ে|র)$")


def graphemes(c: Column) -> Column:
    """Clusters a reader sees as one letter; other characters alone; line ends go."""
    return F.regexp_extract_all(c, F.lit(GRAPHEME), F.lit(0))


def broken(c: Column) -> Column:
    """Array of struct(line, kind, found): orphan viramas and stacked vowel signs, line by line (from 1)."""
    lines = F.transform(F.split(c, "\n", -1), lambda s, i: F.struct((i + 1).cast("long").alias("line"), s.alias("s")))
    kinds = (("orphan_halant", ORPHAN), ("double_vowel_sign", DOUBLE))

    def found(x: Column, kind: str, rx: str) -> Column:
        return F.transform(F.regexp_extract_all(x["s"], F.lit(rx), F.lit(0)), lambda m: F.struct(x["line"].alias("line"), F.lit(kind).alias("kind"), m.alias("found")))

    return F.flatten(F.transform(lines, lambda x: F.concat(*[found(x, *k) for k in kinds])))


@arrow_udf(StringType())
def nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for part in parts(texts, SLICE_BYTES):
            own = part.to_pylist()
            composed = all(t is None or unicodedata.is_normalized("NFC", t) for t in own)
            yield part if composed else pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in own], pa.string())


def normalize(c: Column) -> Column:
    """NFC, three nukta letters as one character, joiners only after a virama, danda for pipes, single spaces."""
    c = nfc(c)
    for a, b in NUKTA.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, "(?<!্)[‌‍]+", "")
    c = F.replace(F.replace(c, F.lit("||"), F.lit("॥")), F.lit("|"), F.lit("।"))
    return F.regexp_replace(c, "[ \\t]{2,}", " ")


def diff(a: str, b: str) -> list[tuple[str, str]]:
    """(equal, delete or insert; grapheme) from a to b."""
    x, y = (re.findall(GRAPHEME, s) for s in (a, b))
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, x, y).get_opcodes():
        out += [("equal", g) for g in x[i:j]] if op == "equal" else [*(("delete", g) for g in x[i:j]), *(("insert", g) for g in y[k:m])]
    return out


def grapheme_diff(a: Column, b: Column) -> Column:
    """diff() of two columns; a null counts as empty."""

    @pandas_udf("array<struct<op: string, grapheme: string>>")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([[{"op": o, "grapheme": g} for o, g in diff(x or "", y or "")] for x, y in zip(left, right)])

    return run(a, b)


def type_phonetic(text: str, scheme: str = "avro", own: dict[str, str] | None = None) -> str:
    """Bengali letters for Latin typing: a whole text in own wins; else the first rule that fits at each place; other characters stay."""
    if own and text in own:
        return own[text]
    flat = PROBHAT if scheme == "probhat" else AVRO
    rules = list(zip(flat[::2], flat[1::2]))
    out, at = [], 0
    while at < len(text):
        latin, letter = next((r for r in rules if text.startswith(r[0], at)), (text[at], text[at]))
        out.append(letter)
        at += len(latin)
    return "".join(out)


def phonetic(c: Column, scheme: str = "avro", own: dict[str, str] | None = None) -> Column:
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else type_phonetic(t, scheme, own) for t in texts])

    return run(c)
