"""Repair of Bengali text from fonts in the order of glyphs: folds of native replacements over fixed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import repair_tables as tables

_CONSONANT = "[ক-নপ-রলশ-হড়ঢ়য়ৎংঃঁড়ঢ়য়]"
_CLUSTER = f"((?:{_CONSONANT}্)++{_CONSONANT}?|{_CONSONANT})"


def _fold(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, "(?U)" + r[0], r[1].replace("$", "\\$")), rules, text)


def repair_bengali(text: Column) -> Column:
    """Marks of lost characters go, words parted by table rules, lost ligatures and glyph-order words are mended, repeated vowel signs collapse.

    Null stays null; valid text without the tables' spellings is unchanged.
    """
    c = F.regexp_replace(text, "[﻿￾�]", "")
    c = _fold(c, tables.SPLIT + tables.LIGATURES + tables.VOCABULARY)
    return reduce(lambda c, v: F.regexp_replace(c, v + "{2,}", v), ("ি", "ে", "া"), c)


def speech_order(text: Column) -> Column:
    """Vowel signs that stand before their consonants in the order of glyphs put after them; split o and au composed."""
    c = F.regexp_replace(text, f"ে{_CLUSTER}া", "$1ো")
    c = F.regexp_replace(c, f"ে{_CLUSTER}ৗ", "$1ৌ")
    return F.regexp_replace(c, f"([িেৈ]){_CLUSTER}", "$2$1")


def clean_gazette(text: Column) -> Column:
    """Gazette text in the order of glyphs as plain Bengali: r-signs, conjuncts, vowel signs, known words, spaces before marks."""
    each = lambda c, rows: reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), rows, c)
    c = F.regexp_replace(text, "([মযথতণধঘশষ])্র", "র্$1")
    c = each(speech_order(each(c, tables.GLYPH_ORDER)), tables.WORDS)
    c = F.regexp_replace(c, "(?U)এস\\s*\\.?\\s*আর\\s*\\.?\\s*ও\\s*নং\\s*৩৭০\\s*[-–]?\\s*আ\\s*ইন", "এস. আর. ও. নং ৩৭০-আইন")
    c = F.regexp_replace(c, "(?U)\\s+([,।:;!?])", "$1")
    return F.regexp_replace(c, "(?U)^\\s+|\\s+\\z", "")


#: Marks that close or open a fragment; fixed values.
_CLOSERS, _JOINERS = [".", ",", "-", "।", ":", ";", ")"], ["(", "[", "-"]
_BREAKS, _OPENERS = ["]", "}"], ["(", "[", "{", "-", "."]
_KEEPS = ["(", "১", "২", "৩", "৪", "৫", "৬", "৭", "৮", "৯", "#"]


def merge_fragments(lines: Column) -> Column:
    """Lines of one to three characters joined with their neighbours: marks close up, others join by a space.

    A fold with a running line: a new one starts unless either side is a fragment.
    """
    array = lambda x: F.array(x)
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run"))

    def step(a: Column, line: Column) -> Column:
        run = a["run"]
        any_end = lambda c, marks, f: reduce(lambda x, m: x | f(c, m), marks, F.lit(False))
        ends = lambda marks: any_end(run, marks, lambda c, m: c.endswith(m))
        starts = any_end(run, _KEEPS, lambda c, m: c.startswith(m))
        joins = line.isin(_CLOSERS + _BREAKS) | ends(_OPENERS) | ((F.length(run) <= 3) & ~starts) | ((F.length(line) <= 3) & ~line.rlike("^\\([১-৯a-zA-Zক-হ]+\\)"))
        tight = line.isin(_CLOSERS) | ends(_JOINERS)
        return F.struct(
            F.when((run != "") & ~joins, F.concat(a["out"], array(run))).otherwise(a["out"]).alias("out"),
            F.when(run == "", line).when(~joins, line).when(tight, F.concat(run, line)).otherwise(F.concat(run, F.lit(" "), line)).alias("run"),
        )

    return F.aggregate(lines, state, step, lambda a: F.when(a["run"] != "", F.concat(a["out"], array(a["run"]))).otherwise(a["out"]))
