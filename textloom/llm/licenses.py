"""Ordered licence signature rules over normalized words, as DataFrame expressions only.

A text is reduced to lower-case words between single spaces. A keyword prefilter picks the few texts
that can match anything; there a rule's own keyword gates its regex. Each match is an interval of
words with the rule's priority. An interval inside another of higher priority, or inside a longer one
of equal priority, is suppressed. Base phrases are found beside the rules and always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import ascii_lower
from textloom.llm.license_rules import SIGNATURES

#: Base phrases and labels; fixed values.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: label, keyword, SPDX words, regex for the name as it is written; in order of specificity.
LICENSES = [
    ("agpl-3", "affero", "agpl 3 0", "(?:gnu )?affero general public license,? ?(?:version|v)? ?3(?: 0)?"),
    ("agpl", "affero", "agpl 1 0", "(?:gnu )?affero general public license"),
    ("lgpl-2.1", "lesser", "lgpl 2 1", "(?:gnu )?lesser general public license (?:version|v)? ?2 1"),
    ("lgpl-3", "lesser", "lgpl 3 0", "(?:gnu )?lesser general public license (?:version|v)? ?3(?: 0)?"),
    ("lgpl", "lesser", "lgpl", "(?:gnu )?lesser general public license"),
    ("lgpl-2", "library general", "lgpl 2 0", "(?:gnu )?library general public license(?: (?:version|v)? ?2(?: 0)?)?"),
    ("gpl-2", "general public", "gpl 2 0", "(?:gnu )?general public license (?:version|v)? ?2(?: 0)?"),
    ("gpl-3", "general public", "gpl 3 0", "(?:gnu )?general public license (?:version|v)? ?3(?: 0)?"),
    ("gpl", "general public", "gpl", "(?:gnu )?general public license"),
    ("gfdl", "free documentation", "gfdl 1 3", "(?:gnu )?free documentation license"),
    ("apache-2", "apache", "apache 2 0", "apache license,? (?:version )?2(?: 0)?"),
    ("apache-1.1", "apache", "apache 1 1", "apache (?:software )?license (?:version )?1 1"),
    ("apache", "apache", "apache", "apache (?:software )?license"),
    ("mit-0", "mit no", "mit 0", "mit no attribution(?: license)?"),
    ("mit", "mit license", "mit", "mit license"),
    ("mit", "mit x11", "mit", "mit x11 license"),
    ("x11", "x11", "x11", "x11 license"),
    ("bsd-2", "bsd", "bsd 2 clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?"),
    ("bsd-3", "bsd", "bsd 3 clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?"),
    ("bsd-4", "bsd", "bsd 4 clause", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"),
    ("0bsd", "bsd", "0bsd", "(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?"),
    ("bsd", "bsd", "bsd", "bsd(?: style)? license"),
    ("mpl-2", "mozilla", "mpl 2 0", "mozilla public license (?:version|v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mpl 1 1", "mozilla public license (?:version|v)? ?1 1"),
    ("mpl", "mozilla", "mpl", "mozilla public license"),
    ("epl-2", "eclipse", "epl 2 0", "eclipse public license (?:version|v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", "epl 1 0", "eclipse public license (?:version|v)? ?1(?: 0)?"),
    ("eupl-1.2", "european union public", "eupl 1 2", "european union public licen[cs]e(?: (?:version|v)? ?1 2)?"),
    ("cddl-1", "common development", "cddl 1 0", "common development and distribution license"),
    ("cpl-1", "common public", "cpl 1 0", "common public license"),
    ("isc", "isc", "isc", "isc license"),
    ("zlib", "zlib", "zlib", "zlib(?: libpng)? license"),
    ("libpng", "libpng", "libpng 2 0", "libpng license"),
    ("boost-1", "boost", "bsl 1 0", "boost software license"),
    ("artistic-2", "artistic", "artistic 2 0", "artistic license (?:version )?2(?: 0)?"),
    ("artistic-1", "artistic", "artistic 1 0", "artistic license"),
    ("psf-2", "python software", "psf 2 0", "python software foundation license"),
    ("python-2", "python license", "python 2 0", "python license 2(?: 0)?"),
    ("ruby", "ruby", "ruby", "ruby license"),
    ("php-3", "php license", "php 3 01", "php license"),
    ("openssl", "openssl", "openssl", "openssl license"),
    ("postgresql", "postgresql", "postgresql", "postgresql licen[cs]e"),
    ("unlicense", "unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "do what the", "wtfpl", "do what the \\S+ you want to public license"),
    ("ncsa", "ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? license"),
    ("ofl-1.1", "open font", "ofl 1 1", "(?:sil )?open font license"),
    ("upl-1", "universal permissive", "upl 1 0", "universal permissive license"),
    ("odbl-1", "database license", "odbl 1 0", "open (?:data commons )?(?:open )?database license"),
    ("pddl-1", "public domain dedication and license", "pddl 1 0", "public domain dedication and license"),
    ("ms-pl", "microsoft public", "ms pl", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal", "ms rl", "microsoft reciprocal license"),
    ("afl-3", "academic free", "afl 3 0", "academic free license"),
    ("osl-3", "open software", "osl 3 0", "open software license"),
    ("vim", "vim license", "vim", "vim license"),
    ("cc0", "cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd 4 0", "cc by nc nd(?: \\d 0)?"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa 4 0", "cc by nc sa(?: \\d 0)?"),
    ("cc-by-nc", "cc by nc", "cc by nc 4 0", "cc by nc(?: \\d 0)?"),
    ("cc-by-nd", "cc by nd", "cc by nd 4 0", "cc by nd(?: \\d 0)?"),
    ("cc-by-sa", "cc by sa", "cc by sa 4 0", "cc by sa(?: \\d 0)?"),
    ("cc-by", "cc by", "cc by 4 0", "cc by(?: \\d 0)?"),
    ("cc-by-nc-sa", "commercial share", "cc by nc sa 3 0", "(?:creative commons )?attribution non ?commercial share ?alike(?: \\d 0)?"),
    ("cc-by-nc", "attribution non", "cc by nc 3 0", "(?:creative commons )?attribution non ?commercial(?: \\d 0)?"),
    ("cc-by-sa", "attribution share", "cc by sa 3 0", "(?:creative commons )?attribution share ?alike(?: \\d 0)?"),
    ("cc-by", "creative commons attribution", "cc by 3 0", "creative commons attribution(?: \\d 0)?"),
    ("proprietary", "proprietary", "licenseref proprietary", "proprietary (?:and confidential|license|software)"),
]

#: suffix of the rule's name, priority, confidence, keyword (None: the licence's), regex around SPDX words or name
FORMS = [
    ("tag", 100, 0.99, "spdx", "spdx license identifier {spdx}(?: only| or later)?"),
    ("notice", 80, 0.95, None, "(?:licensed|released|distributed|provided|available|published|made available) (?:to you )?under (?:the )?(?:terms of (?:the )?)?(?:a |an )?{name}(?: (?:version|v) \\d(?: \\d)?)?(?: (?:or later|or any later version))?(?: international)?"),
    ("work", 80, 0.95, None, "(?:this|the) \\S+ (?:is|are) (?:\\S+ ){{0,2}}under (?:the )?(?:terms of (?:the )?)?{name}"),
    ("subject", 75, 0.9, None, "subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}"),
    ("see", 70, 0.8, None, "(?:see|read|copy of) the {name}"),
    ("name", 50, 0.7, None, "{name}"),
]

#: Rules without a licence's name: label, priority, confidence, keyword, regex.
OTHERS = [
    ("proprietary", 60, 0.6, "all rights reserved", "all rights reserved"),
    ("copyright", 30, 0.3, "copyright", "copyright (?:c )?(?:\\d{4} )+\\S+"),
    ("public-domain", 60, 0.8, "public domain", "(?:in|into|to) the public domain"),
    ("mit", 90, 0.98, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 90, 0.95, "permission to use copy", "permission to use copy modify and or distribute this software"),
    ("bsd", 85, 0.9, "redistribution and use", "redistribution and use in source and binary forms"),
    ("gpl", 85, 0.9, "free software foundation", "under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-2", 90, 0.95, "apache org licenses", "www apache org licenses license 2 0"),
    ("cc", 70, 0.8, "creativecommons", "creativecommons org licenses \\S+(?: \\S+){0,2} \\d 0"),
    ("gpl", 70, 0.8, "gnu org", "gnu org licenses gpl(?: \\d 0)?"),
    ("proprietary", 60, 0.6, "no part of this", "no part of this \\S+ may be reproduced"),
]

#: Every text that a rule matches contains one of these.
ROOTS = [
    "licen", "software", "copy", "except", "cc by", "cc0", "without", "domain", "distribut", "commercial", "reserved", "purpose", "proprietary", "permission", "bsd", "attribution", "creative",
    "deriv", "org ", "executable", "namensnennung", "invariant sections", "reference library", "states government", "machine learning", "extent possible", "syscall", "trade secret",
    "data mining", "gemma terms", "same terms", "in return", "do what the", "cddl 1", "mulan", "font name", "fonts and", "mit or apache", "2 0 or mit", "mpl 1 1", "cecill", "rail", "free ", "materials", "no part of", "usage of the", "package", "openssl",
]


def rules() -> list[tuple[int, str, int, float, str, str]]:
    """(number, label, priority, confidence, keyword, regex) of every rule, in order."""
    out = []
    for label, keyword, spdx, name in LICENSES:
        for _, priority, sure, own, form in FORMS:
            out.append((label, priority, sure, own or keyword, form.format(spdx=spdx, name=f"(?:{name})")))
    out += [(*r[:4], f"(?:{r[4]})") for r in OTHERS + SIGNATURES]
    return [(i, *r[:4], f"(?<= ){r[4]}(?= )") for i, r in enumerate(out)]


#: Hits of a text are kept in sorted blocks of this many; work on n hits grows with n * n / BLOCK at most, and no array is built by appending beyond one block.
BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(a: Column) -> Column:
    """An array in slices of BLOCK; one empty slice for an empty array."""
    last = F.greatest(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(a, i * BLOCK + 1, F.lit(BLOCK)))


def _count(c: Column) -> Column:
    """Words in a piece between two matches (or between a match and an end), which starts and ends with a space."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) - 1


def normalize(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lowered, each between single spaces."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, hits, labels, score.

    Base: places where a BASE phrase's words stand consecutively, words counted from 0. hits are the
    rules' surviving intervals (start, end exclusive, label, priority, confidence), in order. labels joins
    the base labels and those of the hits, distinct and sorted. score is the largest confidence, 1 for a
    base phrase, 0 for no label. Null and empty texts have no words. Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalize(F.col("text").cast("string")).alias("norm"))
    d = d.withColumn("n_words", F.when(F.col("norm") == "  ", 0).otherwise(_count(F.col("norm"))).cast("long"))
    firsts, lasts, counts, names = [], [], [], []
    for phrase, label in BASE:
        cut = F.split("norm", f"(?<= ){phrase}(?= )", -1)
        has = F.contains("norm", F.lit(f" {phrase} "))
        counts.append(F.when(has, F.size(cut) - 1).otherwise(0))
        firsts.append(F.when(has, _count(cut[0])))
        lasts.append(F.when(has, F.col("n_words") - _count(F.element_at(cut, -1)) - len(phrase.split())))
        names.append(F.when(has, F.lit(label)))
    maybe = F.lit(False)
    for root in ROOTS:
        maybe = maybe | F.contains("norm", F.lit(root))
    table = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(s).alias("sure"), F.lit(f"{kw}").alias("keyword"), F.lit(rx).alias("regex"))
        for n, label, p, s, kw, rx in rules()
    ])
    gated = F.when(maybe, F.filter(table, lambda r: F.contains(F.col("norm"), r["keyword"]))).otherwise(F.filter(table, lambda r: F.lit(False)))

    def found(r: Column) -> Column:
        """The rule's intervals: a running word count over the pieces between matches."""
        pieces = F.transform(F.split(F.col("norm"), r["regex"], F.lit(-1)), _count)
        spans = F.transform(F.regexp_extract_all(F.col("norm"), r["regex"], F.lit(0)), lambda x: _count(x) + 2)
        zipped = F.arrays_zip(F.slice(pieces, 1, F.size(spans)).alias("gap"), spans.alias("len"))
        taken = lambda x: x["gap"] + x["len"]

        def places(block: Column, at: Column) -> Column:
            """Start and end of the matches of one block, whose words begin at `at`."""
            begin = F.struct(at.alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
            one = lambda acc, x: F.array(F.struct((acc["at"] + x["gap"]).cast("int").alias("s"), (acc["at"] + taken(x)).cast("int").alias("e")))
            return F.aggregate(block, begin, lambda acc, x: F.struct((acc["at"] + taken(x)).alias("at"), F.concat(acc["out"], one(acc, x)).alias("out")))["out"]

        def begins(blocks: Column) -> Column:
            """The word at which each block begins."""
            sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + taken(x)))
            begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(sizes, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

        walk = _let(zipped, lambda z: _let(_blocks(z), lambda bs: F.flatten(F.zip_with(bs, begins(bs), places))))
        return F.transform(walk, lambda i: F.struct(i["s"].alias("start"), i["e"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["sure"].alias("sure"), r["rule"].alias("rule")))

    d = d.withColumn("gated", gated)
    some = F.size("gated") > 0
    d = d.withColumn("raw", F.when(some, F.flatten(F.transform("gated", found))).otherwise(F.array().cast("array<struct<start:int,end:int,label:string,priority:int,sure:double,rule:int>>")))

    def beats(g: Column, h: Column) -> Column:
        """g holds h's interval and ranks before it: by priority, then length, then rule order."""
        longer = (g["end"] - g["start"]) - (h["end"] - h["start"])
        return (g["start"] <= h["start"]) & (g["end"] >= h["end"]) & (
            (g["priority"] > h["priority"]) | ((g["priority"] == h["priority"]) & ((longer > 0) | ((longer == 0) & (g["rule"] < h["rule"]))))
        )

    def bounds(b: Column) -> Column:
        """A block of sorted hits with its first start and its last end: only a block that holds an interval between them can suppress it."""
        return F.struct(F.get(b, F.lit(0))["start"].alias("first"), F.array_max(F.transform(b, lambda g: g["end"])).alias("last"), b.alias("hits"))

    def beaten(h: Column, blocks: Column) -> Column:
        return F.exists(blocks, lambda b: (b["first"] <= h["start"]) & (b["last"] >= h["end"]) & F.exists(b["hits"], lambda g: beats(g, h)))

    d = d.withColumn("hits", _let(F.array_sort("raw"), lambda hs: _let(F.transform(_blocks(hs), bounds), lambda bs: F.filter(hs, lambda h: ~beaten(h, bs)))))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))
    return d.select(
        "doc_id", "n_words", sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"), "hits",
        F.array_join(F.array_sort(F.array_union(base, F.transform("hits", lambda h: h["label"]))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["sure"])), F.lit(0.0))).alias("score"),
    )
