import random
import re
import time

from pyspark.sql import functions as F

from textloom.llm import licenses as L

TEXTS = [
    None, "", " \n\t", "Released under the MIT License.", "MIT License", "under the mit license under the MIT-license, Under  The Mit.License",
    "Licensed under the Apache License, Version 2.0. All rights reserved. x", "CC BY-NC 4.0 and cc by nc", "undertheé mit license under the mit licenseé",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: MPL-2.0", "mit der zeit", "É É",
    "apache license version 2 cc by nc under the mit license " * 40, "Licensed under CC BY-SA 4.0 International", "word " * 3000 + "All rights reserved",
]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = {}
    for phrase, label in L.BASE:
        p = phrase.split()
        places[label] = [i for i in range(len(words)) if words[i : i + len(p)] == p]
    every = [i for v in places.values() for i in v]
    base = sorted(k for k, v in places.items() if v)
    norm = " " + " ".join(words) + " "
    hits = []
    for n, label, prio, sure, _, rx in L.rules():  # no keyword gate here
        for m in re.finditer(rx, norm):
            s = norm[: m.start()].count(" ") - 1
            hits.append((s, s + m[0].count(" ") + 1, label, prio, sure, n))
    kept = [h for h in hits if not any(g[0] <= h[0] and g[1] >= h[1] and (-g[3], -(g[1] - g[0]), g[5]) < (-h[3], -(h[1] - h[0]), h[5]) for g in hits)]
    labels = sorted({*base, *(h[2] for h in kept)})
    score = 1.0 if base else max((h[4] for h in kept), default=0.0)
    return (len(words), len(every), min(every, default=None), max(every, default=None), ",".join(base), ",".join(labels), score)


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in L.scan(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), t and t[:80]
    assert L.scan(df.limit(0)).collect() == []


def test_rules_are_many_and_gated():
    assert len(L.rules()) > 300
    assert all(any(r in kw or r in rx for r in L.ROOTS) for *_, kw, rx in L.rules())


def spellings(parsed):
    """Strings a pattern accepts; a repeat is taken at its least and at its most, or once."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "BRANCH":
            own = [x for part in arg[1] for x in spellings(part)]
        elif name == "SUBPATTERN":
            own = spellings(arg[3])
        elif name == "MAX_REPEAT":
            lo, hi, part = arg
            own = [x * n for x in spellings(part) for n in {lo, max(1, hi if int(hi) < 9 else 1)}]
        elif name == "ASSERT_NOT":
            own = [""]
        elif name == "NOT_LITERAL" or name == "IN" and str(arg[0][0]) == "CATEGORY":
            own = ["0"]
        else:  # a set: its letters, or a digit (or sign) for a class
            own = [chr(x[1]) if str(x[0]) == "LITERAL" else "0" for x in arg]
        out = [a + b for a in out for b in own]
    return out


def test_keywords_and_roots_are_in_all_spellings():
    for _, keyword, spdx, name in L.LICENSES:
        assert "licen" in f"spdx license identifier {spdx}"
        for x in spellings(re._parser.parse(name)):
            assert keyword in x and any(root in f" {x} " for root in L.ROOTS) and re.fullmatch(name, x), (keyword, x)
    for _, _, _, keyword, rx in L.OTHERS + L.SIGNATURES:
        for x in spellings(re._parser.parse(rx)):
            assert keyword in x and any(root in f" {x} " for root in L.ROOTS), (keyword, x)


MIT = """The MIT License (MIT) Copyright (c) 2020 A. Person. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 3. Neither the name of the University nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;
either version 2 of the License, or (at your option) any later version. As a special exception, the copyright holders of this library give you permission to link this library
with independent modules to produce an executable."""


def test_whole_licences(spark):
    """Bodies of licences: overlapping signatures are resolved by priority and containment, in agreement with brute force."""
    texts = [MIT, BSD, GPL, MIT + " " + GPL, "Dual licensed under the MIT or GPL licenses", "https://creativecommons.org/licenses/by-nc-sa/4.0/ and https://creativecommons.org/licenses/by/4.0", "// SPDX-License-Identifier: MIT OR Apache-2.0", "For non-commercial use only. Unauthorised copying of this file is strictly prohibited."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = L.scan(df).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(t)
        for h in r.hits:  # nothing that another hit of higher priority holds
            assert not any(g != h and g.start <= h.start and g.end >= h.end and g.priority > h.priority for g in r.hits)
    labels = [set(r.labels.split(",")) for r in rows]
    assert "mit" in labels[0] and not labels[0] & {"isc", "ncsa", "gpl", "bsd"}
    assert "bsd-3" in labels[1] and "mit" not in labels[1]
    assert {"gpl-2", "classpath-exception"} <= labels[2] and "gpl" not in labels[2]
    assert {"mit", "gpl-2", "classpath-exception"} <= labels[3]
    assert "gpl-or-mit" in labels[4] and {"cc-by-nc-sa", "cc-by"} <= labels[5] and "mit-or-apache-2" in labels[6] and {"non-commercial", "proprietary"} <= labels[7]


def test_repeats_ties_and_long_texts(spark):
    rows = [(1, "MIT License", 1), (1, "MIT License", 2), (None, "MIT License", 3), (2, "x " * 400_000 + MIT, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hits int")
    got = L.scan(df).collect()
    assert len(got) == 4 and all("mit" in r.labels for r in got) and max(r.n_words for r in got) > 400_000


def test_non_commercial_and_open_data(spark):
    texts = ["Licensed under Creative Commons Attribution-Non-Commercial-ShareAlike 4.0", "Attribution Non-Commercial 3.0", "under the Open Data Commons Database License"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in L.scan(df).orderBy("doc_id").collect()] == ["cc-by-nc-sa", "cc-by-nc", "odbl-1"]
    assert [brute(t)[5] for t in texts] == ["cc-by-nc-sa", "cc-by-nc", "odbl-1"]


def test_blocks_of_hits(spark, monkeypatch):
    """Nested, equal and repeated hits over many small blocks equal the brute force."""
    rnd = random.Random(3)
    parts = ["under the mit license", "apache license version 2", "gnu general public license version 2", "cc by nc", "mit license", "licensed under the apache license version 2 0", "word", "the"]
    texts = [" ".join(rnd.choice(parts) for _ in range(n)) for n in (0, 1, 3, 4, 40, 150)]
    monkeypatch.setattr(L, "BLOCK", 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(texts[r.doc_id])
        assert list(r.hits) == sorted(r.hits)


def test_many_hits_in_one_text(spark):
    """Forty thousand hits in one text, all found."""

    def seconds(n):
        df = spark.createDataFrame([(1, "under the mit license now " * n)], "doc_id long, text string")
        begin = time.perf_counter()
        (r,) = L.scan(df).select("n_base", "labels", F.size("hits").alias("n")).collect()
        assert (r.n_base, r.labels, r.n) == (n, "mit", n)
        return time.perf_counter() - begin

    seconds(1)
    assert seconds(40_000) < 90
