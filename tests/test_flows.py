import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import dispatch, once
from textloom.plans import flows


def _order(guesses, readers):
    """Plain version: names of readers in the order of tries."""
    out = []
    for extension, mime in guesses:
        for i, (name, _, extensions, mimes) in sorted(enumerate(readers), key=lambda x: (x[1][1], -x[0])):
            if ((extension or "").lower() in extensions or any((mime or "").lower().startswith(m) for m in mimes)) and name not in out:
                out.append(name)
    return out


def test_candidates_and_rounds_equal_plain(spark):
    rnd, readers = random.Random(1), flows._READERS
    guesses = {k: [(rnd.choice([None, ".X3", ".x7", f".x{rnd.randrange(20)}"]), rnd.choice([None, "kind/2", "KIND/4; a", "none"])) for _ in range(rnd.randrange(4))] for k in range(120)}
    rows = [(k, s, e, m) for k, g in guesses.items() for s, (e, m) in enumerate(g)]
    table = spark.createDataFrame([*rows, (None, 0, ".x1", None)], "id long, seq int, extension string, mimetype string")
    order = dispatch.candidates(table, dispatch.registry(spark, readers), "id")
    want = {k: o for k, g in guesses.items() if (o := _order(g, readers))}
    assert {r.id: r.readers for r in order.collect()} == want and max(map(len, want.values())) > 4

    calls = spark.sparkContext.accumulator(0)

    def reader(i, name):
        def read(contents):
            if name == "r5" and len(contents) > 1:
                raise ValueError("one at a time")
            calls.add(len(contents))
            return [(f"{name}:{c}", None) if c is not None and (c + i) % 4 == 0 else (None, "no") for c in contents]

        return read

    docs = spark.createDataFrame([(k, None if k % 11 == 0 else k) for k in guesses], "id long, content long")
    have = {name: reader(i, name) for i, (name, *_) in enumerate(readers) if name != "r3"}
    got = {r.id: r for r in dispatch.rounds(docs, order, have, "id").collect()}
    asked = 0
    for k in guesses:
        tried = want.get(k, [])
        won = next((i for i, n in enumerate(tried) if n != "r3" and k % 11 and (k + int(n[1:])) % 4 == 0), None)
        r = got[k]
        assert (r.success, r.reader, r.tries) == ((True, tried[won], won + 1) if won is not None else (False, None, len(tried)))
        assert r.text == (f"{r.reader}:{k}" if r.success else None) and len(r.errors) == r.tries - r.success
        asked += sum(n != "r3" for n in tried[: r.tries])
    assert len(got) == len(guesses) and calls.value == asked  # no reader sees a row twice


def test_dispatch_edges(spark):
    order = dispatch.candidates(spark.createDataFrame([], "id long, seq int, extension string, mimetype string"), dispatch.registry(spark, flows._READERS), "id")
    empty = spark.createDataFrame([], "id long, content string")
    assert dispatch.rounds(empty, order, {}, "id").count() == 0
    (r,) = dispatch.rounds(spark.createDataFrame([(1, "x")], empty.schema), order, {}, "id").collect()
    assert (r.success, r.reader, r.text, r.tries, r.errors) == (False, None, None, 0, [])
    with pytest.raises(ValueError, match="readers"):
        dispatch.candidates(spark.createDataFrame([], "id long, seq int, extension string, mimetype string"), spark.range(dispatch.MAX_READERS + 1), "id")


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_answers_once(spark, monkeypatch, sent):
    """As many calls as distinct contents, a content of a third of all rows among them; equal to the direct map."""
    monkeypatch.setattr(once, "SENT_BYTES", sent)
    monkeypatch.setattr(once, "COMMON", 10)
    rnd = random.Random(4)
    rows = [(i % 7, rnd.choice(["hot", None, "", f"t{rnd.randrange(60)}"]), "old") for i in range(900)] + [(1, "hot", "old")] * 3
    df = spark.createDataFrame(rows, "doc long, text string, Answer string")
    calls = spark.sparkContext.accumulator(0)

    def ask(texts):
        calls.add(len(texts))
        return [None if t == "t3" else len(t) for t in texts]

    got = once.answer_once(df, "text", ask, "long").select("doc", "text", "answer")
    want = [(d, t, None if t in (None, "t3") else len(t)) for d, t, _ in rows]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    got.count()
    assert calls.value == len({t for _, t, _ in rows if t is not None})


def test_answers_once_within_a_document(spark):
    df = spark.createDataFrame([(1, b"a"), (1, b"a"), (2, b"a"), (2, None)], "doc long, picture binary")
    calls = spark.sparkContext.accumulator(0)

    def ask(pictures):
        calls.add(len(pictures))
        return [f"{len(p)} byte" for p in pictures]

    got = once.answer_once(df, "picture", ask, "string", within=("doc",))
    assert sorted((r.doc, r.answer or "") for r in got.collect()) == [(1, "1 byte"), (1, "1 byte"), (2, ""), (2, "1 byte")] and calls.value == 2
    assert once.answer_once(df.limit(0), "picture", ask, "string").count() == 0
