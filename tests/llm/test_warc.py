import random

from textloom.llm import warc as W


def test_canonical(spark):
    urls = [("HTTP://WWW.Ex.com:80/a?b=2&a=1&utm_source=x#f", "ex.com/a?a=1&b=2"), ("https://ex.com", "ex.com/"), ("ex.com/p?utm_x=1", "ex.com/p"), (None, None), ("", "/")]
    df = spark.createDataFrame(urls, "u string, want string")
    for r in df.withColumn("got", W.canonical_url(df.u)).collect():
        assert r.got == r.want


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        url = None if i % 97 == 0 else "http://hot.com/" if i % 3 == 0 else f"http://h{i % 20}.com/x"
        h = {k: v for k, v in (("etag", r.choice([None, '"a"', 'W/"a"', '"b"'])), ("last-modified", r.choice([None, "d1", "d2"])), ("server", r.choice(["s", None])), ("date", str(i))) if v}
        rows.append((i, url, r.choice([None, *range(40)]), r.choice(["response", "revisit"]), r.choice([200, 200, 404]), h if i % 31 else None, f"g{i}", "x"))
    df = spark.createDataFrame(rows, "record_id long, uri string, ts long, kind string, status int, headers map<string,string>, digest string, outcome string").repartition(3)
    got = {x.record_id: x for x in W.resolve_revisits(df, slices=5).collect()}
    assert len(got) == sum(x[3] == "revisit" for x in rows)
    for i, url, ts, kind, _, h, _, _ in rows:
        if kind != "revisit":
            continue
        prior = [x for x in rows if x[3] == "response" and x[4] == 200 and url and x[1] == url and x[2] is not None and ts is not None and (x[2], x[0]) < (ts, i)]
        g = got[i]
        if not prior:
            assert g.outcome == "no_prior" and g.response_id is None
            continue
        p = max(prior, key=lambda x: (x[2], x[0]))
        assert g.response_id == p[0]
        old, new = p[5] or {}, h or {}
        if "etag" in old and "etag" in new:
            ok = old["etag"].removeprefix("W/") == new["etag"].removeprefix("W/")
            assert g.outcome == ("resolved" if ok else "mismatch")
        elif "last-modified" in old and "last-modified" in new:
            assert g.outcome == ("resolved" if old["last-modified"] == new["last-modified"] else "mismatch")
        else:
            assert g.outcome == "no_validator"
        want = {**old, **{k: v for k, v in new.items() if k in W.PERMITTED}} if g.outcome == "resolved" else None
        assert g.headers == want and g.digest == (p[6] if want is not None else None)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.resolve_revisits(W.captures(df)).collect() == []
    df = spark.createDataFrame([(1, None, None), (None, "u", "h"), (3, "http://a/", "")], "page_id long, url string, html string")
    assert sorted(r.record_id for r in W.resolve_revisits(W.captures(df)).collect()) == [5, 13, 14]
