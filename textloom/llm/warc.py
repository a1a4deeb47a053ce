"""Not-modified revisit resolution.

A revisit record says that a capture had the same content as before. It is resolved by an as-of
join: by canonical URL to the latest earlier full response, whose validators must agree with the
revisit's; the merged record then takes the response's headers, updated by those headers that a
not-modified answer may carry.

The as-of join is cut by time as well as by URL: a window over (URL, time slice) finds the latest
response in the slice, and a second one over the slices' last responses (at most SLICES rows a URL)
carries it forward. A URL with any share of the captures is so spread over SLICES tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._spark import checkpoint

SLICES = 64
#: Header names a 304 answer may update; fixed values.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(c: Column) -> Column:
    """Host in lower case without www. or a default port, then path and sorted query without tracking
    parameters (utm_*) and fragment. Scheme is dropped: http and https captures are the same page."""
    bare = F.regexp_replace(F.trim(c), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.", "")
    host = F.regexp_replace(host, ":(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    args = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    return F.when(F.size(args) > 0, F.concat(host, path, F.lit("?"), F.array_join(args, "&"))).otherwise(F.concat(host, path))


def _strong(etag: Column) -> Column:
    """Entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Per revisit record: its columns, url_key, outcome, response_id and merged headers.

    records: record_id long, uri string, ts long, kind string ("response" or "revisit"), status int,
    headers map<string,string> with lower-case names, digest string. A full response has status 200 and a
    non-null uri, ts and record_id; order is by (ts, record_id), so ties in time go by id, and only
    responses before the revisit count. outcome: "no_prior" (none earlier, or the revisit has a null
    uri or ts), "no_validator" (neither side shares an ETag or Last-Modified to check),
    "mismatch" (the ETags differ, weakly compared, or without both ETags the Last-Modified differ),
    "resolved". Merged headers and digest are null unless resolved. Null headers count as none.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    r = records.select(
        F.col("record_id").cast("long").alias("record_id"), "uri", F.col("ts").cast("long").alias("ts"), "kind", "status",
        F.coalesce("headers", none).alias("headers"), "digest", canonical_url(F.col("uri")).alias("url_key"),
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    r = checkpoint(r)  # small next to the payloads, and read four times below
    cuts = r.select(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.lit(0) if not cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda x: x <= F.col("ts")))
    r = r.withColumn("slice", part).withColumn("full", F.coalesce(full, F.lit(False)))
    answer = F.struct("record_id", "ts", "headers", "digest")
    order = ["ts", "record_id"]
    inside = Window.partitionBy("url_key", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = r.withColumn("here", F.last(F.when(F.col("full"), answer), ignorenulls=True).over(inside))
    ends = r.where("full").groupBy("url_key", "slice").agg(F.max_by(answer, F.struct(*order)).alias("end"))
    marks = r.where("kind = 'revisit'").select("url_key", "slice").distinct()
    carried = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = marks.join(ends, ["url_key", "slice"], "full_outer").where("url_key is not null").withColumn("past", F.last("end", ignorenulls=True).over(carried))
    ends = ends.select(F.col("url_key").alias("k"), F.col("slice").alias("s"), "past")
    visits = seen.where("kind = 'revisit'")
    visits = visits.join(ends, (visits["url_key"] == ends["k"]) & (visits["slice"] == ends["s"]), "left")
    prior = F.when(F.col("ts").isNotNull() & F.col("url_key").isNotNull(), F.coalesce("here", "past"))
    visits = visits.withColumn("prior", prior)
    old, new = F.col("prior.headers"), F.col("headers")
    tags = old["etag"].isNotNull() & new["etag"].isNotNull()
    dates = old["last-modified"].isNotNull() & new["last-modified"].isNotNull()
    outcome = (
        F.when(F.col("prior").isNull(), "no_prior").when(tags, F.when(_strong(old["etag"]) == _strong(new["etag"]), "resolved").otherwise("mismatch"))
        .when(dates, F.when(old["last-modified"] == new["last-modified"], "resolved").otherwise("mismatch")).otherwise("no_validator")
    )
    allowed = F.map_filter(new, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(allowed, k))
    visits = visits.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return visits.select(
        "record_id", "uri", "url_key", "ts", "outcome", F.when(F.col("prior").isNotNull(), F.col("prior.record_id")).alias("response_id"),
        F.when(done, F.map_concat(kept, allowed)).alias("headers"), F.when(done, F.col("prior.digest")).alias("digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records made from pages (page_id, url, html): a response for each page, a later revisit
    of it under another spelling of its URL, and for every third page one that comes before it.

    By page_id modulo 5 the later revisit carries a weak form of the same ETag (0), the same Last-Modified only (1),
    another ETag (2), no validator (3), or both validators (4). Rows with a null page_id are left out.
    """
    p = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"),
        F.md5(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).alias("digest"),
    )
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))
    stamp = F.concat(F.lit("day "), (F.col("id") % 1000).cast("string"))
    txt = lambda s: F.lit(s).cast("string")
    first = F.create_map(txt("content-type"), txt("text/html"), txt("date"), F.concat(txt("t"), (F.col("id") * 10).cast("string")), txt("etag"), tag, txt("last-modified"), stamp, txt("server"), txt("a"))
    five = F.col("id") % 5
    etag = F.when(five == 0, F.concat(F.lit("W/"), tag)).when(five == 2, txt('"changed"')).when(five == 4, tag)
    again = F.create_map(
        txt("cache-control"), txt("max-age=60"), txt("content-type"), txt("text/plain"), txt("date"), F.concat(txt("t"), (F.col("id") * 10 + 5).cast("string")),
        txt("etag"), etag, txt("last-modified"), F.when(five.isin(1, 4), stamp), txt("server"), txt("b"),
    )
    other = F.concat(F.regexp_replace("url", "^(https?)://([^/?#]*)", "https://www.$2:443"), F.lit("#top"))
    rows = F.array(
        F.struct((F.col("id") * 4).alias("record_id"), F.col("url").alias("uri"), (F.col("id") * 10).alias("ts"), txt("response").alias("kind"), F.lit(200).alias("status"), first.alias("headers"), F.col("digest").alias("digest")),
        F.struct((F.col("id") * 4 + 1).alias("record_id"), other.alias("uri"), (F.col("id") * 10 + 5).alias("ts"), txt("revisit").alias("kind"), F.lit(304).alias("status"), F.map_filter(again, lambda k, v: v.isNotNull()).alias("headers"), F.lit(None).cast("string").alias("digest")),
        F.struct((F.col("id") * 4 + 2).alias("record_id"), F.col("url").alias("uri"), (F.col("id") * 10 - 3).alias("ts"), F.when(F.col("id") % 3 == 0, "revisit").otherwise("none").alias("kind"), F.lit(304).alias("status"), F.map_filter(again, lambda k, v: v.isNotNull()).alias("headers"), F.lit(None).cast("string").alias("digest")),
    )
    return p.select(F.explode(rows).alias("r")).select("r.*").where("kind != 'none'")
