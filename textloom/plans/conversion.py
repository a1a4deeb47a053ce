"""Queries over sources, forms, numbers, repair, quality, windows and sinks; catalogue.py registers them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from textloom import streaming
from textloom.functions import bengali, numbers, repair, strings, tables, templates, text
from textloom.operators import forms, memory, quality
from textloom.plans._registry import query, table
from textloom.sinks import html as html_sink
from textloom.sources import external, files, info, records, web

_WORDS = "[" + ", ".join(f"'{w}'" for w in bengali.NUMBERS) + "]"
_INT = """concat_ws(' ', CASE WHEN n // 100000 > 0 THEN w[n // 100000 + 1] || ' লাখ' END, CASE WHEN n // 1000 % 100 > 0 THEN w[n // 1000 % 100 + 1] || ' হাজার' END,
    CASE WHEN n // 100 % 10 > 0 THEN w[n // 100 % 10 + 1] || ' শত' END, CASE WHEN n % 100 > 0 THEN w[n % 100 + 1] END)"""


@query(f"WITH o AS (SELECT o_orderkey, o_orderkey AS n, {_WORDS} AS w FROM orders) SELECT o_orderkey, 'ঋণাত্মক ' || CASE WHEN n = 0 THEN w[1] ELSE {_INT} END || ' দশমিক ' || w[n % 10 + 1] || ' ' || w[n // 10 % 10 + 1] AS words FROM o")
def signed_number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative numbers with two decimals, in Bengali digits, as words."""
    k = F.col("o_orderkey")
    written = F.concat(F.lit("-"), k.cast("string"), F.lit("."), (k % 10).cast("string"), (F.floor(k / 10) % 10).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.any_number_words(bengali.to_bengali_digits(written)).alias("words"))


@query("SELECT o_orderkey, o_orderkey * 13 + 7 AS n, -(o_orderkey % 100 * 100000 + o_orderkey % 1000 // 10) AS m FROM orders WHERE o_orderkey % 100 > 0")
def number_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number words read: what number_words writes, and a negative with another spelling of its unit."""
    k = F.col("o_orderkey")
    low = F.floor(k % 1000 / 10)
    other = F.concat(F.lit("মাইনাস "), bengali.number_words(k % 100), F.lit(" লক্ষ "), bengali.number_words(low))
    return table(spark, sf_dir, "orders").where(k % 100 > 0).select("o_orderkey", numbers.words_number(bengali.number_words(k * 13 + 7)).alias("n"), numbers.words_number(other).alias("m"))


_BANGLA = """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
    y AS (SELECT *, year(d) - CASE WHEN d < make_date(year(d), 4, 14) THEN 1 ELSE 0 END AS sy FROM d),
    o AS (SELECT *, date_diff('day', make_date(sy, 4, 14), d) AS off, CASE WHEN (sy % 4 = 0 AND sy % 100 <> 0) OR sy % 400 = 0 THEN 1 ELSE 0 END AS lp FROM y),
    s AS (SELECT *, [0, 31, 62, 93, 124, 155, 185, 215, 245, 275, 305, 335 + lp] AS st FROM o),
    m AS (SELECT *, len(list_filter(st, lambda x: x <= off)) AS mon FROM s)"""
_MONTHS = "[" + ", ".join(f"'{m}'" for m in bengali.MONTHS) + "]"
_BN = f"translate(CAST({{}} AS VARCHAR), '0123456789', '{bengali.DIGITS}')"


@query(f"{_BANGLA} SELECT o_orderkey, 'from ' || {_BN.format('off - st[mon] + 1')} || ' ' || ({_MONTHS})[mon] || ' ' || {_BN.format('sy - 593')} || ' বঙ্গাব্দ on; 31 February 2020 stays' AS line FROM m")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gregorian dates inside lines rewritten; a date that does not exist stays."""
    line = F.concat(F.lit("from "), F.date_format("o_orderdate", "d MMMM, yyyy"), F.lit(" on; 31 February 2020 stays"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.dates_to_bangabda(line).alias("line"))


_GREGORIAN = "[" + ", ".join(f"'{m}'" for m in numbers.GREGORIAN_BN) + "]"


@query(f"SELECT o_orderkey, {_BN.format('day(d)')} || ' ' || ({_GREGORIAN})[month(d)] || ' ' || {_BN.format('year(d)')} || ' খ্রিষ্টাব্দ.' AS line FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def document_dates_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of the Bengali calendar inside lines rewritten."""
    b = table(spark, sf_dir, "orders").select("o_orderkey", bengali.bangabda(F.to_date("o_orderdate")).alias("b"))
    line = F.concat_ws(" ", bengali.to_bengali_digits(F.col("b.day").cast("string")), "b.month_name", F.concat(F.col("b.year").cast("string"), F.lit(" বঙ্গাব্দ.")))
    return b.select("o_orderkey", numbers.dates_to_gregorian(line).alias("line"))


_LATIN = "[" + ", ".join(f"'{m}'" for m in numbers.MONTHS_LATIN) + "]"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '2015 CE (Approx)' ELSE (o_orderkey % 30 + 1) || ' ' || ({_LATIN})[o_orderkey % 13] || ', ' || (CASE WHEN o_orderkey % 13 >= 10 THEN 2016 ELSE 2015 END) || ' CE (Approx)' END AS said FROM orders")
def approximate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bengali dates as approximate Gregorian ones; every thirteenth names no month."""
    k = F.col("o_orderkey")
    month = F.element_at(F.array(*[F.lit(m) for m in ["মাস", *bengali.MONTHS]]), (k % 13 + 1).cast("int"))
    line = F.concat(bengali.to_bengali_digits((k % 30 + 1).cast("string")), F.lit(" "), month, F.lit(", ১৪২২"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.approximate_gregorian(line).alias("said"))


@query("SELECT o_orderkey, 'তিন ' || o_orderkey || ' বিশেষ জুলাই ব্যাংক আবেদন ি' AS text FROM orders")
def repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with lost ligatures, parted words and glyph order mended."""
    line = F.concat(F.lit("﻿িতন "), F.col("o_orderkey").cast("string"), F.lit(" িবেশষ জলু | াই ব\x00াংক আেবদন িি"))
    return table(spark, sf_dir, "orders").select("o_orderkey", repair.repair_bengali(line).alias("text"))


@query("SELECT o_orderkey, 'কিখো পৌষ স্ত্রি ' || o_orderkey AS speech, 'বাংলাদেশ গেজেট, প্রকাশ ' || o_orderkey AS gazette FROM orders")
def gazette_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vowel signs put behind their consonants, and the whole cleanup of gazette text."""
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", repair.speech_order(F.concat(F.lit("িকেখা েপৗষ িস্ত্র "), k)).alias("speech"), repair.clean_gazette(F.concat(F.lit(" বাংলােদশ েগেজট , পৰ্কাশ "), k, F.lit(" "))).alias("gazette")
    )


@query("SELECT doc_id, '(' || lang || ')' || chr(10) || 'a line that is long enough, x' || chr(10) || 'another line of some length' AS lines FROM documents")
def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of a made-up page joined: a bracket closes up, a mark too, a short word by a space."""
    lines = F.array(F.concat(F.lit("("), F.col("lang")), F.lit(")"), F.lit("a line that is long enough"), F.lit(","), F.lit("x"), F.lit("another line of some length"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(repair.merge_fragments(lines), "\n").alias("lines"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 600).cast("double").alias("x0"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("text"), (F.col("l_linenumber") * 10).cast("double").alias("top"))


@query("SELECT l_orderkey AS doc, l_partkey || '-' || l_linenumber AS text, CAST(CASE WHEN l_partkey % 600 < 130 THEN 0 WHEN l_partkey % 600 < 280 THEN 1 WHEN l_partkey % 600 < 430 THEN 2 ELSE 3 END AS BIGINT) AS cell FROM lineitem")
def cell_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to the columns whose range holds them."""
    columns = F.array(*[F.lit(x) for x in (0.0, 150.0, 300.0, 450.0)])
    return _placed(spark, sf_dir).select("doc", "text", forms.cell_of(F.col("x0"), columns).cast("long").alias("cell"))


@query(
    """WITH a AS (SELECT l_orderkey AS doc, (SELECT min(i) FROM (SELECT unnest([0.0, 150.0, 300.0, 450.0]) AS c, unnest([0, 1, 2, 3]) AS i) WHERE abs(l_partkey % 600 - c) < 40) AS i FROM lineitem)
    SELECT doc, count(DISTINCT i) AS aligned FROM a GROUP BY doc"""
)
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns a page's words stand near."""
    columns = F.array(*[F.lit(x) for x in (0.0, 150.0, 300.0, 450.0)])
    return _placed(spark, sf_dir).groupBy("doc").agg(F.collect_list("x0").alias("xs")).select("doc", forms.aligned(F.col("xs"), columns).cast("long").alias("aligned"))


@query(
    """WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, [CAST(l_partkey AS VARCHAR), l_comment2, l_shipmode2] AS cells FROM (SELECT *, CASE WHEN l_quantity > 25 THEN repeat('x', 31) ELSE 'y' END AS l_comment2, CAST(l_suppkey AS VARCHAR) AS l_shipmode2 FROM lineitem))
    SELECT doc, count(*) >= 3 AND sum(len(list_filter(cells, lambda c: length(c) > 30))) <= 0.3::DOUBLE * sum(len(cells)) AS is_table FROM r GROUP BY doc"""
)
def table_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the lines of an order make a table."""
    cells = F.array(F.col("l_partkey").cast("string"), F.when(F.col("l_quantity") > 25, "x" * 31).otherwise("y"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(cells).alias("rows")).select("doc", forms.is_table(F.col("rows")).alias("is_table"))


@query(
    """WITH c AS (SELECT l_orderkey AS doc, list_sort(list_distinct(list(CAST(l_partkey % 600 AS DOUBLE)))) AS xs FROM lineitem GROUP BY 1)
    SELECT doc, len(xs) > 1 AND (xs[-1] - xs[1]) / len(xs) >= 30 AND len(xs) / ((xs[-1] - xs[1]) / 72) <= 10 AND len(xs) <= 20 AS form FROM c"""
)
def form_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's columns look like a form's."""
    c = _placed(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_set("x0")).alias("columns"))
    return c.select("doc", forms.is_form(F.col("columns"), F.lit(612.0)).alias("form"))


@query()
def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of placed words as Markdown: orders of four words a row."""
    w = _placed(spark, sf_dir)
    four = F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 3)]))
    w = w.withColumn("c", four).select("doc", F.lit(1).alias("page"), F.concat_ws(".", "text", "c").alias("text"), (F.col("c") * 150 + F.col("x0") % 8).alias("x0"), (F.col("c") * 150 + 60.0).alias("x1"), "top")
    return forms.form_pages(w).select("doc", F.size("columns").alias("columns"), "table_rows", "rows", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query(
    """WITH c AS (SELECT n_regionkey, n_nationkey, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation), w AS (SELECT n_regionkey, max(length(a)) AS wa, max(length(b)) AS wb FROM c GROUP BY 1),
    l AS (SELECT n_regionkey, n_nationkey, '|' || rpad(a, wa::INT, ' ') || '|' || rpad(b, wb::INT, ' ') || '|' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, '|' || repeat('-', wa) || '|' || repeat('-', wb) || '|' AS rule FROM c JOIN w USING (n_regionkey))
    SELECT n_regionkey AS region, string_agg(CASE WHEN i = 1 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY i) AS markdown FROM l GROUP BY 1"""
)
def aligned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a padded table; blank rows go."""
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells")))).alias("r"))
    cells = F.concat(F.transform("r", lambda r: r["cells"]), F.array(F.array(F.lit(" "), F.lit(None).cast("string"))))
    return rows.select("region", forms.aligned_table(cells).alias("markdown"))


@query("SELECT doc_id, '.1 ' || lang || chr(10) || 'x' || chr(10) || '.2' || chr(10) AS text FROM documents")
def joined_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lone item numbers joined with the next line that holds text."""
    return table(spark, sf_dir, "documents").select("doc_id", forms.join_numbering(F.concat(F.lit(".1\n\n "), F.col("lang"), F.lit("\nx\n.2\n"))).alias("text"))


@query(
    """WITH s AS (SELECT CAST(n_chars % 97 AS DOUBLE) AS score, quality = 1 AS good FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
    c AS (SELECT count_if(score < 40 AND NOT good) AS tp, count_if(score < 40 AND good) AS fp, count_if(score >= 40 AND good) AS tn, count_if(score >= 40 AND NOT good) AS fn, round(avg(score) FILTER (WHERE good), 2) AS gm, round(avg(score) FILTER (WHERE NOT good), 2) AS bm,
        min(score) FILTER (WHERE good) AS mg, max(score) FILTER (WHERE NOT good) AS mb FROM s), r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS rc FROM c)
    SELECT 40.0::DOUBLE AS threshold, CAST(tp AS BIGINT) AS true_positives, CAST(fp AS BIGINT) AS false_positives, CAST(tn AS BIGINT) AS true_negatives, CAST(fn AS BIGINT) AS false_negatives, round(p, 4) AS precision, round(rc, 4) AS recall,
    round(2 * p * rc / (p + rc), 4) AS f1, gm AS good_scores_mean, bm AS bad_scores_mean, mg AS min_good_score, mb AS max_bad_score FROM r"""
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 of a threshold on scores of labelled documents."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return quality.calibrate(rows.select((F.col("n_chars") % 97).cast("double").alias("score"), (F.col("quality") == 1).alias("good")), 40.0)


@query("SELECT lang AS category, count(*) AS total, CAST(count_if(toxic = 0) AS BIGINT) AS passed, round(100 * count_if(toxic = 0) / count(*), 1) AS accuracy_pct FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return quality.accuracy(rows.select(F.col("lang").alias("category"), (F.col("toxic") == 0).alias("ok")))


@query("SELECT CAST(count_if(page_id % 5 <> 0) AS BIGINT) AS converted, CAST(count_if(page_id % 5 = 0) AS BIGINT) AS errors, count(*) AS files FROM pages")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the dispatcher as files, every fifth as bytes that no reader takes."""
    bad = F.col("page_id") % 5 == 0
    content = F.when(bad, F.lit(b"\x00\x01\x02")).otherwise(F.col("html").cast("binary"))
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.when(bad, ".bin").otherwise(".html")).alias("path"), content.alias("content"), F.length(content).cast("long").alias("length"), "url")
    return quality.batch_totals(files.convert(rows))


@query("SELECT page_id, 'text/html' AS mimetype, '.html' AS extension, CAST(1 AS BIGINT) AS guesses FROM pages")
def type_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first bytes of each page say it is."""

    @pandas_udf("mimetype string, extension string, guesses long")
    def guess(pages: pd.Series) -> pd.DataFrame:
        got = [info.guesses(p.encode(), info.Info()) for p in pages]
        return pd.DataFrame({"mimetype": [g[0].mimetype for g in got], "extension": [g[0].extension for g in got], "guesses": [len(g) for g in got]})

    return table(spark, sf_dir, "pages").select("page_id", guess("html").alias("g")).select("page_id", "g.*")


@query("SELECT page_id, 'text/plain' AS mimetype, 'utf-8' AS charset, strlen(url) AS size, CAST(encode(url) = encode(url) AS BOOLEAN) AS same FROM pages")
def data_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses packed into data: addresses and read again."""

    @pandas_udf("mimetype string, charset string, size long, same boolean")
    def read(uris: pd.Series, want: pd.Series) -> pd.DataFrame:
        got = [info.data_uri(u) for u in uris]
        return pd.DataFrame({"mimetype": [g[0] for g in got], "charset": [g[1].get("charset") for g in got], "size": [len(g[2]) for g in got], "same": [g[2].decode() == w for g, w in zip(got, want)]})

    uri = F.concat(F.lit("data:text/plain;Charset=utf-8;base64,"), F.base64(F.col("url").cast("binary")))
    return table(spark, sf_dir, "pages").select("page_id", read(uri, "url").alias("g")).select("page_id", "g.*")


@query("SELECT page_id, 'v' || page_id AS id, CASE WHEN page_id % 4 < 3 THEN 'v' || page_id END AS other FROM pages")
def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of addresses in all their forms; every fourth is no video's."""
    v = F.concat(F.lit("v"), F.col("page_id").cast("string"))
    k = F.col("page_id") % 4
    other = F.when(k == 0, F.concat(F.lit("https://youtu.be/"), v, F.lit("?t=1"))).when(k == 1, F.concat(F.lit("https://m.youtube.com/shorts/"), v)).when(k == 2, F.concat(F.lit("http://youtube.com/embed/"), v, F.lit("/"))).otherwise("https://example.com/watch?v=x")
    return table(spark, sf_dir, "pages").select("page_id", web.video_id(F.concat(F.lit("https://www.youtube.com/watch?a=1&v="), v)).alias("id"), web.video_id(other).alias("other"))


_FENCED = "replace(text, '. ', chr(10) || '```' || chr(10))"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({_FENCED}, chr(10))) AS s, generate_subscripts(string_split({_FENCED}, chr(10)), 1) AS n FROM documents),
    f AS (SELECT doc_id, n, s, sum(CASE WHEN starts_with(trim(s), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS c FROM l)
    SELECT doc_id, count(*) AS lines, CAST(count_if(c % 2 = 1 AND NOT starts_with(trim(s), '```')) AS BIGINT) AS code, max_by(c, n) % 2 = 1 AS open FROM f GROUP BY doc_id""")
def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside fences of documents whose sentence ends were made fences."""
    fenced = F.replace("text", F.lit(". "), F.lit("\n```\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.fence_lines(fenced).alias("f")).select("doc_id", F.size("f").cast("long").alias("lines"), F.size(F.filter("f", lambda x: x["kind"] == "code")).cast("long").alias("code"), F.element_at("f", -1)["open"].alias("open"))


@query(
    """WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?i)\\bthe\\b')) AS a FROM documents), r AS (SELECT doc_id, a, regexp_replace(text, '(?i)\\bthe\\b', 'THE1', 'g') AS s FROM t)
    SELECT doc_id, md5(regexp_replace(s, '(?i)\\bof\\b', 'OF1', 'g')) AS digest, CAST(a + len(regexp_extract_all(s, '(?i)\\bof\\b')) AS BIGINT) AS n FROM r"""
)
def glossary_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two terms replaced by the general fold, with the count of replacements."""
    out, n = memory.override_terms(F.col("text"), [("of", "OF1"), ("the", "THE1")])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out.cast("binary")).alias("digest"), n.alias("n"))


@query(
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.sessions(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, event_type, value FROM events), s AS (SELECT unnest([b - INTERVAL 30 MINUTE, b]) AS start, event_type, value FROM w)
    SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY start, event_type"""
)
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.sliding_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY event_type")
def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted once though every one comes twice."""
    e = table(spark, sf_dir, "events")
    return streaming.first_seen(e.unionAll(e)).groupBy("event_type").agg(F.count("*").alias("events"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, source) AS kind, lang, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS first FROM documents")
def merged_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts merged field by field, and the first key that a map holds."""
    old, new = F.struct(F.col("source").alias("kind"), "lang"), F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("kind"))
    m = F.map_from_arrays(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("c"))), F.array("source", "lang"))
    m = F.when(F.col("doc_id") % 2 == 0, m).otherwise(F.create_map(F.lit("b"), F.col("lang")))
    got = table(spark, sf_dir, "documents").select("doc_id", quality.merge_info((old, ["kind", "lang"]), (new, ["kind"])).alias("i"), quality.first_key(m, ["x", "a", "b"]).alias("first"))
    return got.select("doc_id", "i.kind", "i.lang", "first")


@query(
    """SELECT doc_id, md5(replace(text, 'th', '$1')) AS digest, CAST(length(text) - length(replace(text, 'th', 't')) AS BIGINT) AS n, CAST(CASE WHEN strpos(substr(text, 6), 'th') > 0 THEN strpos(substr(text, 6), 'th') + 4 ELSE strpos(text, 'th') - 1 END AS BIGINT) AS next,
    md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM documents WHERE text IS NOT NULL"""
)
def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal replaced everywhere, its next place after the fifth character, and escaping."""
    out, n = strings.replace_all(F.col("text"), "th", "$1")
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.md5(out.cast("binary")).alias("digest"), n.alias("n"), strings.find_next(F.col("text"), "th", F.lit(5)).alias("next"), F.md5(strings.escape_html(F.col("text")).cast("binary")).alias("escaped"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '(?:[$৳€£¥]|BDT\\s*|USD\\s*|Rs\\.?\\s*)[0-9০-৯]+(?:[.,][0-9০-৯]+)*|\\b[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}\\b|\\b[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?%?\\b|[০-৯]+(?:,[০-৯]{3})*(?:\\.[০-৯]+)?%?'), '|') AS spans FROM documents WHERE text IS NOT NULL")
def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(strings.number_spans(F.col("text")), "|").alias("spans"))


@query(
    """SELECT n_nationkey, 'attachment; filename="' || trim(n_name) || ' .md"; filename*=UTF-8''''' || replace(url_encode(n_name || 'é .md'), '+', '%20') AS disposition, CAST(strlen(n_name || 'é') AS BIGINT) AS length,
    chr(10) || chr(10) || '| ' || n_name || ' | Col |' || chr(10) || '| :--- | :--- |' || chr(10) || '| - | ' || n_nationkey || ' |' || chr(10) || chr(10) AS entry FROM nation"""
)
def download_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of a file to download, and the table of an entry form."""
    name = F.col("n_name")
    h = strings.download_headers(F.concat(name, F.lit("é .md")), F.concat(name, F.lit("é")))
    entry = strings.table_text(F.array(name, F.lit(" ")), F.array(F.array(F.lit(None).cast("string"), F.col("n_nationkey").cast("string"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", h["content_disposition"].alias("disposition"), h["content_length"].alias("length"), entry.alias("entry"))


@query(
    """WITH f AS (SELECT 'd' || (page_id % 3) AS dir, 'F' || page_id AS name, CAST(length(html) AS BIGINT) AS size FROM pages WHERE page_id % 7 <> 0),
    e AS (SELECT dir || '/' || name AS path, name, dir AS parent, FALSE AS is_dir, 1 AS depth, size FROM f UNION ALL SELECT DISTINCT dir, dir, '', TRUE, 0, CAST(NULL AS BIGINT) FROM f)
    SELECT *, row_number() OVER (PARTITION BY parent ORDER BY NOT is_dir, lower(name), name) AS place FROM e"""
)
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up folder's tree: ignored folders go, folders come first, names in any case."""
    k = F.col("page_id")
    path = F.concat(F.lit("/w/"), F.when(k % 7 == 0, F.lit(".git")).otherwise(F.concat(F.lit("d"), (k % 3).cast("string"))), F.lit("/F"), k.cast("string"))
    rows = table(spark, sf_dir, "pages").select(path.alias("path"), F.length("html").cast("long").alias("length"))
    return records.tree(rows, "/w")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split('# ' || replace(text, '. ', chr(10) || '## '), chr(10))) AS s, generate_subscripts(string_split('# ' || replace(text, '. ', chr(10) || '## '), chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(n AS BIGINT) AS line, CAST(length(regexp_extract(s, '^(#{1,6}) ', 1)) AS BIGINT) AS level FROM l WHERE regexp_matches(s, '^#{1,6} ')"""
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents whose sentences were made headings, by the table function."""
    tables.register(spark)
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit("\n## "))).alias("t"))
    return spark.sql("SELECT doc_id, s.line, s.level FROM {d}, LATERAL markdown_sections(t) s", d=d)


@query("SELECT o_orderkey, 'Title: ' || o_orderkey || chr(10) || 'Artist: x' AS lines, CASE WHEN o_orderkey % 2 = 0 THEN 'ok ' || o_orderkey ELSE 'nothing was read' END AS read, CASE WHEN o_orderkey % 3 = 0 THEN 'audio' WHEN o_orderkey % 3 = 1 THEN 'image' ELSE 'document' END AS modality, 'ab' AS bare FROM orders")
def external_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native parts of external readers: wanted metadata, fallbacks in order, modality, comments taken out."""
    k = F.col("o_orderkey")
    m = F.create_map(F.lit("Artist"), F.lit("x"), F.lit("Other"), F.lit("y"), F.lit("Title"), k.cast("string"))
    tries = [F.when(k % 2 == 0, F.lit(" ")), F.when(k % 2 == 0, F.concat(F.lit("ok "), k.cast("string")))]
    ext = F.when(k % 3 == 0, ".MP3").when(k % 3 == 1, ".png").otherwise(".pdf")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", external.metadata_lines(m, external.AUDIO_KEYS).alias("lines"), external.first_success(*tries, otherwise="nothing was read").alias("read"), external.modality(ext).alias("modality"), strings.strip_comments(F.lit("a<!-- x\n -->b")).alias("bare")
    )


@query("SELECT doc_id, 'x y' AS authors, lang AS keywords, 0.6::DOUBLE AS confidence FROM documents")
def paper_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped template for papers on made-up papers."""
    t = F.concat(F.lit("# A title of some length\nAuthors: x y\nKeywords: "), F.col("lang"), F.lit("\n"))
    got = templates.extract(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")), records.template("academic_paper"))
    f = F.col("fields")
    return got.select("doc_id", F.get(f["authors"]["value"], F.lit(0)).alias("authors"), F.get(f["keywords"]["value"], F.lit(0)).alias("keywords"), F.col("overall_confidence").alias("confidence"))


@query("SELECT doc_id, '<h2>' || lang || '</h2>' || chr(10) || '<p>a <strong>b</strong> <a href=\"http://x/\">c</a></p>' AS html FROM documents")
def markdown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown as HTML."""
    return table(spark, sf_dir, "documents").select("doc_id", html_sink.html_column(F.concat(F.lit("## "), F.col("lang"), F.lit("\n\na **b** [c](http://x/)"))).alias("html"))


@query("SELECT page_id, page_id % 2 = 0 AS inside FROM pages")
def contained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether paths stay below a root once their dots are resolved."""
    k = F.col("page_id")
    path = F.concat(F.lit("/w/a/../"), F.when(k % 2 == 0, F.lit("./b/")).otherwise(F.lit("../w2/")), k.cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", records.inside_root(path, "/w").alias("inside"))
