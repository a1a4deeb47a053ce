"""Registered queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import streaming
from textloom.functions import bengali, text
from textloom.operators import layout, memory
from textloom.plans import conversion, flows, language, terms  # noqa: F401  (they register their queries)
from textloom.plans._registry import ORACLES, QUERIES, query, table  # noqa: F401
from textloom.sources import files

FLAGSHIP = "page_markdown_stats"
_t = table


_WORDS = "len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))"
_STATS = f"""SELECT doc_id, lang, CAST({_WORDS} AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines,
    CAST(len(list_filter(string_split_regex(text, '[।!?.\\n]+'), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))) AS BIGINT) AS sentences,
    CAST(greatest(1, ceil({_WORDS} / 200.0)) AS BIGINT) AS minutes FROM documents"""


@query(_STATS)
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.words(F.col("text"))
    return _t(spark, sf_dir, "documents").select(
        "doc_id", "lang", n.alias("words"), F.length("text").cast("long").alias("chars"), text.lines(F.col("text")).alias("lines"),
        text.sentences(F.col("text")).alias("sentences"), text.reading_minutes(n).alias("minutes"),
    )


@query(f"""SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars FROM ({_STATS}) GROUP BY ROLLUP (lang)""")
def doc_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_stats(spark, sf_dir).rollup("lang").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split('# ' || text, chr(10))) AS line, generate_subscripts(string_split('# ' || text, chr(10)), 1) - 1 AS n FROM documents)
    SELECT doc_id, CAST(n AS BIGINT) AS line, CAST(length(regexp_extract(line, '^(#{1,6}) ', 1)) AS BIGINT) AS level, trim(regexp_extract(line, '^#{1,6} (.*)$', 1)) AS title
    FROM l WHERE regexp_matches(line, '^#{1,6} ')"""
)
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with level and line; each document's first line is made one."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat(F.lit("# "), "text"), "\n", -1)).alias("line", "s"))
    return rows.where(F.col("s").rlike("^#{1,6} ")).select(
        "doc_id", F.col("line").cast("long").alias("line"), F.length(F.regexp_extract("s", "^(#{1,6}) ", 1)).cast("long").alias("level"), F.trim(F.regexp_extract("s", "^#{1,6} (.*)$", 1)).alias("title")
    )


@query(
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '```')) % 2 + len(regexp_extract_all(text, '\\$\\$')) % 2 AS BIGINT) AS errors,
    CAST(len(regexp_extract_all(text, '\\[[^\\]]*\\]\\([ \\t]*\\)')) AS BIGINT) AS warnings FROM documents"""
)
def markdown_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.fence_errors(F.col("text")).alias("errors"), text.empty_links(F.col("text")).alias("warnings"))


_RATIO = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'eo', 'এও'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS t FROM documents),
    f AS (SELECT doc_id, unnest(t) AS x FROM w), p AS (SELECT doc_id, CASE WHEN regexp_matches(x, '[এও]') THEN 1 ELSE 0 END AS b, CASE WHEN regexp_matches(x, '[A-Za-z]') THEN 1 ELSE 0 END AS e FROM f),
    c AS (SELECT d.doc_id, coalesce(sum(b - b * e / 2.0::DOUBLE), 0) AS bn, coalesce(sum(e - b * e / 2.0::DOUBLE), 0) AS en, coalesce(sum((1 - b) * (1 - e)), 0) AS ot FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id),
    r AS (SELECT doc_id, CASE WHEN bn + en > 0 THEN bn / (bn + en) ELSE 0 END::DOUBLE AS bn, CASE WHEN bn + en > 0 THEN en / (bn + en) ELSE 0 END::DOUBLE AS en, CASE WHEN bn + en + ot > 0 THEN ot / (bn + en + ot) ELSE 1 END::DOUBLE AS other FROM c)"""


def _mixed_text():
    """Text in two scripts: two letters of every document made Bengali."""
    return F.translate("text", "eo", "এও")


@query(f"{_RATIO} SELECT * FROM r")
def token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", bengali.ratio(bengali.script_counts(_mixed_text())).alias("r")).select("doc_id", "r.*")


@query(f"{_RATIO} SELECT doc_id, CASE WHEN bn = 0 AND en = 0 THEN 'en' WHEN bn >= 0.8 THEN 'bn' WHEN en >= 0.8 THEN 'en' ELSE 'mixed' END AS class FROM r")
def sentence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", bengali.sentence_class(bengali.ratio(bengali.script_counts(_mixed_text()))).alias("class"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS email FROM documents")
def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.EMAIL), F.lit(0))).alias("email"))


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(text, '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,6}')))), ',') AS tokens FROM documents"""
)
def never_translate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(text.capital_tokens(F.col("text")), ",").alias("tokens"))


@query("SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯') AS bn FROM orders")
def digits_bn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", bengali.to_bengali_digits(F.col("o_orderkey").cast("string")).alias("bn"))


@query("SELECT o_orderkey, o_orderkey AS back FROM orders")
def digits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bengali.to_ascii_digits(bengali.to_bengali_digits(F.col("o_orderkey").cast("string"))).cast("long")
    return _t(spark, sf_dir, "orders").select("o_orderkey", back.alias("back"))


_BANGLA = """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
    y AS (SELECT *, year(d) - CASE WHEN d < make_date(year(d), 4, 14) THEN 1 ELSE 0 END AS sy FROM d),
    o AS (SELECT *, date_diff('day', make_date(sy, 4, 14), d) AS off, CASE WHEN (sy % 4 = 0 AND sy % 100 <> 0) OR sy % 400 = 0 THEN 1 ELSE 0 END AS lp FROM y),
    s AS (SELECT *, [0, 31, 62, 93, 124, 155, 185, 215, 245, 275, 305, 335 + lp] AS st FROM o),
    m AS (SELECT *, len(list_filter(st, lambda x: x <= off)) AS mon FROM s)"""
_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in bengali.MONTHS) + "]"


@query(f"{_BANGLA} SELECT o_orderkey, CAST(off - st[mon] + 1 AS BIGINT) AS day, CAST(mon AS BIGINT) AS month, ({_MONTH_LIST})[mon] AS month_name, CAST(sy - 593 AS BIGINT) AS year FROM m")
def bangabda_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", bengali.bangabda(F.to_date("o_orderdate")).alias("b")).select("o_orderkey", "b.*")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS back FROM orders")
def bangabda_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bangabda_dates(spark, sf_dir)
    return b.select("o_orderkey", bengali.gregorian(F.col("day"), F.col("month"), F.col("year")).alias("back"))


_NUMBER_LIST = "[" + ", ".join(f"'{w}'" for w in bengali.NUMBERS) + "]"


@query(
    f"""WITH n AS (SELECT o_orderkey, o_orderkey * 13 + 7 AS n, {_NUMBER_LIST} AS w FROM orders)
    SELECT o_orderkey, concat_ws(' ', CASE WHEN n // 100000 > 0 THEN w[n // 100000 + 1] || ' লাখ' END, CASE WHEN n // 1000 % 100 > 0 THEN w[n // 1000 % 100 + 1] || ' হাজার' END,
    CASE WHEN n // 100 % 10 > 0 THEN w[n // 100 % 10 + 1] || ' শত' END, CASE WHEN n % 100 > 0 THEN w[n % 100 + 1] END) AS words FROM n"""
)
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", bengali.number_words(F.col("o_orderkey") * 13 + 7).alias("words"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS BIGINT) AS links FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<a [^>]*href=")).cast("long").alias("links"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[a-zA-Z]{2,3}\\.wikipedia.org/') THEN 'wikipedia' WHEN starts_with(url, 'https://www.youtube.com/watch') THEN 'youtube'
    WHEN starts_with(url, 'https://www.bing.com/search?q=') THEN 'serp' ELSE 'html' END AS route FROM pages"""
)
def url_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    route = F.when(u.rlike("^https?://[a-zA-Z]{2,3}\\.wikipedia.org/"), "wikipedia").when(u.startswith("https://www.youtube.com/watch"), "youtube")
    return _t(spark, sf_dir, "pages").select("page_id", route.when(u.startswith("https://www.bing.com/search?q="), "serp").otherwise("html").alias("route"))


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown."""
    return files.html_to_markdown(_t(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "title", "markdown")


@query()
def page_markdown_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to Markdown, then words, headings and links by host."""
    md = files.html_to_markdown(_t(spark, sf_dir, "pages").select("page_id", "url", "html"))
    md = md.select(F.parse_url("url", F.lit("HOST")).alias("host"), text.words(F.col("markdown")).alias("words"), F.regexp_count("markdown", F.lit("(?m)^#{1,6} ")).alias("h"), F.regexp_count("markdown", F.lit("\\]\\(")).alias("l"))
    return md.groupBy("host").agg(F.count("*").alias("pages"), F.sum("words").alias("words"), F.sum("h").alias("headings"), F.sum("l").alias("links"))


@query(
    """SELECT doc_id, CASE WHEN n_chars * 977 < 1024 THEN (n_chars * 977) || ' B' WHEN n_chars * 977 < 1048576 THEN printf('%.1f KB', n_chars * 977 / 1024.0::DOUBLE)
    WHEN n_chars * 977 < 1073741824 THEN printf('%.2f MB', n_chars * 977 / 1048576.0::DOUBLE) ELSE printf('%.2f GB', n_chars * 977 / 1073741824.0::DOUBLE) END AS size FROM documents"""
)
def file_size_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.human_size(F.col("n_chars") * 977).alias("size"))


@query(
    """WITH m AS (SELECT min(doc_id) AS id, trim(text) AS s, lang FROM documents GROUP BY trim(text), lang)
    SELECT d.doc_id, m.id AS target FROM documents d LEFT JOIN m ON trim(d.text) = m.s AND d.lang = m.lang"""
)
def tm_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document looked up in the memory of distinct texts."""
    d = _t(spark, sf_dir, "documents")
    m = d.groupBy(F.trim("text").alias("source_text"), F.col("lang").alias("direction")).agg(F.min("doc_id").alias("target_text"))
    q = d.select("doc_id", F.col("text").alias("source"), F.col("lang").alias("direction"))
    return memory.exact_lookup(q, m).select("doc_id", F.col("target_text").alias("target"))


@query(
    """WITH m AS (SELECT p_partkey AS mem_id, p_name AS m FROM part WHERE regexp_full_match(p_name, '[ -~]*')), q AS (SELECT p_partkey AS id, replace(p_name, 'e', 'ee') AS q FROM part WHERE regexp_full_match(p_name, '[ -~]*')),
    s AS (SELECT id, mem_id, 1 - levenshtein(q, m) / CAST(greatest(length(q), length(m)) AS DOUBLE) AS sim FROM q, m WHERE length(q) > 0 AND abs(length(q) - length(m)) <= 0.1 * greatest(length(q), length(m)) + 0.000001 AND levenshtein(q, m) <= 0.1 * greatest(length(q), length(m)) + 0.000001)
    SELECT id, arg_max(mem_id, sim * 1000000000 - mem_id * 0.00001) AS mem_id, round_even(max(sim), 3) AS similarity FROM s WHERE sim >= 0.9 GROUP BY id"""
)
def tm_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altered part names looked up in the memory of part names."""
    p = _t(spark, sf_dir, "part")
    m = p.select(F.col("p_partkey").alias("mem_id"), F.col("p_name").alias("text"))
    return memory.fuzzy_lookup(p.select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit("e"), F.lit("ee")).alias("source")), m)


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def tm_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return memory.upsert(rows, ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a made-up page: one for each line item."""
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 600).cast("double").alias("x0"), (F.col("l_linenumber") * 2.5).alias("top"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("text"),
    )


_GRID = "SELECT l_orderkey AS doc, CAST(l_partkey % 600 AS DOUBLE) AS x0, l_linenumber * 2.5::DOUBLE AS top, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS text FROM lineitem"


@query(f"SELECT doc, round_even(top / 5, 0) * 5 AS y, count(*) AS n_words, string_agg(text, ' ' ORDER BY x0, text) AS line FROM ({_GRID}) GROUP BY 1, 2")
def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rows(_grid(spark, sf_dir))


@query(
    f"""WITH g AS (SELECT doc, list_sort(list_distinct(list(x0))) AS xs FROM ({_GRID}) GROUP BY doc),
    c AS (SELECT doc, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > 50 THEN list_concat(a, x) ELSE a END) AS s FROM g)
    SELECT doc, array_to_string(list_transform(s, lambda x: CAST(x AS VARCHAR)), ',') AS starts FROM c"""
)
def layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column starts of each page: clusters of x within 50."""
    return _grid(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_set("x0")).alias("xs")).select("doc", F.array_join(layout.clusters(F.col("xs"), 50.0).cast("array<string>"), ",").alias("starts"))


@query(
    f"""WITH g AS ({_GRID}), c AS (SELECT unnest([0.0, 150.0, 300.0, 450.0]) AS c, unnest([0, 1, 2, 3]) AS i)
    SELECT doc, text, x0, top, CAST(arg_min(i, abs(x0 - c) * 1000 + i) AS BIGINT) AS col FROM g, c GROUP BY doc, text, x0, top"""
)
def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _grid(spark, sf_dir).distinct()
    columns = words.select("doc").distinct().withColumn("columns", F.array(*[F.lit(x) for x in (0.0, 150.0, 300.0, 450.0)]))
    return layout.nearest_column(words, columns).select("doc", "text", "x0", "top", "col")


@query(
    f"""WITH g AS (SELECT DISTINCT doc, x0 FROM ({_GRID})), l AS (SELECT doc, x0 - lag(x0) OVER (PARTITION BY doc ORDER BY x0) AS gap FROM g),
    a AS (SELECT doc, list_sort(coalesce(list(gap) FILTER (WHERE gap > 5), [])) AS q FROM l GROUP BY doc)
    SELECT doc, CASE WHEN len(q) < 3 THEN 35.0::DOUBLE ELSE least(greatest(q[CAST(floor(len(q) * 0.7::DOUBLE) AS BIGINT) + 1], 25.0), 50.0) END AS tolerance FROM a"""
)
def gap_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gap_tolerance(_grid(spark, sf_dir))


@query(
    """WITH f AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS place FROM lineitem WHERE l_quantity > 20),
    r AS (SELECT *, place - row_number() OVER (PARTITION BY doc ORDER BY place) AS g FROM f)
    SELECT doc, min(place) AS first, max(place) AS last, count(*) AS n FROM r GROUP BY doc, g"""
)
def table_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("place"), (F.col("l_quantity") > 20).alias("flag"))
    return layout.islands(rows)


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 100")
def audit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest hundred entries."""
    return _t(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("event_id")).limit(100)


@query(f"SELECT doc_id, CAST(floor({_WORDS} * 1.3::DOUBLE) AS BIGINT) + 1 AS tokens FROM documents")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.token_estimate(text.words(F.col("text"))).alias("tokens"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.event_windows(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS script, count(*) AS turns FROM conversations GROUP BY conv_id"""
)
def ordered_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["role"], F.lit(": "), p["text"])), "\n").alias("script"), F.count("*").alias("turns"))
