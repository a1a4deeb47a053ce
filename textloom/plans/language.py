"""Queries over segments, metrics, templates, script checks and translation; catalogue.py registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import bengali, chrf, legacy, script, segment, templates, text
from textloom.operators import translate
from textloom.operators.written import sent, written
from textloom.plans._registry import query, table

TEMPLATE = {"fields": [
    {"name": "mail", "pattern": "([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+)"}, {"name": "number", "pattern": "[0-9]{5,}"}, {"name": "caps", "type": "list", "pattern": "([A-Z]{3,})", "confidence_threshold": 0.85},
]}


@query(
    """WITH d AS (SELECT doc_id, regexp_extract(text, '([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+)', 1) AS mail, regexp_extract(text, '[0-9]{5,}') AS number, list_distinct(regexp_extract_all(text, '([A-Z]{3,})', 1)) AS caps FROM documents)
    SELECT doc_id, nullif(mail, '') AS mail, nullif(number, '') AS number, CAST(len(caps) AS BIGINT) AS caps, len(caps) >= 2 AS caps_passed,
    round((CASE WHEN mail <> '' THEN 1 ELSE 0 END + CASE WHEN number <> '' THEN 1 ELSE 0 END + CASE WHEN len(caps) > 0 THEN 1 ELSE 0 END) / 3.0::DOUBLE, 2) AS overall_confidence FROM d"""
)
def template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.extract(table(spark, sf_dir, "documents").select("doc_id", "text"), TEMPLATE)
    f = F.col("fields")
    first = lambda name: F.get(f[name]["value"], F.lit(0)).alias(name)
    return out.select("doc_id", first("mail"), first("number"), F.size(f["caps"]["value"]).cast("long").alias("caps"), f["caps"]["passed"].alias("caps_passed"), "overall_confidence")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{script.GRAPHEME}')) AS BIGINT) AS graphemes FROM documents")
def grapheme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(script.graphemes(F.col("text"))).cast("long").alias("graphemes"))


@query(
    """SELECT doc_id, md5(regexp_replace(replace(replace(regexp_replace(nfc_normalize(text), '(^|[^্])[‌‍]+', '\\1', 'g'), '||', '॥'), '|', '।'), '[ \\t]{2,}', ' ', 'g')) AS digest FROM documents"""
)
def normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(script.normalize(F.col("text")).cast("binary")).alias("digest"))


_BROKEN = "translate(text, 'abehst', 'কখ' || chr(2509) || chr(2494) || chr(2495) || chr(2509))"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split({_BROKEN}, chr(10))) AS s, generate_subscripts(string_split({_BROKEN}, chr(10)), 1) AS line FROM documents),
    c AS (SELECT doc_id, line, string_split(s, '') AS cs FROM l WHERE s <> ''), u AS (SELECT doc_id, line, unnest(cs) AS x, generate_subscripts(cs, 1) AS i FROM c),
    w AS (SELECT *, lag(x) OVER v AS a, lead(x) OVER v AS z FROM u WINDOW v AS (PARTITION BY doc_id, line ORDER BY i)),
    f AS (SELECT doc_id, line, x = chr(2509) AND (NOT coalesce(regexp_matches(a, '[\\x{{0995}}-\\x{{09B9}}\\x{{09DC}}-\\x{{09DF}}]'), false) OR NOT coalesce(regexp_matches(z, '[\\x{{0995}}-\\x{{09B9}}\\x{{09DC}}-\\x{{09DF}}]'), false)) AS orphan,
        regexp_matches(x, '[\\x{{09BE}}-\\x{{09CC}}]') AND coalesce(regexp_matches(z, '[\\x{{09BE}}-\\x{{09CC}}]'), false) AND NOT coalesce(regexp_matches(a, '[\\x{{09BE}}-\\x{{09CC}}]'), false) AS double FROM w)
    SELECT doc_id, CAST(count(*) FILTER (orphan) AS BIGINT) AS orphans, CAST(count(*) FILTER (double) AS BIGINT) AS doubles, CAST(coalesce(sum(line) FILTER (orphan), 0) + coalesce(sum(line) FILTER (double), 0) AS BIGINT) AS lines FROM f GROUP BY doc_id"""
)
def broken_conjuncts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of documents with six letters made Bengali consonants and signs: by kind, and the sum of their lines."""
    broken = F.translate("text", "abehst", "কখ\u09cd\u09be\u09bf\u09cd")
    d = table(spark, sf_dir, "documents").where("text != ''").select("doc_id", script.broken(broken).alias("b"))
    kind = lambda k: F.size(F.filter("b", lambda x: x["kind"] == k)).cast("long")
    return d.select("doc_id", kind("orphan_halant").alias("orphans"), kind("double_vowel_sign").alias("doubles"), F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["line"]).alias("lines"))


_W = "\\p{L}\\p{N}_"
_SHORT = "|".join(x.replace(".", "\\.") for x in segment.SHORT)


def _segments_sql(text: str) -> str:
    """CTEs that cut a text of documents as segments() does, character by character: s (doc_id, ord, text, label, kind)."""
    return f"""d AS (SELECT doc_id, {text} AS text FROM documents WHERE text <> ''),
    c0 AS (SELECT doc_id, regexp_extract_all(text, '```[^\\n]*\\n(?s:.)*?\\n```|~~~[^\\n]*\\n(?s:.)*?\\n~~~|`[^`\\n]+`|\\b(?i:https?|ftp|file)://[^\\s<>"''\\)\\]\\}}]+|\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b|(?s:.)') AS t FROM d),
    c1 AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM c0),
    c2 AS (SELECT *, length(x) > 1 AS kept, lag(length(x)) OVER (PARTITION BY doc_id ORDER BY i) > 1 AS behind FROM c1),
    c3 AS (SELECT *, sum(CASE WHEN kept OR behind THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c2),
    c4 AS (SELECT doc_id, g, bool_or(kept) AS kept, string_agg(x, '' ORDER BY i) AS x FROM c3 GROUP BY doc_id, g),
    l0 AS (SELECT doc_id, g, CASE WHEN regexp_full_match(x, '\\s+') THEN [x] ELSE regexp_extract_all(x, '[^\\n]*\\n|[^\\n]+') END AS ls FROM c4 WHERE NOT kept),
    l1 AS (SELECT doc_id, g, unnest(ls) AS x, generate_subscripts(ls, 1) AS j FROM l0),
    l2 AS (SELECT *, regexp_extract(x, '^(#{{1,6}}\\s+|>\\s*|\\s*(?:[*+-]|\\p{{Nd}}+\\.)\\s+)', 1) AS mark FROM l1),
    l3 AS (SELECT doc_id, g, j, CASE
        WHEN regexp_full_match(x, '\\s+') THEN [x] WHEN mark <> '' THEN [mark, substr(x, length(mark) + 1)]
        WHEN regexp_matches(x, '^\\s*\\|') AND regexp_matches(x, '\\|\\s*$') AND NOT regexp_full_match(x, '\\s*\\|(?:\\s*:?-+:?\\s*\\|)+\\s*') THEN regexp_extract_all(x, '\\||[^|]+') ELSE [x] END AS ps, CASE
        WHEN regexp_full_match(x, '\\s+') THEN 'prose' WHEN mark <> '' THEN 'mark' WHEN regexp_matches(x, '^\\s*\\|') AND regexp_matches(x, '\\|\\s*$') THEN CASE WHEN regexp_full_match(x, '\\s*\\|(?:\\s*:?-+:?\\s*\\|)+\\s*') THEN 'rule' ELSE 'row' END
        WHEN regexp_full_match(x, '\\s*[-*_]{{3,}}\\s*') THEN 'rule' ELSE 'prose' END AS what FROM l2),
    p0 AS (SELECT doc_id, g, j, what, unnest(ps) AS x, generate_subscripts(ps, 1) AS k FROM l3),
    p1 AS (SELECT *, what = 'rule' OR (what = 'mark' AND k = 1) OR (what = 'row' AND x = '|') AS syntax FROM p0 WHERE x <> ''),
    q0 AS (SELECT doc_id, g, j, k, x, string_split(x, '') AS cs FROM p1 WHERE NOT syntax AND NOT regexp_full_match(x, '\\s+')),
    q1 AS (SELECT doc_id, g, j, k, x, unnest(cs) AS c, generate_subscripts(cs, 1) AS n, len(cs) AS size FROM q0),
    q2 AS (SELECT *, regexp_matches(c, '\\s') AS sp, lead(c) OVER w AS after FROM q1 WINDOW w AS (PARTITION BY doc_id, g, j, k ORDER BY n)),
    q3 AS (SELECT *, c IN ('।', '!', '?', chr(10), '.') AND (c <> '.' OR ((after IS NULL OR regexp_matches(after, '\\s')) AND regexp_matches(left(x, n - 1), '[{_W}]$')))
        AND NOT regexp_matches(left(x, n - 1), '\\p{{Nd}}$') AND NOT regexp_matches(left(x, n - 1), '(?:^|[^{_W}])(?:{_SHORT})$') AS stop FROM q2),
    q4 AS (SELECT *, sp AND coalesce(last_value(CASE WHEN NOT sp THEN stop AND c = '.' END IGNORE NULLS) OVER (PARTITION BY doc_id, g, j, k ORDER BY n ROWS UNBOUNDED PRECEDING), false) AS eaten FROM q3),
    q5 AS (SELECT *, CASE WHEN c = '.' AND stop OR eaten THEN NOT coalesce(regexp_matches(after, '\\s'), false) ELSE stop END AS over FROM q4),
    q6 AS (SELECT *, coalesce(sum(CASE WHEN over THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g, j, k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM q5),
    q7 AS (SELECT doc_id, g, j, k, m, string_agg(c, '' ORDER BY n) AS x FROM q6 GROUP BY doc_id, g, j, k, m),
    w AS (SELECT *, list_transform(regexp_extract_all(x, '[{_W}\\x{{0980}}-\\x{{09FF}}]+'), lambda y: struct_pack(b := regexp_matches(y, '[\\x{{0980}}-\\x{{09FF}}]'), e := regexp_matches(y, '[a-zA-Z]'))) AS ws FROM q7),
    v AS (SELECT *, list_sum(list_transform(ws, lambda y: CASE WHEN y.b AND y.e THEN 0.5 WHEN y.b THEN 1 ELSE 0 END::DOUBLE)) AS bn, list_sum(list_transform(ws, lambda y: CASE WHEN y.b AND y.e THEN 0.5 WHEN y.e THEN 1 ELSE 0 END::DOUBLE)) AS en FROM w),
    s AS (
      SELECT doc_id, [g, 0, 0, 0] AS ord, x AS text, 'protected' AS label, CASE WHEN x LIKE '```%' OR x LIKE '~~~%' THEN 'code_block' WHEN x LIKE '`%' THEN 'inline_code' WHEN x LIKE '%://%' THEN 'url' ELSE 'email' END AS kind FROM c4 WHERE kept
      UNION ALL SELECT doc_id, [g, j, k, 0], x, CASE WHEN syntax THEN 'protected' ELSE 'whitespace' END, CASE WHEN syntax THEN 'markdown_syntax' ELSE 'whitespace' END FROM p1 WHERE syntax OR regexp_full_match(x, '\\s+')
      UNION ALL SELECT doc_id, [g, j, k, m], x, CASE WHEN regexp_full_match(x, '\\s+') THEN 'whitespace' WHEN coalesce(bn, 0) = 0 AND coalesce(en, 0) = 0 THEN 'en' WHEN bn >= 0.8 * (bn + en) THEN 'bn' WHEN en >= 0.8 * (bn + en) THEN 'en' ELSE 'mixed' END,
        CASE WHEN regexp_full_match(x, '\\s+') THEN 'whitespace' ELSE 'text' END FROM v)"""


_MARKED = "'# ' || replace(replace(replace(replace(text, 'er ', 'এর '), '. ', '.' || chr(10) || '- '), ' the ', ' `the` '), ' and ', ' http://h/and ') || chr(10) || '| a1 | b. c |' || chr(10) || '|---|---|'"


@query(f"WITH {_segments_sql(_MARKED)} SELECT label, kind, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars, TRUE AS lossless FROM s GROUP BY label, kind")
def segment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents made Markdown in two scripts, by label and kind, and whether they rebuild their texts."""
    marked = F.replace(F.replace("text", F.lit("er "), F.lit("এর ")), F.lit(". "), F.lit(".\n- "))
    marked = F.replace(F.replace(marked, F.lit(" the "), F.lit(" `the` ")), F.lit(" and "), F.lit(" http://h/and "))
    marked = F.concat(F.lit("# "), marked, F.lit("\n| a1 | b. c |\n|---|---|"))
    docs = table(spark, sf_dir, "documents").where("text != ''").repartition(spark.sparkContext.defaultParallelism)  # a file of one row group is one task
    d = docs.select("doc_id", marked.alias("text")).withColumn("s", segment.segments(F.col("text")))
    d = d.select((segment.rejoin(F.col("s")) == F.col("text")).alias("whole"), "s")  # once a document, not beside each of its segments
    rows = d.select("whole", F.explode("s").alias("s"))
    return rows.groupBy("s.label", "s.kind").agg(F.count("*").alias("segments"), F.sum(F.length("s.text")).alias("chars"), F.bool_and("whole").alias("lossless"))


@query(
    f"""WITH {_segments_sql("text")}, mem AS (SELECT trim(text) AS source, CAST(min(item_id) AS VARCHAR) AS target FROM benchmark GROUP BY 1),
    j AS (SELECT s.*, label IN ('en', 'mixed') AS todo, target FROM s LEFT JOIN mem ON label IN ('en', 'mixed') AND trim(s.text) = source),
    r AS (SELECT doc_id, string_agg(CASE WHEN target IS NULL THEN text ELSE regexp_extract(text, '^( *)', 1) || target || regexp_extract(text, '( *)$', 1) END, '' ORDER BY ord) AS text, count(*) AS segments, count_if(todo) AS translated, count_if(target IS NOT NULL) AS from_memory FROM j GROUP BY doc_id)
    SELECT d.doc_id, md5(coalesce(r.text, d.text, '')) AS digest, coalesce(segments, 0) AS segments, coalesce(translated, 0) AS translated, coalesce(from_memory, 0) AS from_memory FROM documents d LEFT JOIN r USING (doc_id)"""
)
def document_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with segments of the benchmark's texts as memory; other text stays."""
    memory = table(spark, sf_dir, "benchmark").groupBy(F.trim("text").alias("source_text")).agg(F.min("item_id").cast("string").alias("target_text")).withColumn("direction", F.lit("to_bn"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)
    out = translate.translate(docs, "bn", memory, floor=None)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "segments", "translated", "from_memory")


@query()
def similar_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altered part names translated from a memory of the names: exact misses take the closest entry, the rest the engine."""
    p = table(spark, sf_dir, "part")
    memory = p.groupBy(F.trim("p_name").alias("source_text")).agg(F.min("p_partkey").cast("string").alias("target_text")).withColumn("direction", F.lit("to_bn"))
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.replace("p_name", F.lit("e"), F.lit("ee")).alias("text"))
    return translate.translate(docs, "bn", memory)


def _chrf_sql(pairs: str) -> str:
    """Sentence chrF++ of pairs (id, hyp, ref): CTE f (id, score), by counting all n-grams of both sides."""
    marks = "[!-/:-@\\[-`{-~]"
    return f"""x AS ({pairs}),
    t AS (SELECT id, 0 AS ref, hyp AS text FROM x UNION ALL SELECT id, 1, ref FROM x),
    k AS (SELECT id, ref, regexp_replace(text, '\\s+', '', 'g') AS chars, flatten(list_transform(regexp_extract_all(text, '\\S+'), lambda w:
        CASE WHEN length(w) > 1 AND regexp_matches(w, '{marks}$') THEN [left(w, -1), right(w, 1)] WHEN length(w) > 1 AND regexp_matches(w, '^{marks}') THEN [left(w, 1), substr(w, 2)] ELSE [w] END)) AS toks FROM t),
    ch AS (SELECT id, ref, string_split(chars, '') AS cs FROM k WHERE chars <> ''),
    g AS (SELECT id, ref, n, array_to_string(cs[i:i + n - 1], '') AS gram FROM ch, range(1, 7) r(n), range(1, 100000) q(i) WHERE i + n - 1 <= len(cs)
        UNION ALL SELECT id, ref, n + 6, array_to_string(toks[i:i + n - 1], chr(0)) FROM k, range(1, 3) r(n), range(1, 100000) q(i) WHERE i + n - 1 <= len(toks)),
    c AS (SELECT id, ref, n, gram, count(*) AS c FROM g GROUP BY ALL),
    m AS (SELECT a.id, a.n, sum(least(a.c, b.c)) AS m FROM c a JOIN c b ON a.id = b.id AND a.n = b.n AND a.gram = b.gram AND a.ref = 0 AND b.ref = 1 GROUP BY 1, 2),
    o AS (SELECT id, n, sum(CASE WHEN ref = 0 THEN c ELSE 0 END) AS h, sum(CASE WHEN ref = 1 THEN c ELSE 0 END) AS r FROM c GROUP BY 1, 2),
    e AS (SELECT id, avg(coalesce(m, 0) / h::DOUBLE) AS p, avg(coalesce(m, 0) / r::DOUBLE) AS q FROM o LEFT JOIN m USING (id, n) WHERE h > 0 AND r > 0 GROUP BY id),
    f AS (SELECT id, round(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END, 2) AS score FROM e)"""


@query(
    f"""WITH b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), {_chrf_sql("SELECT conv_id * 1000 + turn AS id, text AS hyp, before AS ref FROM b WHERE text <> '' AND before <> ''")}
    SELECT conv_id, turn, coalesce(score, 0) AS score, coalesce(score, 0) < 40 AS drifted FROM b LEFT JOIN f ON id = conv_id * 1000 + turn"""
)
def drift_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"))
    return rows.select("conv_id", "turn", chrf.drift(F.col("before"), F.col("text")).alias("d")).select("conv_id", "turn", "d.*")


@query()
def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the smallest document of their language and source."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "text")
    # texts are sorted to be aggregated, and shuffled to be joined: only those of the smallest ids are, unless the sources themselves are many
    low = written(d.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id")))
    first = d.join(sent(low), ["lang", "source", "doc_id"], "semi").groupBy("lang", "source").agg(F.min_by("text", "doc_id").alias("ref"))
    first = sent(written(low.join(first, ["lang", "source"], "left").select("lang", "source", "ref")))
    return chrf.corpus_scores(d.join(first, ["lang", "source"]).select("lang", F.col("text").alias("hyp"), "ref"), ["lang"])


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '\\r\\n') THEN 'CRLF' WHEN regexp_matches(text, '\\r') THEN 'CR' ELSE 'LF' END AS ending, CASE WHEN regexp_matches(text, '(^|\\n)\\t') THEN 'tab' WHEN regexp_matches(text, '(^|\\n)  ') THEN 'space' ELSE 'none' END AS indent FROM documents")
def line_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.line_ending(F.col("text")).alias("ending"), text.indent(F.col("text")).alias("indent"))


@query(
    """WITH t AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
    f AS (SELECT *, first(CASE WHEN regexp_matches(s, '[^ \\t\\n\\x0B\\f\\r]') THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM l)
    SELECT doc_id, CAST(n AS BIGINT) AS line, CAST(nx AS BIGINT) AS next_line FROM f WHERE nx > n + 1"""
)
def next_filled_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines followed by blank ones, with the next line that holds text; a fold from the last line, inside the row."""
    blank = F.replace("text", F.lit(". "), F.lit(".\n \n"))  # sentences end in blank lines
    filled = F.transform(F.split(blank, "\n", -1), lambda s, i: F.struct((i + 1).cast("long").alias("line"), s.rlike("[^ \\t\\n\\x0B\\f\\r]").alias("full")))
    empty = F.expr("cast(array() as array<struct<line: bigint, next_line: bigint>>)")
    start = F.struct(F.lit(None).cast("long").alias("next"), empty.alias("out"))
    step = lambda a, x: F.struct(F.when(x["full"], x["line"]).otherwise(a["next"]).alias("next"), F.when(a["next"] > x["line"] + 1, F.concat(a["out"], F.array(F.struct(x["line"].alias("line"), a["next"].alias("next_line"))))).otherwise(a["out"]).alias("out"))
    found = F.aggregate(F.reverse(filled), start, step)
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(found["out"]))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\$\\$[^$]+\\$\\$|\\$[^$\\n]+\\$')) AS BIGINT) AS math, CAST(len(list_filter(string_split_regex(text, '\\n(?:-{3,}|\\*{3,}|_{3,})[ \\t]*\\n'), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))) AS BIGINT) AS slides FROM documents")
def math_and_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(text.MATH)).cast("long").alias("math"), F.size(text.slides(F.col("text"))).cast("long").alias("slides"))


@query("SELECT doc_id, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda x: NOT list_contains(['the', 'of', 'and', 'a', 'in', 'to', 'is'], x))) AS BIGINT) AS unknown FROM documents")
def words_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words outside a vocabulary."""
    known = F.array(*[F.lit(w) for w in ("the", "of", "and", "a", "in", "to", "is")])
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_except(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), known)).cast("long").alias("unknown"))


@query(
    """WITH g AS (SELECT 0 AS pri, n_name AS term, n_regionkey AS target FROM nation UNION ALL SELECT 1, r_name, r_regionkey + 100 FROM region UNION ALL SELECT 2, n_name, n_nationkey + 200 FROM nation WHERE n_nationkey % 2 = 0)
    SELECT term, arg_max(target, pri) AS target, count(*) AS entries FROM g GROUP BY term"""
)
def glossary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossaries one over another: for a term in several the last wins."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entry = lambda df, pri, term, target: df.select(F.lit(pri).alias("pri"), F.col(term).alias("term"), target.cast("long").alias("target"))
    every = entry(n, 0, "n_name", F.col("n_regionkey")).unionByName(entry(r, 1, "r_name", F.col("r_regionkey") + 100)).unionByName(entry(n.where("n_nationkey % 2 = 0"), 2, "n_name", F.col("n_nationkey") + 200))
    return every.groupBy("term").agg(F.max_by("target", "pri").alias("target"), F.count("*").alias("entries"))


@query("SELECT l_linenumber AS col, greatest(3, max(length(CAST(l_partkey AS VARCHAR)))) AS width, avg(CASE WHEN length(CAST(l_partkey AS VARCHAR)) > 3 THEN 1.0 ELSE 0.0 END) <= 0.3 AS short_cells FROM lineitem GROUP BY 1")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of each column of a made-up table, and whether at most 30 % of its cells are long."""
    n = F.length(F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("col")).agg(F.greatest(F.lit(3), F.max(n)).cast("long").alias("width"), (F.avg(F.when(n > 3, 1.0).otherwise(0.0)) <= 0.3).alias("short_cells"))


@query(
    f"""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS legacy, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{bengali.DIGITS}') AS back, TRUE AS words_back FROM orders"""
)
def legacy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in digits and words, written in the legacy encoding and read again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", bengali.number_words(F.col("o_orderkey")).alias("w"), bengali.to_bengali_digits(F.col("o_orderkey").cast("string")).alias("d"))
    o = o.withColumn("legacy", legacy.to_legacy_column("d"))
    again = legacy.read_column(legacy.to_legacy_column(F.col("w")))
    return o.select("o_orderkey", "legacy", legacy.read_column("legacy").alias("back"), (again == script.nfc(F.col("w"))).alias("words_back"))


@query()
def encoding_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that hold text as they are, with the verdict on their encoding, the text in Unicode, and whether it is the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)  # a file of one row group is one task
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("n", "text")).where(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    out = p.withColumn("v", legacy.encoding(F.col("text")))
    converted = F.when(F.col("v.label") == "legacy", legacy.legacy_markdown_column(F.when(F.col("v.label") == "legacy", F.col("text")))).otherwise(F.col("text"))
    out = out.select("doc_id", F.col("n").cast("long").alias("paragraph"), "v.label", "v.confidence", F.col("text").alias("original"), converted.alias("converted"))
    return out.withColumn("kept", F.col("original") == F.col("converted"))
