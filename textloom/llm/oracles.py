"""DuckDB SQL for the training-data queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op8_curriculum_mix"] = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM sized GROUP BY source),
lev AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(3 * source_size) OVER w AS DOUBLE), 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level,
    CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio
  FROM per WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (
  SELECT source, weight, source_size, CASE WHEN ratio <= level THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(weight AS DOUBLE) * (SELECT arg_min(level, ratio) FROM lev WHERE ratio > level) END AS target FROM lev),
placed AS (
  SELECT d.*, t.weight, t.source_size, t.target,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
cop AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / CAST(source_size AS DOUBLE)) AS BIGINT) ELSE 0 END AS f FROM placed),
fit AS (
  SELECT *, target - f * source_size AS rest, size > 0 AND f < 3 AND before + size <= target - f * source_size AS inside FROM cop),
gap0 AS (SELECT source, any_value(rest) AS rest, any_value(rest) - sum(CASE WHEN inside THEN size ELSE 0 END) AS gap FROM fit WHERE size > 0 AND f < 3 GROUP BY source),
cand AS (
  SELECT source, doc_id, size, key FROM fit WHERE size > 0 AND f < 3 AND NOT inside
  QUALIFY row_number() OVER (PARTITION BY source, floor(ln(size) * 11.541560327111707 + 1e-6) ORDER BY size, key) = 1),
r1 AS (
  SELECT c.source, c.doc_id, c.size, g.gap FROM cand c JOIN gap0 g ON c.source IS NOT DISTINCT FROM g.source
  WHERE abs(g.gap - c.size) < g.gap
  QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY abs(g.gap - c.size), c.size, c.key) = 1),
gap1 AS (SELECT g.source, g.rest, g.gap - coalesce(r.size, 0) AS gap FROM gap0 g LEFT JOIN r1 r ON g.source IS NOT DISTINCT FROM r.source),
r2 AS (
  SELECT c.source, c.doc_id, c.size, g.gap FROM cand c JOIN gap1 g ON c.source IS NOT DISTINCT FROM g.source
  WHERE abs(g.gap - c.size) < g.gap AND c.doc_id NOT IN (SELECT doc_id FROM r1)
  QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY abs(g.gap - c.size), c.size, c.key) = 1),
gap2 AS (SELECT g.source, g.rest, g.gap - coalesce(r.size, 0) AS gap FROM gap1 g LEFT JOIN r2 r ON g.source IS NOT DISTINCT FROM r.source),
r3 AS (
  SELECT c.source, c.doc_id, c.size, g.gap FROM cand c JOIN gap2 g ON c.source IS NOT DISTINCT FROM g.source
  WHERE abs(g.gap - c.size) < g.gap AND c.doc_id NOT IN (SELECT doc_id FROM r1) AND c.doc_id NOT IN (SELECT doc_id FROM r2)
  QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY abs(g.gap - c.size), c.size, c.key) = 1),
gap3 AS (SELECT g.source, g.rest, g.gap - coalesce(r.size, 0) AS gap FROM gap2 g LEFT JOIN r3 r ON g.source IS NOT DISTINCT FROM r.source),
r4 AS (
  SELECT c.source, c.doc_id, c.size, g.gap FROM cand c JOIN gap3 g ON c.source IS NOT DISTINCT FROM g.source
  WHERE abs(g.gap - c.size) < g.gap AND c.doc_id NOT IN (SELECT doc_id FROM r1) AND c.doc_id NOT IN (SELECT doc_id FROM r2) AND c.doc_id NOT IN (SELECT doc_id FROM r3)
  QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY abs(g.gap - c.size), c.size, c.key) = 1),
gap4 AS (SELECT g.source, g.rest, g.gap - coalesce(r.size, 0) AS gap FROM gap3 g LEFT JOIN r4 r ON g.source IS NOT DISTINCT FROM r.source),
r5 AS (
  SELECT c.source, c.doc_id, c.size, g.gap FROM cand c JOIN gap4 g ON c.source IS NOT DISTINCT FROM g.source
  WHERE abs(g.gap - c.size) < g.gap AND c.doc_id NOT IN (SELECT doc_id FROM r1) AND c.doc_id NOT IN (SELECT doc_id FROM r2) AND c.doc_id NOT IN (SELECT doc_id FROM r3) AND c.doc_id NOT IN (SELECT doc_id FROM r4)
  QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY abs(g.gap - c.size), c.size, c.key) = 1),
gap5 AS (SELECT g.source, g.rest, g.gap - coalesce(r.size, 0) AS gap FROM gap4 g LEFT JOIN r5 r ON g.source IS NOT DISTINCT FROM r.source),
picks AS (
  SELECT p.doc_id, g.rest - p.gap AS late FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5) p
  JOIN gap0 g ON p.source IS NOT DISTINCT FROM g.source),
fin AS (
  SELECT t.*, CASE WHEN size > 0 THEN f + CASE WHEN inside OR late IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END AS copies,
    least(CASE WHEN f > 0 THEN CAST(before AS DOUBLE) ELSE f * source_size + CASE WHEN inside THEN CAST(before AS DOUBLE) ELSE late END END / greatest(target, 1.0), 1.0) AS share
  FROM fit t LEFT JOIN picks k USING (doc_id))
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(CASE weight WHEN 1 THEN (sqrt(1.5 * 1.5 + share * -2.0) - 1.5) / -1.0 + 0.0 WHEN 2 THEN share ELSE (sqrt(0.5 * 0.5 + share * 2.0) - 0.5) / 1.0 END, 9) END AS position
FROM fin
"""

ORACLES["op1_warc_revisits"] = """
WITH p AS (SELECT page_id AS id, url, md5(coalesce(html, '')) AS digest FROM pages),
r AS (
  SELECT id * 4 AS record_id, url AS uri, id * 10 AS ts, 'response' AS kind, id, digest FROM p
  UNION ALL SELECT id * 4 + 1, regexp_replace(url, '^(https?)://([^/?#]*)', 'https://www.\\2:443') || '#top', id * 10 + 5, 'revisit', id, digest FROM p
  UNION ALL SELECT id * 4 + 2, url, id * 10 - 3, 'revisit', id, digest FROM p WHERE id % 3 = 0),
b AS (SELECT *, regexp_replace(regexp_replace(uri, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www\\.', ''), ':(80|443)$', '') AS host,
  CASE WHEN regexp_extract(bare, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(bare, '^[^/?]*([^?]*)', 1) END AS path,
  list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS args FROM b),
k AS (SELECT record_id, ts, kind, id, digest, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url_key FROM c),
s AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN id END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pid FROM k),
j AS (
  SELECT s.record_id, s.url_key, s.ts, s.id, s.pid, q.digest AS pdigest,
    CASE s.id % 5 WHEN 0 THEN 'W/"' || substr(s.digest, 1, 12) || '"' WHEN 2 THEN '"changed"' WHEN 4 THEN '"' || substr(s.digest, 1, 12) || '"' END AS tag,
    '"' || substr(q.digest, 1, 12) || '"' AS ptag, CASE WHEN s.id % 5 IN (1, 4) THEN 'day ' || (s.id % 1000) END AS lm, 'day ' || (s.pid % 1000) AS plm
  FROM s LEFT JOIN p q ON s.pid = q.id WHERE s.kind = 'revisit'),
o AS (
  SELECT *, CASE WHEN pid IS NULL THEN 'no_prior' WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = ptag THEN 'resolved' ELSE 'mismatch' END
    WHEN lm IS NOT NULL THEN CASE WHEN lm = plm THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS outcome FROM j)
SELECT record_id, url_key, ts, outcome, pid * 4 AS response_id,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || (id * 10 + 5) || chr(10) || 'etag: ' || coalesce(tag, ptag)
    || chr(10) || 'last-modified: ' || coalesce(lm, plm) || chr(10) || 'server: a' END AS headers,
  CASE WHEN outcome = 'resolved' THEN pdigest END AS digest
FROM o
"""

ORACLES["op3_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c(vec_id, component) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, c.component FROM c JOIN l ON c.vec_id = l.a),
m AS (SELECT vec_id, min(component) AS component_id FROM c GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)
"""

ORACLES["op4_ngram_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
f AS (SELECT doc_id, unnest(s) AS x FROM s), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
c(doc_id, component) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, c.component FROM c JOIN l ON c.doc_id = l.a),
m AS (SELECT doc_id, min(component) AS component_id FROM c GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN m USING (doc_id)
"""

ORACLES["op11_chat_formatting"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '</?s>|\\[/?INST\\]|<</?SYS>>|\\[/?ROLE\\]|\\[TEXT\\]'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
      ELSE 23 + length(role) + len(regexp_extract_all(role, '</?s>|\\[/?INST\\]|<</?SYS>>|\\[/?ROLE\\]|\\[TEXT\\]')) END AS size
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""


def _codes() -> str:
    """Four rounds of assigning and moving, written out: each is a nearest-entry query and a mean by entry."""
    ctes = ["""k AS (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, p, q[p * (len(q) // 4) + 1 : (p + 1) * (len(q) // 4)] AS x FROM k, range(4) r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256))"""]
    for i in range(5):
        ctes.append(f"""d{i} AS (
  SELECT v.vec_id, v.p, b.e, CAST(list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v JOIN b{i} b USING (p)),
a{i} AS MATERIALIZED (
  SELECT vec_id, p, CAST(min(d * 256 + e) % 256 AS BIGINT) AS e, CAST(min(d * 256 + e) // 256 AS BIGINT) AS d FROM d{i} GROUP BY vec_id, p)""")
        if i < 4:
            ctes.append(f"""m{i} AS (
  SELECT p, e, j, CAST(floor_div AS BIGINT) AS c FROM (
    SELECT p, e, j, (s - ((s % n) + n) % n) // n AS floor_div FROM (
      SELECT a.p, a.e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN v USING (vec_id, p), range(1, (SELECT max(len(x)) FROM v) + 1) r(j) GROUP BY a.p, a.e, j))),
b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT p, e, list(c ORDER BY j) AS c FROM m{i} GROUP BY p, e) m USING (p, e))""")
    return "WITH " + ",\n".join(ctes) + """,
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b4),
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
s AS (SELECT r.*, label FROM r JOIN k USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM s
"""


ORACLES["op12_yinyang_codes"] = _codes()

ORACLES["op13_click_sessions"] = """
WITH RECURSIVE once AS (
  SELECT click_id, client_id, epoch_us(ts) AS ts, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 3600000000, false) AS late,
    coalesce(kind = 'purchase' AND value >= 60, false) AS final, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY client_id, ts) = 1),
o AS (SELECT *, row_number() OVER w AS i, lag(final) OVER w AS pf, ts - lag(ts) OVER w AS pause FROM once WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id)),
h AS (SELECT *, CASE WHEN pf THEN 'end' WHEN pause >= 1800000000 THEN 'gap' END AS reason FROM o),
r AS (
  SELECT client_id, i, ts AS start, 'first' AS why, true AS fresh FROM h WHERE i = 1
  UNION ALL
  SELECT h.client_id, h.i, CASE WHEN reason IS NOT NULL OR h.ts - r.start > 7200000000 THEN h.ts ELSE r.start END,
    coalesce(reason, 'length'), reason IS NOT NULL OR h.ts - r.start > 7200000000
  FROM r JOIN h ON h.client_id = r.client_id AND h.i = r.i + 1),
n AS (SELECT h.*, r.why, r.fresh, count(*) FILTER (r.fresh) OVER (PARTITION BY client_id ORDER BY i) AS session FROM h JOIN r USING (client_id, i)),
s AS (
  SELECT client_id, session, arg_min(click_id, i) AS session_id, min(ts) AS start_us, max(ts) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents,
    arg_min(why, i) AS why, arg_max(final, i) AS final, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY i)) AS path_sha256
  FROM n GROUP BY 1, 2),
t AS (SELECT *, lead(start_us) OVER w AS until, lead(why) OVER w AS after FROM s WINDOW w AS (PARTITION BY client_id ORDER BY session))
SELECT client_id, session_id, start_us, end_us, n_clicks,
  (SELECT count(*) FROM once l WHERE l.late AND l.client_id = t.client_id AND l.ts >= t.start_us AND (t.until IS NULL OR l.ts < t.until)) AS n_late,
  value_cents, coalesce(after, CASE WHEN final THEN 'end' ELSE 'none' END) AS closed_by, path_sha256
FROM t
"""
