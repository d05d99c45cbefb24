"""DuckDB SQL of the queries that SQL can express on whole tables."""

OP2 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (
  SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS MATERIALIZED (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS MATERIALIZED (
  SELECT rid, i, CASE WHEN lead(word, 4) OVER o IS NULL THEN NULL ELSE
    [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] END AS s
  FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS MATERIALIZED (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win WHERE s IS NOT NULL) WHERE c > 1),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid),
m AS MATERIALIZED (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
f AS MATERIALIZED (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words
      OR 10 * n_dup_lines > 3 * n_lines AS soft FROM m),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS bad FROM f GROUP BY source),
moments AS (SELECT avg(bad / n) AS mu, var_samp(bad / n) AS v FROM h),
prior AS (
  SELECT mu, least(greatest(CASE WHEN v > 0 AND mu > 0 AND mu < 1 THEN mu * (1 - mu) / v - 1 ELSE 2 END, 2), 1000) AS k
  FROM moments),
bad AS (SELECT source, bad + mu * k > 0.5 * (n + mu * k + (1 - mu) * k) AS host_rejected FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
  NOT base_failed AND NOT (host_rejected AND soft) AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""

OP8 = r"""
WITH l AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
spread AS MATERIALIZED (
  SELECT line FROM (SELECT coalesce('s' || source, 'n') AS site, unnest(ls) AS line FROM l)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT site) >= 8),
parts AS MATERIALIZED (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
marked AS (SELECT rid, i, parts.line, spread.line IS NOT NULL AS wide FROM parts LEFT JOIN spread USING (line)),
by_doc AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (wide) AS n_spread_lines,
    2 * coalesce(sum(length(line)) FILTER (NOT wide), 0) < sum(length(line)) AND count(*) FILTER (wide) > 0 AS left_whole,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT wide), '') AS kept
  FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_spread_lines, 0) AS n_spread_lines,
  coalesce(left_whole, false) AS left_whole,
  CASE WHEN left_whole OR n_spread_lines IS NULL THEN text ELSE kept END AS text
FROM l LEFT JOIN by_doc USING (rid)
"""

OP11 = r"""
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to
FROM f
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
cells AS MATERIALIZED (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(c, v)),
orders AS (
  SELECT x1.c || x2.c || x3.c || x4.c || x5.c AS filter_order, [x1.v, x2.v, x3.v, x4.v, x5.v] AS vs
  FROM b x1, b x2, b x3, b x4, b x5 WHERE (x1.v | x2.v | x3.v | x4.v | x5.v) = 31),
steps AS MATERIALIZED (
  SELECT filter_order, s::INT AS step, vs[s] AS bit, coalesce(list_sum(vs[1:s - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
