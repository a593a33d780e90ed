"""DuckDB texts of the queries that SQL can express: written from their
definitions, without the operators' own methods."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = r"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
first AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (g) WHERE d < doc_id),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

OP4 = rf"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
gram AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM gram),
win AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
hit AS (SELECT r, i, win.n, item_id FROM win JOIN gram ON win.g = gram.g AND win.n = gram.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body) AS n, sha256(body) AS d, min(page_id) OVER (PARTITION BY body) AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND f IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f IS DISTINCT FROM page_id THEN f END AS refers_to
FROM q
"""

OP7 = rf"""
WITH u AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT *, host = 'org' OR host LIKE '%.org' AS org, host = 'com' OR host LIKE '%.com' AS com,
    host = 'example.org' OR host LIKE '%.example.org' AS example FROM u),
m AS (SELECT *, CASE
    WHEN example AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN example AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN org AND starts_with(path, '/') THEN 'org/'
    WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN com AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM f)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""

# Targets: sources are cut to their cap from the smallest cap per weight on.
OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM s),
a AS (SELECT *,
    ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER before, 0))::BIGINT AS words_left,
    ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER before, 0))::BIGINT AS w_left
  FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, cap >= words_left / w_left * w AS free FROM a),
water AS (SELECT arg_min(words_left / w_left, cap / w) AS level FROM b WHERE free),
t AS (SELECT source, source_size, CASE WHEN free THEN (SELECT level FROM water) * w ELSE cap::DOUBLE END AS target FROM b),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    (row_number() OVER (PARTITION BY d.source ORDER BY greatest(length(bin(size)) - 5, 0) * 16 + (size >> greatest(length(bin(size)) - 5, 0)::BIGINT), key) - 1)::DOUBLE AS k,
    CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS r,
    ('0x' || substr(md5('mix-1|' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target, ((floor(u + r * (k + 1)) - floor(u + r * k)) * size)::BIGINT AS taken
FROM o
"""

OP11 = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS same,
         CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, b.v) END::BIGINT AS score
  FROM e a JOIN e b ON len(a.v) = len(b.v) AND a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id NULLS LAST) <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.other_id NULLS LAST) AS place
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5
"""

OP13 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT row_number() OVER () AS q, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
asked AS (SELECT q, item_id, unnest(w) AS t FROM item),
size AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM doc WHERE len(w) > 0),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM doc) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weight AS (
  SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), size),
part AS (
  SELECT r, t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(w)::BIGINT * n) // l)))) AS s
  FROM tf JOIN weight USING (t) JOIN doc USING (r), size),
scored AS (SELECT q, item_id, r, sum(s)::BIGINT AS score FROM asked JOIN part USING (t) GROUP BY q, item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored JOIN doc USING (r) WHERE score > 0
QUALIFY rank <= 50
"""

ORACLES = {"op2_substring": OP2, "op4_decontaminate": OP4, "op5_warc": OP5, "op7_url_filter": OP7, "op9_mix": OP9,
           "op11_hard_negatives": OP11, "op13_search": OP13}
