"""DuckDB SQL of the queries whose results SQL can state in full.

Near-duplicates: all pairs that share a shingle, counted on full sets, and the
transitive closure of the links.  Mixing: the water level of the targets, the
tilt of each source by halving a bracket 200 times, and running sums of words in
the order of the rounding key.  Both say what the result is by another way than
the operators find it.
"""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

MINHASH = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM tokens a JOIN tokens b ON a.h = b.h AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT DISTINCT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other
), least_id AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_id USING (doc_id)
"""

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size,
    (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE AS u FROM documents
), weighed AS (
  SELECT source, sum(size) AS s, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source
), full_first AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * s / w, source NULLS LAST) AS nth FROM weighed
), levels AS (
  SELECT *, (sum(s) OVER () - 3 * coalesce(sum(s) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM full_first
), targets AS (
  SELECT source, s, least(3.0::DOUBLE * s, w * coalesce((SELECT arg_min(share, nth) FROM levels WHERE 3.0::DOUBLE * s > w * share), 0)) AS target FROM levels
), counts AS (
  SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY source, size
), lists AS (
  SELECT source, list({{'z': size::DOUBLE, 'n': n::DOUBLE}} ORDER BY size) AS h, sum(n * size::DOUBLE * size) / sum(n * size) AS scale, min(size)::DOUBLE AS least_size FROM counts GROUP BY source
), tilts AS (
  SELECT source, scale, CASE WHEN target >= 3.0::DOUBLE * s THEN NULL ELSE list_reduce(range(0, 200), lambda b, i:
    CASE WHEN list_sum(list_transform(h, lambda e: e.n * e.z * least(3.0::DOUBLE, exp((b[1] + b[2]) / 2 * e.z / scale)))) < target
      THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END,
    [least(0.0::DOUBLE, ln(target / s) * scale / least_size), ln(3.0::DOUBLE) * scale / least_size]) END AS bracket
  FROM lists JOIN targets t USING (source)
  UNION ALL SELECT source, scale, CASE WHEN target >= 3.0::DOUBLE * s THEN NULL ELSE list_reduce(range(0, 200), lambda b, i:
    CASE WHEN list_sum(list_transform(h, lambda e: e.n * e.z * least(3.0::DOUBLE, exp((b[1] + b[2]) / 2 * e.z / scale)))) < target
      THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END,
    [least(0.0::DOUBLE, ln(target / s) * scale / least_size), ln(3.0::DOUBLE) * scale / least_size]) END
  FROM (SELECT * FROM lists WHERE source IS NULL) l, (SELECT s, target FROM targets WHERE source IS NULL) t
), rated AS (
  SELECT d.doc_id, d.source, d.size, d.u, t.s, t.target, CASE WHEN d.size = 0 THEN 0.0::DOUBLE WHEN b.bracket IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, exp((b.bracket[1] + b.bracket[2]) / 2 * d.size / b.scale)) END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN tilts b ON d.source IS NOT DISTINCT FROM b.source
), copied AS (
  SELECT *, least(floor(rate + 1e-9), 3)::BIGINT AS base FROM rated
), dues AS (
  SELECT source, greatest(0, least(round(any_value(target)), 3 * any_value(s))::BIGINT - sum(base * size)::BIGINT) AS due FROM copied GROUP BY source
), keyed AS (
  SELECT c.*, d.due, CASE WHEN rate > base AND size > 0 THEN u / (u + rate - base) END AS k FROM copied c JOIN dues d ON c.source IS NOT DISTINCT FROM d.source
), ordered AS (
  SELECT *, sum(CASE WHEN k IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k NULLS LAST) AS upto, sum(size) OVER (PARTITION BY source, k) AS here FROM keyed
)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target, (base * size + CASE WHEN k IS NULL OR due <= 0 OR upto - here >= due THEN 0 WHEN upto <= due THEN size
  ELSE size * (due - (upto - here)) // greatest(here, 1) END)::BIGINT AS taken FROM ordered
"""

ORACLE_SQL: dict[str, str] = {"op3_minhash": MINHASH, "op9_mixing": MIXING}
