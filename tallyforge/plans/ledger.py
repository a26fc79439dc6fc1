"""Queries on findings and entries: health, trends, hot spots, staleness, claims, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import ledger as L
from tallyforge.operators.joins import numbered
from tallyforge.plans.views import CTE, entries, findings, modules
from tallyforge.registry import Registry
from tallyforge.session import materialise

R = Registry()


@R.query(
    "chain_health",
    CTE
    + """
SELECT f.project, count(*) AS total, count(*) FILTER (coalesce(f.status, '') NOT IN ('closed', 'promoted')) AS active,
  count(*) FILTER (f.status = 'closed') AS closed, count(*) FILTER (f.status = 'promoted') AS promoted,
  count(*) FILTER (a.sev = 'risk') AS severity_risk, count(*) FILTER (a.sev = 'debt') AS severity_debt,
  count(*) FILTER (a.sev = 'observation') AS severity_observation, count(*) FILTER (a.sev = 'unclassified') AS severity_unclassified,
  count(*) FILTER (a.act = 'promote') AS action_promote, count(*) FILTER (a.act = 'scope') AS action_scope,
  count(*) FILTER (a.act = 'monitor') AS action_monitor, count(*) FILTER (a.act = 'acknowledge') AS action_acknowledge,
  count(*) FILTER (a.act = 'unclassified') AS action_unclassified
FROM f LEFT JOIN a USING (finding_id) GROUP BY f.project
""",
)
def chain_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.chain_health(findings(spark, sf_dir, "status", "severity", "suggested_action"))


@R.query(
    "trajectory",
    CTE
    + """,
r AS (SELECT project, entry_idx, count(*) FILTER (severity = 'risk') AS risks FROM f WHERE nullif(severity, '') IS NOT NULL GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY entry_idx) AS pos, count(*) OVER (PARTITION BY project) AS n FROM r),
m AS (SELECT project, count(*) AS classified, floor(avg(risks) * 10 + 0.5) / 10 AS risks_all, floor(avg(risks) FILTER (pos > n - 5) * 10 + 0.5) / 10 AS risks_recent,
  avg(risks) FILTER (pos <= n // 2) AS first, avg(risks) FILTER (pos > n // 2) AS second FROM p GROUP BY project),
u AS (SELECT project, count(*) FILTER (nullif(severity, '') IS NULL) AS unclassified FROM f GROUP BY project)
SELECT u.project, unclassified, coalesce(classified, 0) AS classified, risks_all, risks_recent,
  CASE WHEN classified IS NULL THEN 'no_classified_data' WHEN classified < 10 THEN 'insufficient_data' WHEN second < first THEN 'improving' WHEN second > first THEN 'worsening' ELSE 'stable' END AS trend
FROM u LEFT JOIN m ON u.project IS NOT DISTINCT FROM m.project
""",
)
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.trajectory(findings(spark, sf_dir, "severity"))


_HOT = """
SELECT project, file, count(*) AS findings, count(DISTINCT entry_idx) AS entries, count(*) FILTER (sev = 'risk') AS risk,
  count(*) FILTER (sev = 'debt') AS debt, count(*) FILTER (sev = 'observation') AS observation, count(*) FILTER (sev = 'unclassified') AS unclassified,
  min(entry_idx::BIGINT * 1000000 + f_idx) AS first
FROM a WHERE nullif(file, '') IS NOT NULL GROUP BY project, file HAVING count(*) >= 3 AND count(DISTINCT entry_idx) >= 2
"""


@R.query(
    "hot_modules",
    CTE
    + f""", h AS ({_HOT})
SELECT * EXCLUDE (first), row_number() OVER (PARTITION BY project ORDER BY findings DESC, first, file) AS rank FROM h QUALIFY rank <= 5
""",
)
def hot_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hot_modules(findings(spark, sf_dir, "status", "severity", "file")).withColumn("rank", F.col("rank").cast("bigint"))


@R.query(
    "promotion_candidates",
    CTE
    + """
SELECT project, suggested_action, id, coalesce(nullif(severity, ''), 'unclassified') AS severity, file, entry_idx, NULL::BIGINT AS recurrence FROM a WHERE suggested_action = 'promote'
UNION ALL
SELECT project, 'scope', arg_max(struct_pack(x := id), (entry_idx, f_idx)).x, coalesce(nullif(arg_max(struct_pack(x := severity), (entry_idx, f_idx)).x, ''), 'unclassified'),
  arg_max(struct_pack(x := file), (entry_idx, f_idx)).x, max(entry_idx), count(*)
FROM a WHERE suggested_action = 'scope' GROUP BY project, coalesce(severity, ''), coalesce(category, ''), coalesce(file, '') HAVING count(*) >= 2
""",
)
def promotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.promotion_candidates(findings(spark, sf_dir, "id", "status", "severity", "category", "suggested_action", "file"))


@R.query(
    "promotion_effect",
    CTE
    + """,
p AS (SELECT f.project, f.entry_idx, f.f_idx, f.id, c.runs - c.pos AS later,
  (SELECT count(*) FROM f s WHERE s.project = f.project AND s.entry_idx > f.entry_idx AND s.severity = coalesce(f.severity, '') AND s.category = coalesce(f.category, '') AND s.file IS NOT DISTINCT FROM f.file) AS matches
  FROM f JOIN chain c USING (entry_idx) WHERE f.status = 'promoted'),
q AS (SELECT *, CASE WHEN later >= 5 THEN CAST(floor((1 - matches::DOUBLE / later) * 100 + 0.5) AS BIGINT) END AS reduction_pct FROM p)
SELECT *, CASE WHEN later < 5 THEN 'tracking' WHEN reduction_pct > 0 THEN 'effective' ELSE 'ineffective' END AS effect FROM q
""",
)
def promotion_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialise(findings(spark, sf_dir, "id", "status", "severity", "category", "file"), "findings")
    return L.promotion_effect(own, materialise(entries(spark, sf_dir), "entries"))


@R.query(
    "first_pass",
    CTE
    + """
SELECT project, count(*) AS runs, count(*) FILTER (coalesce(rejection_cycles, 0) = 0) AS first_pass,
  CAST(floor(avg(CASE WHEN coalesce(rejection_cycles, 0) = 0 THEN 100.0::DOUBLE ELSE 0.0 END) + 0.5) AS BIGINT) AS first_pass_pct,
  CAST(sum(coalesce(len(previous_failures), 0)) AS BIGINT) AS caught
FROM e GROUP BY project
""",
)
def first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_pass(entries(spark, sf_dir, "rejection_cycles", "previous_failures"))


@R.query(
    "stage_medians",
    CTE
    + """
SELECT project, count(*) AS timed, percentile_disc(0.5) WITHIN GROUP (ORDER BY timing.total_minutes)::DOUBLE AS median_total,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY timing.think)::DOUBLE AS median_think, percentile_disc(0.5) WITHIN GROUP (ORDER BY timing.plan)::DOUBLE AS median_plan,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY timing.build)::DOUBLE AS median_build, percentile_disc(0.5) WITHIN GROUP (ORDER BY timing.verify)::DOUBLE AS median_verify
FROM e WHERE timing.total_minutes > 0 GROUP BY project HAVING count(*) >= 3
""",
)
def stage_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stage_medians(entries(spark, sf_dir, "timing"))


@R.query(
    "rounded_medians",
    CTE
    + "SELECT project, "
    + ", ".join(f"CAST(floor(quantile_cont(timing.{s}::DOUBLE, 0.5) FILTER (timing.{s} > 0) + 0.5) AS BIGINT) AS median_{s}" for s in ("total_minutes", "think", "plan", "build", "verify"))
    + " FROM e GROUP BY project",
)
def rounded_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rounded_medians(entries(spark, sf_dir, "timing"))


@R.query(
    "corpus_totals",
    CTE
    + """
SELECT count(*) AS entries, CAST(sum(coalesce(len(assertions), 0)) AS BIGINT) AS assertions, count(*) FILTER (rejection_cycles > 0) AS rejected,
  (SELECT count(*) FROM f) AS findings FROM e
""",
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.corpus_totals(entries(spark, sf_dir, "assertions", "rejection_cycles"), findings(spark, sf_dir))


@R.query(
    "stale_findings",
    CTE
    + """,
n AS (SELECT project, file, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT a.project, a.entry_idx, f_idx, id, severity, a.file, count(*) AS touches, any_value(c.runs - c.pos) AS later, any_value(n.n / c.runs) AS rate
  FROM a JOIN t ON t.project = a.project AND t.file = a.file AND t.entry_idx > a.entry_idx
  JOIN chain c ON c.entry_idx = a.entry_idx JOIN n ON n.project = a.project AND n.file = a.file
  WHERE nullif(a.file, '') IS NOT NULL GROUP BY a.project, a.entry_idx, f_idx, id, severity, a.file, a.finding_id),
x AS (SELECT *, greatest(3, ceil(later * rate)) AS expected FROM s)
SELECT project, entry_idx, f_idx, id, severity, file, touches, later,
  CASE WHEN later < 5 THEN CASE WHEN touches >= 3 THEN 'high' ELSE 'medium' END WHEN touches >= expected THEN 'high' ELSE 'medium' END AS confidence
FROM x WHERE later < 5 OR touches >= ceil(expected * 0.5)
""",
)
def stale_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = materialise(modules(spark, sf_dir).select("project", "entry_idx", "file"), "touched")
    own = materialise(findings(spark, sf_dir, "id", "status", "severity", "file"), "findings")
    return L.staleness(own, touched, materialise(entries(spark, sf_dir), "entries"))


@R.query(
    "resolution_claims",
    CTE
    + """,
o AS (SELECT project, id, arg_max(struct_pack(s := coalesce(status, 'active'), file := file, severity := severity), (entry_idx, f_idx)) AS o FROM f WHERE nullif(id, '') IS NOT NULL GROUP BY ALL),
c AS (SELECT project, entry_idx, f_idx, coalesce(id, 'unknown') AS upstream_id, unnest(resolves) AS referenced_id, unnest(range(len(resolves))) AS nth FROM f WHERE category = 'upstream')
SELECT c.project, referenced_id, arg_max(upstream_id, (entry_idx, f_idx, nth)) AS upstream_id, max(entry_idx) AS entry_idx, any_value(o.file) AS file, coalesce(any_value(o.severity), 'unclassified') AS severity
FROM c JOIN o ON o.project = c.project AND o.id = referenced_id WHERE o.s = 'active' GROUP BY c.project, referenced_id
""",
)
def resolution_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolution_claims(findings(spark, sf_dir, "id", "status", "severity", "category", "file", "resolves"))


@R.query(
    "audit_by_file",
    CTE
    + """,
b AS (SELECT *, coalesce(nullif(file, ''), '(no file)') AS fl, CASE severity WHEN 'risk' THEN 0 WHEN 'debt' THEN 1 WHEN 'observation' THEN 2 ELSE 3 END AS r FROM a),
c AS (SELECT project, fl, count(*) AS in_file FROM b GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY in_file DESC, fl) AS file_rank FROM c QUALIFY file_rank <= 8)
SELECT b.project, file_rank, b.fl AS file, in_file, greatest(in_file - 3, 0) AS more,
  row_number() OVER (PARTITION BY b.project, b.fl ORDER BY r, entry_idx DESC, f_idx) AS place, id, severity, entry_idx
FROM b JOIN k ON b.project = k.project AND b.fl = k.fl QUALIFY place <= 3
""",
)
def audit_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.audit_by_file(findings(spark, sf_dir, "id", "status", "severity", "file"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("file_rank", "place")})


@R.query(
    "severity_by_action",
    CTE + "SELECT CASE WHEN grouping(sev) = 1 THEN 'all' ELSE sev END AS severity, CASE WHEN grouping(act) = 1 THEN 'all' ELSE act END AS action, count(*) AS findings FROM a GROUP BY CUBE (sev, act)",
)
def severity_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.severity_by_action(findings(spark, sf_dir, "status", "severity", "suggested_action"))


@R.query(
    "by_surface",
    CTE
    + """,
n AS (SELECT entry_idx, count(*) AS n FROM a GROUP BY ALL)
SELECT project, coalesce(nullif(surface, ''), 'Unscoped') AS surface, count(*) AS runs, CAST(coalesce(sum(n), 0) AS BIGINT) AS active, max(entry_idx) AS latest
FROM e LEFT JOIN n USING (entry_idx) GROUP BY 1, 2
""",
)
def by_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_surface(entries(spark, sf_dir, "surface"), findings(spark, sf_dir, "status"))


@R.query(
    "dashboard_modules",
    CTE + "SELECT a.project, file, count(*) AS findings, count(DISTINCT slug) AS items FROM a JOIN e USING (entry_idx) WHERE nullif(file, '') IS NOT NULL GROUP BY ALL HAVING items >= 2",
)
def dashboard_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dashboard_modules(findings(spark, sf_dir, "status", "file"), entries(spark, sf_dir, "slug"))


@R.query(
    "risk_scores",
    CTE + "SELECT project, file, CAST(sum(CASE severity WHEN 'risk' THEN 3 WHEN 'debt' THEN 2 WHEN 'observation' THEN 1 ELSE 0 END) AS BIGINT) AS score, count(*) AS findings FROM a WHERE nullif(file, '') IS NOT NULL GROUP BY ALL",
)
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.risk_scores(findings(spark, sf_dir, "status", "severity", "file"))


@R.query(
    "severity_rollup",
    CTE
    + """,
c AS (SELECT entry_idx, CASE WHEN severity IN ('risk', 'debt', 'observation') THEN severity ELSE 'unclassified' END AS s, count(*) AS n FROM f GROUP BY ALL)
SELECT entry_idx, string_agg(n || ' ' || s, ', ' ORDER BY CASE s WHEN 'risk' THEN 0 WHEN 'debt' THEN 1 WHEN 'observation' THEN 2 ELSE 3 END) AS rollup FROM c GROUP BY entry_idx
""",
)
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.severity_rollup(findings(spark, sf_dir, "severity"))


@R.query(
    "health_change",
    CTE
    + f""", h AS ({_HOT}),
z AS (SELECT project, max(entry_idx) AS last FROM e GROUP BY project),
g AS ({_HOT.replace("FROM a WHERE", "FROM a JOIN z USING (project) WHERE entry_idx < last AND")})
SELECT coalesce(h.project, g.project) AS project, coalesce(h.file, g.file) AS file, CASE WHEN g.file IS NULL THEN 'new' ELSE 'gone' END AS change
FROM h FULL JOIN g ON h.project = g.project AND h.file = g.file WHERE h.file IS NULL OR g.file IS NULL
""",
)
def health_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.health_change(findings(spark, sf_dir, "status", "severity", "file"), entries(spark, sf_dir))


@R.query("active_findings", CTE + "SELECT finding_id, project, id, file FROM a")
def active_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01: a missing or empty status means active."""
    return findings(spark, sf_dir, "id", "file", "status").filter(L.is_active(F.col("status"))).select("finding_id", "project", "id", "file")


@R.query(
    "audit_filters",
    CTE
    + """
SELECT finding_id, a.project, coalesce(nullif(severity, ''), 'unclassified') AS severity, surface FROM a JOIN e USING (entry_idx)
WHERE coalesce(nullif(severity, ''), 'unclassified') IN ('risk', 'unclassified') AND surface IN ('cli', 'engine')
  AND try_cast(substr(completed_at, 1, 10) AS DATE) > DATE '2024-06-01'
""",
)
def audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08: severities with a sentinel for none, surface, and strictly after a date; an entry whose date cannot be read drops out."""
    e = entries(spark, sf_dir, "surface", "completed_at").filter(F.col("surface").isin("cli", "engine") & (F.expr("try_cast(substr(completed_at, 1, 10) AS date)") > F.lit("2024-06-01").cast("date")))
    sev = F.coalesce(L.given(F.col("severity")), F.lit("unclassified"))
    a = findings(spark, sf_dir, "severity", "status").filter(L.is_active(F.col("status")) & sev.isin("risk", "unclassified"))
    return a.join(e.select(F.col("entry_idx").alias("e"), "surface"), F.col("entry_idx") == F.col("e")).select("finding_id", "project", sev.alias("severity"), "surface")


@R.query(
    "surface_trajectory",
    CTE
    + """,
r AS (SELECT f.project, f.entry_idx, count(*) FILTER (severity = 'risk') AS risks FROM f JOIN e USING (entry_idx) WHERE nullif(severity, '') IS NOT NULL AND surface = 'cli' GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY entry_idx) AS pos, count(*) OVER (PARTITION BY project) AS n FROM r)
SELECT project, count(*) AS classified, floor(avg(risks) * 10 + 0.5) / 10 AS risks_all, floor(avg(risks) FILTER (pos > n - 5) * 10 + 0.5) / 10 AS risks_recent FROM p GROUP BY project
""",
)
def surface_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09: the surface is chosen before anything is counted, so positions are those within it."""
    e = entries(spark, sf_dir, "surface").filter(F.col("surface") == "cli").select(F.col("entry_idx").alias("e"))
    f = findings(spark, sf_dir, "severity").join(e, F.col("entry_idx") == F.col("e"), "left_semi")
    return L.trajectory(f).filter(F.col("classified") > 0).select("project", "classified", "risks_all", "risks_recent")


@R.query("grave_findings", CTE + "SELECT project, count(*) FILTER (severity IN ('risk', 'debt')) AS grave, count(*) AS active FROM a GROUP BY project")
def grave_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14: findings at or above a severity."""
    a = findings(spark, sf_dir, "severity", "status").filter(L.is_active(F.col("status")))
    return a.groupBy("project").agg(F.count_if(F.col("severity").isin("risk", "debt")).alias("grave"), F.count("*").alias("active"))


@R.query("first_by_id", CTE + "SELECT project, id, arg_min(finding_id, (entry_idx, f_idx)) AS finding_id FROM f WHERE nullif(id, '') IS NOT NULL GROUP BY project, id")
def first_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18: the first finding of every id, the answer to each point lookup at once."""
    f = findings(spark, sf_dir, "id").filter(L.given(F.col("id")).isNotNull())
    return f.groupBy("project", "id").agg(F.min_by("finding_id", F.struct("entry_idx", "f_idx")).alias("finding_id"))


@R.query(
    "new_since_last",
    CTE
    + """, z AS (SELECT project, max(entry_idx) AS last FROM e GROUP BY project)
SELECT z.project, count(finding_id) AS findings, count(finding_id) FILTER (severity = 'risk') AS risks FROM z LEFT JOIN a ON a.project = z.project AND a.entry_idx = z.last GROUP BY z.project
""",
)
def new_since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: active findings that came with the last entry of each project."""
    z = entries(spark, sf_dir).groupBy("project").agg(F.max("entry_idx").alias("last"))
    a = findings(spark, sf_dir, "severity", "status").filter(L.is_active(F.col("status"))).select(F.col("entry_idx").alias("e"), F.col("project").alias("p"), "severity", "finding_id")
    joined = z.join(a, (F.col("last") == F.col("e")) & (F.col("p") == F.col("project")), "left")
    return joined.groupBy("project").agg(F.count("finding_id").alias("findings"), F.count_if(F.col("severity") == "risk").alias("risks"))


@R.query(
    "recency_order",
    CTE + "SELECT entry_idx, row_number() OVER (PARTITION BY project ORDER BY try_cast(substr(completed_at, 1, 10) AS DATE) DESC NULLS LAST, entry_idx DESC) AS place FROM e",
)
def recency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06: newest first, dates that cannot be read last, equals by position."""
    day = F.expr("try_cast(substr(completed_at, 1, 10) AS date)")
    back = F.coalesce(-F.datediff(day, F.lit("1970-01-01").cast("date")), F.lit(10_000_000))
    e = entries(spark, sf_dir, "completed_at").select("project", "entry_idx", back.alias("back"), (-F.col("entry_idx")).alias("last"))
    return numbered(e, ["project"], ["back", "last"], F.floor(F.col("back") / 30), "place").select("entry_idx", "place")


@R.query(
    "newest_active",
    CTE
    + """, n AS (SELECT finding_id, project, coalesce(nullif(file, ''), '(no file)') AS file, row_number() OVER (PARTITION BY project ORDER BY entry_idx DESC, f_idx DESC, finding_id) AS p FROM a QUALIFY p <= 30)
SELECT project, file, count(*) AS findings FROM n GROUP BY ALL
""",
)
def newest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.7: the newest 30 active findings of each project are taken before they are grouped by file."""
    from pyspark.sql import Window

    a = findings(spark, sf_dir, "file", "status").filter(L.is_active(F.col("status")))
    top = a.withColumn("p", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("entry_idx"), F.desc("f_idx"), "finding_id"))).filter(F.col("p") <= 30)
    return top.groupBy("project", F.coalesce(L.given(F.col("file")), F.lit("(no file)")).alias("file")).agg(F.count("*").alias("findings"))
