"""Queries of statistics, windows, tempo, allocation and rule chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.functions.numeric import half_up
from tallyforge.operators import ledger as L
from tallyforge.operators import scan
from tallyforge.operators import stats as S
from tallyforge.operators.rows import latest, versions
from tallyforge.plans.views import CTE, entries, findings, modules
from tallyforge.registry import Registry, table

R = Registry()

_RUNS = """
WITH r AS (SELECT * FROM timings QUALIFY row_number() OVER (PARTITION BY timing_id ORDER BY loaded_at DESC NULLS LAST) = 1)
"""


def runs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf_dir, "timings").select("timing_id", "loaded_at", *columns), ["timing_id"], [F.desc_nulls_last("loaded_at")])


@R.query(
    "calibration_error",
    CTE
    + """, d AS (SELECT project, contract.satisfied::DOUBLE / contract.total AS c, CASE WHEN result = 'PASS' THEN 1.0::DOUBLE ELSE 0.0 END AS ok FROM e WHERE contract.total > 0),
b AS (SELECT *, CASE WHEN c BETWEEN 0.90 AND 1.00 THEN 0 WHEN c BETWEEN 0.70 AND 0.89 THEN 1 WHEN c BETWEEN 0.50 AND 0.69 THEN 2 WHEN c BETWEEN 0.00 AND 0.49 THEN 3 END AS b FROM d),
g AS (SELECT project, b, abs(avg(c) - avg(ok)) AS gap, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY ALL)
SELECT project, floor(avg(gap) * 1e6 + 0.5) / 1e6 AS ece, CAST(sum(n) AS BIGINT) AS rows FROM g GROUP BY project
""",
)
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir, "contract", "result").filter(F.col("contract.total") > 0)
    out = S.calibration_error(e, "project", F.col("contract.satisfied").cast("double") / F.col("contract.total"), F.col("result") == "PASS")
    return out.withColumn("ece", half_up(F.col("ece"), 6))


@R.query(
    "confidence_bands",
    CTE
    + """, d AS (SELECT contract.satisfied::DOUBLE / contract.total AS c, result FROM e WHERE contract.total > 0)
SELECT CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.7 THEN 'moderate' WHEN c >= 0.5 THEN 'low' WHEN c IS NOT NULL THEN 'uncertain' END AS band, count(*) AS entries, count(*) FILTER (result = 'PASS') AS passed FROM d GROUP BY 1
""",
)
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S12, FLT-07: half-open bands, unlike the buckets of the calibration error."""
    e = entries(spark, sf_dir, "contract", "result").filter(F.col("contract.total") > 0)
    return e.groupBy(X.confidence_band(F.col("contract.satisfied").cast("double") / F.col("contract.total")).alias("band")).agg(F.count("*").alias("entries"), F.count_if(F.col("result") == "PASS").alias("passed"))


_T = ", ".join(map(str, S.T95))


@R.query(
    "cell_statistics",
    _RUNS
    + f""", l AS (SELECT project, kind, unnest(['think', 'plan', 'build', 'verify']) AS metric, unnest([think, plan, build, verify]) AS v FROM r),
c AS (SELECT project, kind, metric, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM l WHERE v IS NOT NULL AND isfinite(v) AND kind IS NOT NULL GROUP BY ALL),
t AS (SELECT *, CASE WHEN n - 1 BETWEEN 1 AND 30 THEN [{_T}][n - 1]::DOUBLE WHEN n > 31 THEN 1.959964 END AS t FROM c)
SELECT project, kind, metric, n, floor(mean * 1e4 + 0.5) / 1e4 AS mean, floor(sqrt(var) * 1e4 + 0.5) / 1e4 AS sd, floor((mean - t * sqrt(var / n)) * 1e4 + 0.5) / 1e4 AS ci_low, floor((mean + t * sqrt(var / n)) * 1e4 + 0.5) / 1e4 AS ci_high FROM t
""",
)
def cell_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-35: wide rows unpivoted to (task, arm, metric, value), then one cell each, over all finite values."""
    r = runs(spark, sf_dir, "project", "kind", "think", "plan", "build", "verify").filter(F.col("kind").isNotNull())
    long = r.unpivot(["project", "kind"], ["think", "plan", "build", "verify"], "metric", "v")
    c = S.cells(long, ["project", "kind", "metric"], "v")
    return c.select("project", "kind", "metric", "n", *[half_up(F.col(x), 4).alias(x) for x in ("mean", "sd", "ci_low", "ci_high")])


@R.query(
    "activity_levels",
    """
WITH w AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT *, min(n) OVER (PARTITION BY user_id) AS lo, max(n) OVER (PARTITION BY user_id) AS hi FROM w)
SELECT user_id, week, n, CASE WHEN hi > lo THEN CAST(floor((n - lo)::DOUBLE / (hi - lo) * 7 + 0.5) AS BIGINT) ELSE 0 END AS level FROM m
""",
)
def activity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    return S.levels(w, ["user_id"], "n").withColumn("level", F.col("level").cast("bigint"))


@R.query(
    "value_until_purchase",
    """
WITH o AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done FROM events)
SELECT user_id, floor(sum(value) * 100 + 0.5) / 100 AS total, count(*) AS steps FROM o WHERE done = 0 GROUP BY user_id
""",
)
def value_until_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07, AGG-34: what a session spends before its first qualifying event."""
    out = S.running_until(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", F.col("event_type") == "purchase")
    return out.withColumn("total", F.floor(F.col("total") * 100 + 0.5) / 100)


@R.query(
    "stage_seconds",
    """
WITH g AS (SELECT user_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM (SELECT user_id, date_trunc('second', ts) AS ts, event_id FROM events))
SELECT user_id, CAST(sum(d) FILTER (d BETWEEN 0 AND 86400) AS BIGINT) AS seconds, count(*) FILTER (d > 86400) AS capped FROM g GROUP BY user_id
""",
)
def stage_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-42: gaps between steps, those above a day left out."""
    e = table(spark, sf_dir, "events").withColumn("at", F.date_trunc("second", "ts").cast("timestamp"))
    return S.stage_seconds(e, ["user_id"], "at", ["at", "event_id"])


@R.query(
    "tempo",
    """
WITH m AS (SELECT max(ts) AS now FROM events), x AS (SELECT e.*, least(floor(date_diff('second', ts, now) / 604800), 3) AS week FROM events e, m WHERE date_diff('second', ts, now) < 28 * 86400)
SELECT CAST(week AS BIGINT) AS week, count(*) AS events, count(DISTINCT user_id) AS contributors FROM x GROUP BY 1
""",
)
def tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30, ST-06: events and distinct contributors per week back from the last event, four weeks."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_timestamp("ts"))
    now = e.agg(F.max("s").alias("now"))  # one row
    age = F.col("now") - F.col("s")
    x = e.crossJoin(F.broadcast(now)).filter(age < 28 * 86_400)
    return x.groupBy(F.least(F.floor(age / 604_800), F.lit(3)).cast("bigint").alias("week")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("contributors"))


@R.query(
    "hot_files",
    CTE + "SELECT project, file, count(*) AS touches, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, file) AS rank FROM t GROUP BY project, file QUALIFY rank <= 10",
)
def hot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30: the ten files of each project that most entries touched."""
    n = modules(spark, sf_dir).groupBy("project", "file").agg(F.count("*").alias("touches"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("touches"), "file")).cast("bigint")).filter(F.col("rank") <= 10)


@R.query(
    "attestations",
    CTE
    + """, x AS (SELECT entry_idx, unnest(assertions) AS a, unnest(range(len(assertions))) AS i FROM e)
SELECT entry_idx, count(*) FILTER (a.status = 'SATISFIED') AS satisfied, count(*) FILTER (a.status = 'UNSATISFIED') AS violated, count(*) FILTER (a.status IS NULL OR a.status NOT IN ('SATISFIED', 'UNSATISFIED')) AS unverifiable,
  coalesce(string_agg(a.id, ',' ORDER BY i) FILTER (a.status = 'UNSATISFIED'), '') AS notable FROM x WHERE a IS NOT NULL GROUP BY entry_idx
""",
)
def attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-38, AGG-40: assertions by outcome, and the violated ones by name."""
    e = entries(spark, sf_dir, "assertions").withColumn("a", F.filter("assertions", lambda x: x.isNotNull())).filter(F.size("a") > 0)
    n = lambda c: F.size(F.filter("a", c)).cast("bigint")
    done = lambda x: F.coalesce(x.status.isin("SATISFIED", "UNSATISFIED"), F.lit(False))
    ids = F.filter(F.transform(F.filter("a", lambda x: x.status == "UNSATISFIED"), lambda x: x.id), lambda x: x.isNotNull())
    return e.select("entry_idx", n(lambda x: x.status == "SATISFIED").alias("satisfied"), n(lambda x: x.status == "UNSATISFIED").alias("violated"), n(lambda x: ~done(x)).alias("unverifiable"), F.array_join(ids, ",").alias("notable"))


@R.query(
    "stage_completeness",
    CTE
    + """, s AS (SELECT DISTINCT entry_idx, unnest(timing.segments).stage AS stage FROM e), k(stage) AS (VALUES ('think'), ('plan'), ('build'), ('verify')),
g AS (SELECT entry_idx, k.stage, EXISTS (SELECT 1 FROM s WHERE s.entry_idx = e.entry_idx AND s.stage = k.stage) AS there FROM e, k WHERE timing IS NOT NULL)
SELECT entry_idx, count(*) FILTER (there) AS present, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (NOT there), '') AS gaps FROM g GROUP BY entry_idx
""",
)
def stage_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-39: the stages expected of an entry against those it has."""
    e = entries(spark, sf_dir, "timing").filter(F.col("timing").isNotNull())
    have = F.coalesce(F.col("timing.segments.stage"), F.array().cast("array<string>"))
    want = F.array(*[F.lit(s) for s in ("build", "plan", "think", "verify")])
    return e.select("entry_idx", F.size(F.array_intersect(want, have)).cast("bigint").alias("present"), F.array_join(F.array_except(want, have), ",").alias("gaps"))


@R.query(
    "maturity",
    CTE
    + """, q AS (SELECT project, count(*) AS runs, max(try_cast(substr(completed_at, 1, 10) AS DATE)) AS last FROM e GROUP BY project)
SELECT project, runs, CASE WHEN runs >= 20 THEN 'established' WHEN runs >= 5 THEN 'growing' ELSE 'new' END AS maturity, date_diff('day', last, DATE '2025-12-01') AS idle_days,
  CASE WHEN last IS NULL THEN 'unknown' WHEN date_diff('day', last, DATE '2025-12-01') > 30 THEN 'stale' WHEN date_diff('day', last, DATE '2025-12-01') > 7 THEN 'ageing' ELSE 'fresh' END AS freshness FROM q
""",
)
def maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-50, AGG-53: thresholds on runs and on days since the last of them."""
    q = entries(spark, sf_dir, "completed_at").groupBy("project").agg(F.count("*").alias("runs"), F.max(F.expr("try_cast(substr(completed_at, 1, 10) AS date)")).alias("last"))
    idle = F.datediff(F.lit("2025-12-01").cast("date"), "last").cast("bigint")
    return q.select("project", "runs", F.when(F.col("runs") >= 20, "established").when(F.col("runs") >= 5, "growing").otherwise("new").alias("maturity"), idle.alias("idle_days"), F.when(idle.isNull(), "unknown").when(idle > 30, "stale").when(idle > 7, "ageing").otherwise("fresh").alias("freshness"))


@R.query(
    "item_stage",
    CTE
    + """, d AS (SELECT project, slug, lower(replace(replace(source, ' ', '_'), '-', '_')) AS s FROM documents WHERE slug IS NOT NULL AND source IS NOT NULL),
i AS (SELECT project, slug, bool_or(s = 'scope') AS scope, bool_or(s = 'plan') AS plan, bool_or(s = 'build_report') AS build, bool_or(s = 'verify_report') AS verify FROM d GROUP BY ALL)
SELECT project, slug, CASE WHEN verify THEN 'verified' WHEN build THEN 'built' WHEN plan THEN 'planned' WHEN scope THEN 'scoped' ELSE 'noted' END AS stage FROM i
""",
)
def item_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-57, WIN-10, WIN-11, SRC-33: the documents of a work item pivoted by kind, and the furthest stage they show."""
    s = F.lower(F.replace(F.replace("source", F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")))
    d = table(spark, sf_dir, "documents").filter(F.col("slug").isNotNull() & F.col("source").isNotNull()).select("project", "slug", s.alias("s"))
    has = {k: F.bool_or(F.col("s") == k) for k in ("verify_report", "build_report", "plan", "scope")}
    i = d.groupBy("project", "slug").agg(*[c.alias(k) for k, c in has.items()])
    return i.select("project", "slug", F.when(F.col("verify_report"), "verified").when(F.col("build_report"), "built").when(F.col("plan"), "planned").when(F.col("scope"), "scoped").otherwise("noted").alias("stage"))


@R.query(
    "sample_allocation",
    CTE
    + """, g AS (SELECT project, regexp_extract(file, '^([^/]*)', 1) AS grp, count(DISTINCT file) AS n FROM t GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY project) AS whole, row_number() OVER (PARTITION BY project ORDER BY n DESC, grp) AS k FROM g),
h AS (SELECT *, CASE WHEN whole <= 50 THEN n ELSE greatest(floor(50 * n / whole), 1) END AS share FROM s)
SELECT project, grp, n, CAST(least(n, share + CASE WHEN k = 1 THEN greatest(least(50, whole) - sum(share) OVER (PARTITION BY project), 0) ELSE 0 END) AS BIGINT) AS places FROM h
""",
)
def sample_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12: places of a file sample shared among the roots of each project."""
    g = modules(spark, sf_dir).select("project", "file").distinct().groupBy("project", F.regexp_extract("file", "^([^/]*)", 1).alias("grp")).agg(F.count("*").alias("n"))
    return S.allocate(g, 50, ["project"]).withColumn("places", F.col("places").cast("bigint"))


@R.query(
    "stratified_files",
    CTE
    + """, g AS (SELECT DISTINCT project, file, regexp_extract(file, '^([^/]*)', 1) AS grp, CASE WHEN len(string_split(file, '/')) <= 2 THEN 0 WHEN len(string_split(file, '/')) <= 5 THEN 1 ELSE 2 END AS depth FROM t)
SELECT project, grp, CAST(depth AS INTEGER) AS depth, file FROM g QUALIFY row_number() OVER (PARTITION BY project, grp, depth ORDER BY file) <= 3
""",
)
def stratified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12, WIN-05: a deterministic sample, some files of every root and depth."""
    n = F.size(F.split("file", "/"))
    g = modules(spark, sf_dir).select("project", "file").distinct().select("project", F.regexp_extract("file", "^([^/]*)", 1).alias("grp"), F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2).alias("depth"), "file")
    return g.withColumn("rn", F.row_number().over(Window.partitionBy("project", "grp", "depth").orderBy("file"))).filter(F.col("rn") <= 3).drop("rn")


_ASIDE = "[" + ", ".join(f"'{x}'" for x in scan.ASIDE) + "]"


@R.query(
    "product_paths",
    CTE
    + f""", q AS (SELECT DISTINCT project, file, string_split(lower(file), '/') AS s FROM t)
SELECT project, file, len(list_intersect(s, {_ASIDE})) = 0 AND NOT ends_with(s[-1], '-e2e') AS product, len(list_intersect(s[1:3], {_ASIDE})) = 0 AS product_near_top FROM q
""",
)
def product_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02, FLT-03: paths without a segment that names something other than product code, anywhere or among the first three."""
    f = modules(spark, sf_dir).select("project", "file").distinct()
    return f.select("project", "file", (~scan.is_aside(F.col("file"))).alias("product"), (~scan.is_aside(F.col("file"), 3)).alias("product_near_top"))


@R.query(
    "file_kinds",
    CTE
    + r""", q AS (SELECT DISTINCT file FROM t)
SELECT CASE WHEN regexp_matches(file, '\.tsx$') THEN 'component' WHEN regexp_matches(file, '(^|/)(route|handler|index)[^/]*\.(ts|mjs)$') THEN 'route' WHEN regexp_matches(file, '\.test\.') THEN 'test' WHEN regexp_matches(file, '(^|/)scripts/') THEN 'script' WHEN regexp_matches(file, '\.(json|yaml)$') THEN 'config' ELSE 'other' END AS kind, count(*) AS files FROM q GROUP BY 1
""",
)
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, FLT-06, CLS-06: the first rule that fits a path."""
    f = F.col("file")
    kind = F.when(f.rlike(r"\.tsx$"), "component").when(f.rlike(r"(^|/)(route|handler|index)[^/]*\.(ts|mjs)$"), "route").when(f.rlike(r"\.test\."), "test").when(f.rlike("(^|/)scripts/"), "script").when(f.rlike(r"\.(json|yaml)$"), "config").otherwise("other")
    return modules(spark, sf_dir).select("file").distinct().groupBy(kind.alias("kind")).agg(F.count("*").alias("files"))


@R.query(
    "ledger_states",
    CTE
    + """, z AS (SELECT project, max(entry_idx) AS last FROM e GROUP BY project), lt AS (SELECT project, file, max(entry_idx) AS last_touch FROM t GROUP BY ALL)
SELECT a.finding_id, CASE WHEN a.category = 'upstream' THEN 'upstream' WHEN lt.file IS NULL THEN 'file never touched' WHEN lt.last_touch > a.entry_idx AND a.anchor IS NULL THEN 'no anchor' END AS reason
FROM a LEFT JOIN lt ON lt.project = a.project AND lt.file = a.file WHERE nullif(a.file, '') IS NOT NULL AND (a.category = 'upstream' OR lt.file IS NULL OR (lt.last_touch > a.entry_idx AND a.anchor IS NULL))
""",
)
def ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-01: active findings that close by themselves, with the first reason that fits."""
    lt = modules(spark, sf_dir).groupBy(F.col("project").alias("l_p"), F.col("file").alias("l_f")).agg(F.max("entry_idx").alias("last_touch"))
    a = findings(spark, sf_dir, "status", "category", "file", "anchor").filter(L.is_active(F.col("status")) & L.given(F.col("file")).isNotNull())
    joined = a.join(lt, (F.col("project") == F.col("l_p")) & (F.col("file") == F.col("l_f")), "left")
    reason = F.when(F.col("category") == "upstream", "upstream").when(F.col("l_f").isNull(), "file never touched").when((F.col("last_touch") > F.col("entry_idx")) & F.col("anchor").isNull(), "no anchor")
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("finding_id", "reason")


@R.query(
    "last_transitions",
    CTE + "SELECT project, id, arg_max(coalesce(nullif(status, ''), 'active'), (entry_idx, f_idx)) AS state, count(*) AS steps, count(*) > 1 AND arg_max(coalesce(nullif(status, ''), 'active'), (entry_idx, f_idx)) <> arg_min(coalesce(nullif(status, ''), 'active'), (entry_idx, f_idx)) AS moved FROM f WHERE nullif(id, '') IS NOT NULL GROUP BY project, id",
)
def last_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-07: the state of an id is that of its last transition."""
    s, at = F.coalesce(L.given(F.col("status")), F.lit("active")), F.struct("entry_idx", "f_idx")
    f = findings(spark, sf_dir, "id", "status").filter(L.given(F.col("id")).isNotNull())
    return f.groupBy("project", "id").agg(F.max_by(s, at).alias("state"), F.count("*").alias("steps"), ((F.count("*") > 1) & (F.max_by(s, at) != F.min_by(s, at))).alias("moved"))


@R.query(
    "idempotent_saves",
    "SELECT DISTINCT ON (project, doc_type, sha256(body)) raw_id, project, doc_type FROM raw_records WHERE body IS NOT NULL ORDER BY project, doc_type, sha256(body), raw_id",
)
def idempotent_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-02, SNK-06: a save whose content is there already is skipped: the first of each hash stays."""
    raw = table(spark, sf_dir, "raw_records").filter(F.col("body").isNotNull())
    return raw.groupBy("project", "doc_type", F.sha2("body", 256).alias("h")).agg(F.min("raw_id").alias("raw_id")).select("raw_id", "project", "doc_type")


@R.query(
    "saved_versions",
    """
WITH c AS (SELECT DISTINCT project, slug, sealed_at, contract_id, sha256(body) AS hash FROM contracts WHERE project IS NOT NULL AND slug IS NOT NULL),
m AS (SELECT *, lag(hash) OVER w AS before_, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY project, slug ORDER BY sealed_at NULLS FIRST, contract_id, hash NULLS FIRST)),
k AS (SELECT *, row_number() OVER (PARTITION BY project, slug ORDER BY n) AS version FROM m WHERE n = 1 OR hash IS DISTINCT FROM before_)
SELECT project, slug, CAST(max(version) AS INTEGER) AS versions, CAST(count(*) - 1 AS BIGINT) AS in_history, arg_max(contract_id, version) AS current FROM k GROUP BY project, slug
""",
)
def saved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: the contract of each work item that counts, and how many different ones came before it."""
    c = table(spark, sf_dir, "contracts").filter(F.col("project").isNotNull() & F.col("slug").isNotNull()).select("project", "slug", "sealed_at", "contract_id", "body").distinct()
    c = c.withColumn("h", F.sha2("body", 256))
    v = versions(c, ["project", "slug"], ["sealed_at", "contract_id", "h"], F.col("body"))
    return v.groupBy("project", "slug").agg(F.max("version").alias("versions"), (F.count("*") - 1).alias("in_history"), F.max_by("contract_id", "version").alias("current"))


@R.query(
    "envelopes",
    CTE + """SELECT project, '{"command":"health","results":{"runs":' || count(*) || ',"rejected":' || count(*) FILTER (rejection_cycles > 0) || '}}' AS envelope FROM e GROUP BY project""",
)
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: answers wrapped as JSON."""
    q = entries(spark, sf_dir, "rejection_cycles").groupBy("project").agg(F.count("*").alias("runs"), F.count_if(F.col("rejection_cycles") > 0).alias("rejected"))
    return q.select("project", F.to_json(F.struct(F.lit("health").alias("command"), F.struct("runs", "rejected").alias("results"))).alias("envelope"))


@R.query(
    "markdown_cards",
    CTE + """SELECT project, '# ' || project || chr(10) || string_agg('- ' || slug || ': ' || result, chr(10) ORDER BY entry_idx DESC) AS card FROM (SELECT * FROM e WHERE slug IS NOT NULL AND result IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY entry_idx DESC) <= 3) GROUP BY project""",
)
def markdown_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, SNK-09: the last three entries of each project as text, newest first."""
    e = entries(spark, sf_dir, "slug", "result").filter(F.col("slug").isNotNull() & F.col("result").isNotNull())
    top = e.withColumn("rn", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("entry_idx")))).filter(F.col("rn") <= 3)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", "slug", "result"))), lambda x: F.concat(F.lit("- "), x.slug, F.lit(": "), x.result))
    return top.groupBy("project").agg(lines.alias("l")).select("project", F.concat(F.lit("# "), "project", F.lit("\n"), F.array_join("l", "\n")).alias("card"))


@R.query(
    "feed",
    CTE + "SELECT entry_idx, slug, coalesce(nullif(kind, ''), 'work') AS kind, substr(coalesce(hashes['contract.yaml'], ''), 1, 7) AS short_hash FROM e",
)
def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, FLT-17: a projection with fallbacks and a map lookup."""
    return entries(spark, sf_dir, "slug", "kind", "hashes").select("entry_idx", "slug", F.coalesce(L.given(F.col("kind")), F.lit("work")).alias("kind"), F.substring(F.coalesce(F.try_element_at("hashes", F.lit("contract.yaml")), F.lit("")), 1, 7).alias("short_hash"))


@R.query(
    "human_counts",
    "SELECT source, count(*) AS docs, CASE WHEN sum(n_chars) >= 1000000 THEN printf('%.1fM', floor(sum(n_chars) / 1e5 + 0.5) / 10) WHEN sum(n_chars) >= 1000 THEN printf('%.1fk', floor(sum(n_chars) / 1e2 + 0.5) / 10) ELSE CAST(sum(n_chars) AS VARCHAR) END AS chars FROM documents WHERE n_chars IS NOT NULL GROUP BY source",
)
def human_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-F01."""
    from tallyforge.functions.numeric import fmt_count

    return table(spark, sf_dir, "documents").filter(F.col("n_chars").isNotNull()).groupBy("source").agg(F.count("*").alias("docs"), fmt_count(F.sum("n_chars")).alias("chars"))


@R.query(
    "late_loads",
    _RUNS + ", d AS (SELECT *, date_diff('second', recorded_at, loaded_at) AS s FROM r) SELECT project, count(*) AS runs, count(*) FILTER (s > 259200) AS expired, CAST(max(s) AS BIGINT) AS slowest FROM d GROUP BY project",
)
def late_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-03, FN-D02: rows that came more than 72 hours after the event."""
    s = F.unix_timestamp("loaded_at") - F.unix_timestamp("recorded_at")
    return runs(spark, sf_dir, "project", "recorded_at").withColumn("s", s).groupBy("project").agg(F.count("*").alias("runs"), F.count_if(F.col("s") > 259_200).alias("expired"), F.max("s").alias("slowest"))
