"""Queries of rule chains and inventories: surfaces, stacks, evidence, citations, work items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import ledger as L
from tallyforge.plans.views import CTE, entries, findings, modules
from tallyforge.registry import Registry, table

R = Registry()

#: Files of an entry that are paired with each other in one row.
BLOCK = 64

_KIND = "lower(replace(replace(trim(source), ' ', '_'), '-', '_'))"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with one spelling per kind."""
    kind = F.lower(F.replace(F.replace(F.trim("source"), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")))
    return table(spark, sf_dir, "documents").select("doc_id", "project", "slug", kind.alias("kind"), *columns)


@R.query(
    "documentation_ages",
    f"SELECT project, count(*) AS pages, CAST(min(date_diff('day', created_at::DATE, DATE '2025-12-01')) AS BIGINT) AS newest_days, CAST(max(date_diff('day', created_at::DATE, DATE '2025-12-01')) AS BIGINT) AS oldest_days FROM documents WHERE {_KIND} = 'docs_page' AND created_at IS NOT NULL GROUP BY project",
)
def documentation_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-31: documentation of each project with its age in days at a fixed date."""
    d = documents(spark, sf_dir, "created_at").filter((F.col("kind") == "docs_page") & F.col("created_at").isNotNull())
    age = F.datediff(F.lit("2025-12-01").cast("date"), F.to_date("created_at")).cast("bigint")
    return d.groupBy("project").agg(F.count("*").alias("pages"), F.min(age).alias("newest_days"), F.max(age).alias("oldest_days"))


@R.query(
    "work_items",
    CTE
    + f""", i AS (SELECT project, slug, count(*) AS runs, max(entry_idx) AS last, arg_max(result, entry_idx) AS result FROM e WHERE slug IS NOT NULL GROUP BY ALL),
d AS (SELECT project, slug, count(*) AS docs, string_agg(DISTINCT {_KIND}, ',' ORDER BY {_KIND}) AS kinds FROM documents WHERE slug IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
c AS (SELECT project, slug, count(DISTINCT contract_id) AS contracts FROM contracts WHERE slug IS NOT NULL GROUP BY ALL)
SELECT project, slug, runs, last, result, coalesce(docs, 0) AS docs, coalesce(kinds, '') AS kinds, coalesce(contracts, 0) AS contracts FROM i LEFT JOIN d USING (project, slug) LEFT JOIN c USING (project, slug)
""",
)
def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-25, SRC-26: a work item put together from its entries, documents and contracts."""
    i = entries(spark, sf_dir, "slug", "result").filter(F.col("slug").isNotNull()).groupBy("project", "slug").agg(F.count("*").alias("runs"), F.max("entry_idx").alias("last"), F.max_by("result", "entry_idx").alias("result"))
    d = documents(spark, sf_dir).filter(F.col("slug").isNotNull() & F.col("kind").isNotNull()).groupBy("project", "slug").agg(F.count("*").alias("docs"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    c = table(spark, sf_dir, "contracts").filter(F.col("slug").isNotNull()).groupBy("project", "slug").agg(F.count_distinct("contract_id").alias("contracts"))
    joined = i.join(d, ["project", "slug"], "left").join(c, ["project", "slug"], "left")
    return joined.select("project", "slug", "runs", "last", "result", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("kinds", F.lit("")).alias("kinds"), F.coalesce("contracts", F.lit(0)).alias("contracts"))


_BOTS = ("scan-", "sync-", "prune-")


@R.query(
    "without_automation",
    CTE + "SELECT project, count(*) AS items, arg_max(prefix, (n, prefix)) AS commonest FROM (SELECT project, regexp_extract(slug, '^([a-z]+)-', 1) AS prefix, count(*) AS n FROM e WHERE slug IS NOT NULL AND NOT (" + " OR ".join(f"starts_with(slug, '{b}')" for b in _BOTS) + ") GROUP BY ALL) GROUP BY project",
)
def without_automation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, AGG-32: names with certain prefixes left out, and the commonest prefix of the rest."""
    keep = F.lit(True)
    for b in _BOTS:
        keep = keep & ~F.col("slug").startswith(b)
    e = entries(spark, sf_dir, "slug").filter(F.col("slug").isNotNull() & keep)
    n = e.groupBy("project", F.regexp_extract("slug", "^([a-z]+)-", 1).alias("prefix")).agg(F.count("*").alias("n"))
    return n.groupBy("project").agg(F.count("*").alias("items"), F.max_by("prefix", F.struct("n", "prefix")).alias("commonest"))


@R.query(
    "report_items",
    rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE {_KIND} = 'verify_report' AND text IS NOT NULL),
a AS (SELECT doc_id, list_filter(regexp_extract_all(l, '`([^`]+)`', 1), lambda b: length(b) > 5 AND regexp_matches(b, '[A-Za-z]') AND NOT regexp_matches(b, '^\S+\.\w+:\d+'))[1] AS anchor FROM l WHERE regexp_matches(l, '^\s*[-*] '))
SELECT doc_id, count(*) AS items, count(anchor) AS anchored, min(anchor) AS first_anchor FROM a GROUP BY doc_id
""",
)
def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S06: the items of verification reports and the names they point at."""
    lines = documents(spark, sf_dir, "text").filter((F.col("kind") == "verify_report") & F.col("text").isNotNull()).select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    a = lines.filter(F.col("l").rlike(r"^\s*[-*] ")).select("doc_id", X.finding_anchor(F.col("l")).alias("anchor"))
    return a.groupBy("doc_id").agg(F.count("*").alias("items"), F.count("anchor").alias("anchored"), F.min("anchor").alias("first_anchor"))


@R.query(
    "surfaces",
    CTE
    + r""", g AS (SELECT project, regexp_extract(file, '^(packages/[^/]+|[^/]+)/', 1) AS path, count(DISTINCT file) AS files, bool_or(regexp_matches(file, '\.tsx$')) AS ui, bool_or(contains(file, '/commands/')) AS cli, bool_or(regexp_matches(file, '\.test\.')) AS tested FROM t WHERE contains(file, '/') GROUP BY ALL)
SELECT project, path, files, CASE WHEN path = 'website' THEN 'site' WHEN ui AND cli THEN 'application' WHEN cli THEN 'command line' WHEN ui THEN 'components' ELSE 'library' END AS kind FROM g WHERE path <> 'scripts' AND (starts_with(path, 'packages/') OR path = 'website' OR tested OR files >= 10)
""",
)
def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-07, SRC-05: roots that count as surfaces by ordered rules, without the excluded ones, and what each is."""
    f = F.col("file")
    t = modules(spark, sf_dir).select("project", "file").distinct().filter(f.contains("/"))
    g = t.groupBy("project", F.regexp_extract(f, "^(packages/[^/]+|[^/]+)/", 1).alias("path")).agg(F.count("*").alias("files"), F.bool_or(f.endswith(".tsx")).alias("ui"), F.bool_or(f.contains("/commands/")).alias("cli"), F.bool_or(f.rlike(r"\.test\.")).alias("tested"))
    p = F.col("path")
    kept = g.filter((p != "scripts") & (p.startswith("packages/") | (p == "website") | F.col("tested") | (F.col("files") >= 10)))
    kind = F.when(p == "website", "site").when(F.col("ui") & F.col("cli"), "application").when(F.col("cli"), "command line").when(F.col("ui"), "components").otherwise("library")
    return kept.select("project", "path", "files", kind.alias("kind"))


@R.query(
    "citation_checks",
    CTE
    + r""", r0 AS (SELECT DISTINCT doc_id, project, unnest(regexp_extract_all(text, '((?:[\w./-]+/)?[\w.-]+\.(?:tsx|ts|jsx|json|js|yaml|yml|md))', 1)) AS file FROM documents WHERE text IS NOT NULL),
r AS (SELECT * FROM r0 WHERE NOT starts_with(file, '//')), k AS (SELECT DISTINCT project, file FROM t)
SELECT r.project, count(*) AS citations, count(k.file) AS found, count(DISTINCT CASE WHEN k.file IS NULL THEN r.file END) AS unknown_files FROM r LEFT JOIN k ON k.project = r.project AND k.file = r.file GROUP BY r.project
""",
)
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-49: files that texts cite against those the project has touched."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    r = d.select("project", F.explode(X.file_references(F.col("text"))).alias("file"))
    k = modules(spark, sf_dir).select(F.col("project").alias("k_p"), F.col("file").alias("k_f")).distinct()
    joined = r.join(k, (F.col("project") == F.col("k_p")) & (F.col("file") == F.col("k_f")), "left")
    return joined.groupBy("project").agg(F.count("*").alias("citations"), F.count("k_f").alias("found"), F.count_distinct(F.when(F.col("k_f").isNull(), F.col("file"))).alias("unknown_files"))


@R.query(
    "open_by_entry",
    CTE + "SELECT e.entry_idx, coalesce(n, 0) AS open, coalesce(sum(n) OVER (PARTITION BY e.project ORDER BY e.entry_idx ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS open_so_far FROM e LEFT JOIN (SELECT entry_idx, count(*) AS n FROM a GROUP BY ALL) x ON x.entry_idx = e.entry_idx",
)
def open_by_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, WIN-07: active findings of each entry and of the chain up to it, summed in two levels."""
    from tallyforge.operators.rows import running_total

    n = findings(spark, sf_dir, "status").filter(L.is_active(F.col("status"))).groupBy(F.col("entry_idx").alias("x_e")).agg(F.count("*").alias("n"))
    e = entries(spark, sf_dir).join(n, F.col("entry_idx") == F.col("x_e"), "left").select("project", "entry_idx", F.coalesce("n", F.lit(0)).alias("open"))
    return running_total(e, ["project"], ["entry_idx"], F.floor(F.col("entry_idx") / L.CHAIN_BUCKET), "open", "open_so_far").select("entry_idx", "open", "open_so_far")


@R.query(
    "most_connected",
    CTE
    + """, p AS (SELECT x.project, x.file AS a, y.file AS b FROM t x JOIN t y ON x.entry_idx = y.entry_idx AND x.file < y.file GROUP BY ALL),
d AS (SELECT project, unnest([a, b]) AS file FROM p)
SELECT project, file, count(*) AS partners, dense_rank() OVER (PARTITION BY project ORDER BY count(*) DESC) AS rank FROM d GROUP BY project, file QUALIFY rank <= 3
""",
)
def most_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05, AGG-33: files with most different partners in any entry, dense ranks.

    Equal entries are collapsed; each is cut into blocks of files, and the pairs
    of blocks are dealt over the tasks, so a large entry is no single task's work.
    """
    from tallyforge.plans.joins import stored_modules

    t = stored_modules(spark, sf_dir).select("project", "entry_idx", "file")
    lists = t.groupBy("project", "entry_idx").agg(F.array_sort(F.collect_set("file")).alias("files")).filter(F.size("files") > 1).select("project", "files").distinct()
    blocks = lists.select("project", F.transform(F.sequence(F.lit(1), F.size("files"), F.lit(BLOCK)), lambda i: F.slice("files", i, BLOCK)).alias("blocks"))
    left = blocks.select("project", "blocks", F.posexplode("blocks").alias("at", "xs"))
    dealt = left.select("project", "xs", F.explode(F.slice("blocks", F.col("at") + 1, F.size("blocks"))).alias("ys"))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = dealt.select("project", "ys", F.explode("xs").alias("a")).select("project", "a", F.explode(F.filter("ys", lambda y: y > F.col("a"))).alias("b")).distinct()
    d = pairs.select("project", F.explode(F.array("a", "b")).alias("file"))
    n = d.groupBy("project", "file").agg(F.count("*").alias("partners"))
    return n.withColumn("rank", F.dense_rank().over(Window.partitionBy("project").orderBy(F.desc("partners"))).cast("bigint")).filter(F.col("rank") <= 3)
