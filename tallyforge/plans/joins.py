"""Queries that join the ledger's tables with themselves, each other and small dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.paths import base_name, canonical_path
from tallyforge.operators import joins as J
from tallyforge.operators import ledger as L
from tallyforge.operators import nested
from tallyforge.operators.rows import latest
from tallyforge.plans.views import CANON, CTE, entries, findings, modules
from tallyforge.registry import Registry, table
from tallyforge.session import materialise

R = Registry()

#: A stand-in for the import graph, which the tables do not hold: files that an
#: entry lists next to each other are linked, and files of ``packages`` are its nodes.
_EDGES = rf"""
, l AS (SELECT project, entry_idx, {CANON} AS file, i FROM (SELECT project, entry_idx, unnest(modules_touched) AS m, unnest(range(len(modules_touched))) AS i FROM e)),
edges AS (SELECT DISTINCT a.project, a.file AS src, b.file AS dst FROM l a JOIN l b ON a.entry_idx = b.entry_idx AND b.i = a.i + 1 WHERE a.file <> b.file),
nodes AS (SELECT DISTINCT project, file FROM t WHERE starts_with(file, 'packages/') OR starts_with(file, 'src/'))
"""


def stored_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each entry, written once for queries that read them several times."""
    return materialise(modules(spark, sf_dir), "modules")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = entries(spark, sf_dir, "modules_touched").select("project", "entry_idx", F.posexplode("modules_touched").alias("i", "m")).select("project", "entry_idx", "i", canonical_path(F.col("m")).alias("src"))
    nxt = at.select(F.col("entry_idx").alias("n_e"), (F.col("i") - 1).alias("n_i"), F.col("src").alias("dst"))
    return at.join(nxt, (F.col("entry_idx") == F.col("n_e")) & (F.col("i") == F.col("n_i")) & (F.col("src") != F.col("dst"))).select("project", "src", "dst").distinct()


def nodes(touched: DataFrame) -> DataFrame:
    return touched.filter(F.col("file").startswith("packages/") | F.col("file").startswith("src/")).select("project", "file").distinct()


@R.query(
    "cochange_partners",
    CTE
    + _EDGES
    + r""",
tc AS (SELECT project, file, count(*) AS touches FROM t GROUP BY ALL),
small AS (SELECT entry_idx FROM t GROUP BY entry_idx HAVING count(*) <= 40),
k0 AS (SELECT t.*, string_split(t.file, '/') AS d, string_split(regexp_extract(t.file, '([^/]*)$', 1), '.') AS n FROM t JOIN small USING (entry_idx) JOIN tc ON tc.project = t.project AND tc.file = t.file WHERE touches >= 3),
k AS (SELECT project, entry_idx, file, len(n) > 2 AND lower(n[-2]) IN ('test', 'spec') AS is_test, array_to_string(list_filter(d[:-2], lambda x: lower(x) NOT IN ('src', 'test', 'tests', '__tests__')) || [array_to_string(CASE WHEN len(n) > 2 AND lower(n[-2]) IN ('test', 'spec') THEN n[:-3] || n[-1:] ELSE n END, '.')], '/') AS mir,
  contains(file, '/') AS deep, regexp_replace(regexp_replace(array_to_string(n, '.'), '\.[A-Za-z0-9]+$', ''), '(?i)([._-](test|spec))$|^test_', '') AS stem FROM k0),
p AS (SELECT a.project, a.file AS file, b.file AS partner, count(*) AS together FROM k a JOIN k b ON a.entry_idx = b.entry_idx AND a.file <> b.file
  WHERE NOT (a.is_test <> b.is_test AND CASE WHEN a.deep AND b.deep THEN a.mir = b.mir OR ends_with(a.mir, '/' || b.mir) OR ends_with(b.mir, '/' || a.mir) ELSE a.stem = b.stem END) GROUP BY ALL HAVING count(*) >= 2)
SELECT p.*, CASE WHEN NOT EXISTS (SELECT 1 FROM nodes n WHERE n.project = p.project AND n.file = p.file) OR NOT EXISTS (SELECT 1 FROM nodes n WHERE n.project = p.project AND n.file = p.partner) THEN 'unknown'
  WHEN EXISTS (SELECT 1 FROM edges g WHERE g.project = p.project AND ((g.src = p.file AND g.dst = p.partner) OR (g.dst = p.file AND g.src = p.partner))) THEN 'imports' ELSE 'hidden' END AS relation
FROM p
""",
)
def cochange_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = stored_modules(spark, sf_dir)
    return J.cochange(touched.select("project", "entry_idx", "file"), edges(spark, sf_dir), nodes(touched))


@R.query(
    "import_neighbours",
    CTE
    + _EDGES
    + """
SELECT project, file, count(DISTINCT other) FILTER (way = 'out') AS imports, count(DISTINCT other) FILTER (way = 'in') AS imported_by, min(other) AS first_neighbour
FROM (SELECT project, src AS file, dst AS other, 'out' AS way FROM edges UNION ALL SELECT project, dst, src, 'in' FROM edges) GROUP BY project, file
""",
)
def import_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06, AGG-33: one hop in and out of every node; in-degree counts distinct importers."""
    g = edges(spark, sf_dir)
    both = g.select("project", F.col("src").alias("file"), F.col("dst").alias("other"), F.lit("out").alias("way")).unionByName(g.select("project", F.col("dst").alias("file"), F.col("src").alias("other"), F.lit("in").alias("way")))
    return both.groupBy("project", "file").agg(F.count_if(F.col("way") == "out").alias("imports"), F.count_if(F.col("way") == "in").alias("imported_by"), F.min("other").alias("first_neighbour"))


@R.query(
    "neighbours_not_partners",
    CTE
    + _EDGES
    + """,
n AS (SELECT project, src AS a, dst AS b FROM edges UNION SELECT project, dst, src FROM edges),
p AS (SELECT x.project, x.file AS a, y.file AS b FROM t x JOIN t y ON x.entry_idx = y.entry_idx AND x.file <> y.file GROUP BY ALL HAVING count(*) >= 2)
SELECT n.* FROM n ANTI JOIN p ON n.project = p.project AND n.a = p.a AND n.b = p.b
""",
)
def neighbours_not_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05: neighbours in the graph that are not also listed as changing together."""
    g = edges(spark, sf_dir)
    n = g.select("project", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(g.select("project", F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    t = stored_modules(spark, sf_dir).select("project", "entry_idx", "file")
    # only pairs that are neighbours matter: join the edges with the touches of both ends, not all pairs of an entry
    ta = t.select(F.col("project").alias("a_p"), F.col("entry_idx").alias("a_e"), F.col("file").alias("a_f"))
    tb = t.select(F.col("entry_idx").alias("b_e"), F.col("file").alias("b_f"))
    together = n.join(ta, (F.col("project") == F.col("a_p")) & (F.col("a") == F.col("a_f"))).join(tb, (F.col("a_e") == F.col("b_e")) & (F.col("b") == F.col("b_f")))
    p = together.groupBy("project", "a", "b").count().filter(F.col("count") >= 2)
    return n.join(p, ["project", "a", "b"], "left_anti")


_FILES = """, q AS (SELECT DISTINCT project, regexp_replace(file, '[\\\\/]+', '/', 'g') AS path FROM f WHERE nullif(file, '') IS NOT NULL),
r AS (SELECT DISTINCT project, file AS path FROM t),
m AS (SELECT q.project, q.path, r.path AS match, q.path = r.path AS exact FROM q JOIN r ON q.project = r.project
  WHERE q.path = r.path OR ends_with(q.path, '/' || r.path) OR ends_with(r.path, '/' || q.path))
"""


def _finding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir, "file").filter(L.given(F.col("file")).isNotNull())
    return f.select("project", F.regexp_replace("file", r"[\\/]+", "/").alias("path")).distinct()


def _module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(spark, sf_dir).select("project", F.col("file").alias("path")).distinct()


@R.query("path_matches", CTE + _FILES + "SELECT * FROM m")
def path_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03: files named by findings against files touched, by suffix at a ``/``."""
    return J.path_matches(_finding_files(spark, sf_dir), _module_files(spark, sf_dir))


@R.query("resolved_paths", CTE + _FILES + "SELECT project, path, arg_min(match, (NOT exact, match)) AS match, bool_or(exact) AS exact FROM m GROUP BY project, path")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.resolved(_finding_files(spark, sf_dir), _module_files(spark, sf_dir))


@R.query(
    "unique_basenames",
    CTE
    + _FILES
    + """,
i AS (SELECT project, regexp_extract(path, '([^/]*)$', 1) AS b, count(*) AS n, min(path) AS one FROM r GROUP BY ALL)
SELECT q.project, q.path, CASE WHEN NOT contains(q.path, '/') AND n = 1 THEN one ELSE q.path END AS resolved FROM q LEFT JOIN i ON i.project = q.project AND i.b = q.path
""",
)
def unique_basenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unique_basenames(_finding_files(spark, sf_dir), _module_files(spark, sf_dir))


@R.query(
    "file_context",
    CTE
    + _FILES
    + """,
w AS (SELECT project, path, arg_min(match, (NOT exact, match)) AS match FROM m GROUP BY ALL),
x AS (SELECT f.project, coalesce(w.match, regexp_replace(f.file, '[\\\\/]+', '/', 'g')) AS file, f.entry_idx, f.severity, 0 AS concern FROM f LEFT JOIN w ON w.project = f.project AND w.path = regexp_replace(f.file, '[\\\\/]+', '/', 'g')
  WHERE nullif(f.file, '') IS NOT NULL
  UNION ALL SELECT project, c.file, entry_idx, c.severity, 1 FROM (SELECT project, entry_idx, unnest(build_concerns) AS c FROM e) WHERE nullif(c.file, '') IS NOT NULL)
SELECT project, file, count(*) FILTER (concern = 0) AS findings, count(*) FILTER (concern = 1) AS concerns, count(DISTINCT entry_idx) AS touch_count, max(entry_idx) AS last_touched FROM x GROUP BY project, file
""",
)
def file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-07: what the ledger knows of every file: findings, concerns, entries with either, the last of them."""
    to = J.resolved(_finding_files(spark, sf_dir), _module_files(spark, sf_dir)).select(F.col("project").alias("w_p"), F.col("path").alias("w_f"), "match")
    f = findings(spark, sf_dir, "file").filter(L.given(F.col("file")).isNotNull()).withColumn("path", F.regexp_replace("file", r"[\\/]+", "/"))
    f = f.join(to, F.col("project").eqNullSafe(F.col("w_p")) & (F.col("path") == F.col("w_f")), "left").select("project", F.coalesce("match", "path").alias("file"), "entry_idx", F.lit(0).alias("concern"))
    c = entries(spark, sf_dir, "build_concerns").select("project", "entry_idx", F.explode("build_concerns").alias("c")).filter(L.given(F.col("c.file")).isNotNull()).select("project", "c.file", "entry_idx", F.lit(1).alias("concern"))
    return f.unionByName(c).groupBy("project", "file").agg(F.count_if(F.col("concern") == 0).alias("findings"), F.count_if(F.col("concern") == 1).alias("concerns"), F.count_distinct("entry_idx").alias("touch_count"), F.max("entry_idx").alias("last_touched"))


_CONTRACT = """
c0 AS (SELECT contract_id, project, slug, body FROM contracts QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY sealed_at DESC NULLS LAST, body DESC NULLS LAST) = 1),
c1 AS (SELECT contract_id, project, slug, CASE WHEN json_type(body) = 'VARCHAR' THEN body ->> '$' ELSE body END AS body FROM c0 WHERE json_valid(body)),
c2 AS (SELECT contract_id, project, slug, CASE WHEN json_type(body, '$.data') = 'OBJECT' THEN (body -> '$.data')::VARCHAR ELSE body END AS body FROM c1 WHERE json_valid(body)),
c AS (SELECT contract_id, project, slug, CASE WHEN json_type(body, '$.contract') = 'OBJECT' THEN (body -> '$.contract')::JSON ELSE body::JSON END AS body FROM c2 WHERE json_type(body) = 'OBJECT'),
a0 AS (SELECT contract_id, unnest(CAST(body -> '$.assertions' AS JSON[])) AS a FROM c WHERE json_type(body, '$.assertions') = 'ARRAY'),
x AS (
  SELECT contract_id, a FROM a0 WHERE json_type(a) = 'OBJECT' AND coalesce(json_type(a, '$.assertions'), '') NOT IN ('ARRAY', 'OBJECT')
  UNION ALL SELECT contract_id, unnest(CAST(a -> '$.assertions' AS JSON[])) FROM a0 WHERE json_type(a, '$.assertions') = 'ARRAY'
  UNION ALL SELECT contract_id, v -> k FROM (SELECT contract_id, body -> '$.assertions' AS v, unnest(json_keys(body, '$.assertions')) AS k FROM c WHERE json_type(body, '$.assertions') = 'OBJECT')),
k0 AS (SELECT contract_id AS item, a ->> '$.ac' AS ac, a ->> '$.matcher' AS matcher FROM x WHERE json_type(a, '$.ac') NOT IN ('ARRAY', 'OBJECT', 'BOOLEAN', 'NULL')
  UNION ALL SELECT contract_id, unnest(CAST(a -> '$.ac' AS VARCHAR[])), a ->> '$.matcher' FROM x WHERE json_type(a, '$.ac') = 'ARRAY'),
k AS (SELECT item, upper(ac) AS ac, matcher FROM (SELECT item, trim(unnest(string_split(replace(ac, ';', ','), ','))) AS ac, matcher FROM k0) WHERE ac <> ''),
w0 AS (SELECT contract_id AS item, unnest(CAST(body -> '$.coverage_waivers' AS JSON[])) AS w, unnest(range(json_array_length(body, '$.coverage_waivers')::BIGINT)) AS i FROM c WHERE json_type(body, '$.coverage_waivers') = 'ARRAY'),
w AS (SELECT item, upper(trim(w ->> '$.ac')) AS ac, arg_max(w ->> '$.kind', i) AS way FROM w0 WHERE trim(w ->> '$.ac') <> '' AND w ->> '$.kind' IN ('judgment', 'retired') AND trim(w ->> '$.reason') <> '' GROUP BY 1, 2),
tot AS (SELECT project, slug, arg_max(acceptance_criteria.total, entry_idx) AS total FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_idx ORDER BY ingested_at DESC NULLS LAST) = 1)
  WHERE slug IS NOT NULL AND acceptance_criteria.total > 0 GROUP BY ALL),
s AS (SELECT item, ac FROM k UNION SELECT item, ac FROM w UNION SELECT contract_id, 'AC' || unnest(range(1, total + 1)) FROM c JOIN tot USING (project, slug))
"""


def _coverage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(contracts, coverage) of contracts in every form of body; in scope are the criteria a contract names and AC1 to the total of its work item's last entry that has one."""
    c = latest(table(spark, sf_dir, "contracts").select("contract_id", "project", "slug", "sealed_at", "body"), ["contract_id"], [F.desc_nulls_last("sealed_at"), F.desc_nulls_last("body")])
    rows = materialise(nested.contract_criteria(c), "criteria")
    links = rows.filter("kind = 'link'").select("item", "ac", "matcher")
    waivers = rows.filter("kind = 'waiver'").select("item", "ac", F.col("matcher").alias("way"))
    total = F.col("acceptance_criteria.total")
    e = entries(spark, sf_dir, "slug", "acceptance_criteria").filter(F.col("slug").isNotNull() & (total > 0)).groupBy("project", "slug").agg(F.max_by(total, "entry_idx").alias("total"))
    valid = rows.filter("kind = 'contract'").select("item")
    stated = c.select(F.col("contract_id").cast("bigint").alias("item"), "project", "slug").join(valid, "item", "left_semi").join(e, ["project", "slug"])
    numbered = stated.select("item", F.explode(F.sequence(F.lit(1), "total")).alias("i")).select("item", F.concat(F.lit("AC"), F.col("i").cast("string")).alias("ac"))
    scope = links.select("item", "ac").unionByName(waivers.select("item", "ac")).unionByName(numbered).distinct()
    return valid, J.coverage(scope, links, waivers)


_COVERED = """,
g AS (SELECT item, ac, count(*) AS links, bool_and(coalesce(matcher, '') IN ('exists', 'contains', 'truthy')) AS weak_only FROM k GROUP BY ALL),
v AS (SELECT s.item, s.ac, CASE WHEN links > 0 THEN 'pinned' ELSE coalesce(way, 'uncovered') END AS state,
  coalesce(links, 0) AS links, coalesce(weak_only, false) AS weak_only FROM s LEFT JOIN g ON g.item = s.item AND g.ac = s.ac LEFT JOIN w ON w.item = s.item AND w.ac = s.ac)
"""


@R.query("criterion_coverage", "WITH" + _CONTRACT + _COVERED + "SELECT * FROM v")
def criterion_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)[1]


@R.query(
    "coverage_gate",
    "WITH" + _CONTRACT + _COVERED + "SELECT item, count(*) FILTER (state = 'uncovered') AS uncovered, count(*) FILTER (weak_only) AS weak, CASE WHEN count(*) FILTER (state = 'pinned') = 0 THEN 'degrade' WHEN count(*) FILTER (state = 'uncovered') > 0 THEN 'block' ELSE 'active' END AS gate FROM (SELECT contract_id AS item FROM c) LEFT JOIN v USING (item) GROUP BY item",
)
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-13: a contract without any link degrades the gate, an uncovered criterion blocks."""
    valid, covered = _coverage(spark, sf_dir)
    v = valid.join(covered, "item", "left")
    open_, linked = F.count_if(F.col("state") == "uncovered"), F.count_if(F.col("state") == "pinned")
    return v.groupBy("item").agg(open_.alias("uncovered"), F.count_if("weak_only").alias("weak"), F.when(linked == 0, "degrade").when(open_ > 0, "block").otherwise("active").alias("gate"))


@R.query(
    "assertion_overlay",
    CTE
    + """,
s AS (SELECT project, slug, entry_idx, unnest(assertions) AS a, unnest(range(len(assertions))) AS i FROM e WHERE slug IS NOT NULL)
SELECT project, slug, a.id AS id, arg_max(struct_pack(x := a.status), (entry_idx, i)).x AS status, arg_min(struct_pack(x := a.deviation), (entry_idx, i)).x AS first_deviation, count(*) AS reports
FROM s WHERE a.id IS NOT NULL GROUP BY project, slug, a.id
""",
)
def assertion_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12, JN-13: the last report of an assertion overrides earlier ones; its first deviation text is looked up."""
    s = entries(spark, sf_dir, "slug", "assertions").filter(F.col("slug").isNotNull()).select("project", "slug", "entry_idx", F.posexplode("assertions").alias("i", "a")).filter(F.col("a.id").isNotNull())
    at = F.struct("entry_idx", "i")
    last, first = F.max_by(F.struct("a.status"), at), F.min_by(F.struct("a.deviation"), at)
    return s.groupBy("project", "slug", F.col("a.id").alias("id")).agg(last.getField("status").alias("status"), first.getField("deviation").alias("first_deviation"), F.count("*").alias("reports"))


_SURFACES = """, pre AS (SELECT DISTINCT project, regexp_extract(file, '^(packages/[^/]+|website|scripts|src)/', 1) AS prefix FROM t WHERE regexp_matches(file, '^(packages/[^/]+|website|scripts|src)/'))"""


@R.query(
    "surface_by_prefix",
    CTE
    + _SURFACES
    + """
SELECT t.project, t.entry_idx AS item, CASE WHEN count(DISTINCT prefix) = 1 THEN min(prefix) END AS prefix
FROM t LEFT JOIN pre ON pre.project = t.project AND starts_with(t.file, prefix || '/') GROUP BY t.project, t.entry_idx
""",
)
def surface_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_modules(spark, sf_dir)
    pattern = r"^(packages/[^/]+|website|scripts|src)/"
    prefixes = m.filter(F.col("file").rlike(pattern)).select("project", F.regexp_extract("file", pattern, 1).alias("prefix")).distinct()
    return J.by_prefix(m.select("project", F.col("entry_idx").alias("item"), "file"), prefixes)


@R.query(
    "colliding_names",
    CTE
    + _SURFACES
    + """
SELECT project, prefix AS path, CASE WHEN count(*) OVER (PARTITION BY project, regexp_extract(prefix, '([^/]*)$', 1)) > 1 AND contains(prefix, '/')
  THEN regexp_replace(prefix, '^.*?([^/]*)/([^/]*)$', '\\1-\\2') ELSE regexp_extract(prefix, '([^/]*)$', 1) END AS name FROM pre
""",
)
def colliding_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modules(spark, sf_dir)
    pattern = r"^(packages/[^/]+|website|scripts|src)/"
    return J.collision_names(m.filter(F.col("file").rlike(pattern)).select("project", F.regexp_extract("file", pattern, 1).alias("path")).distinct())


_LANGUAGES = {"ts": "TypeScript", "tsx": "TypeScript", "mjs": "JavaScript", "py": "Python", "go": "Go", "md": "Markdown", "json": "JSON", "yaml": "YAML"}
_LANG_SQL = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(_LANGUAGES.items()))


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(_LANGUAGES.items())], "ext string, language string, priority int")


@R.query(
    "language_lookup",
    CTE
    + f""", d(ext, language, priority) AS (VALUES {_LANG_SQL}),
x AS (SELECT project, regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) AS ext FROM (SELECT DISTINCT project, file FROM t))
SELECT project, coalesce(language, 'Other') AS language, count(*) AS files, coalesce(min(priority), 99) AS priority FROM x LEFT JOIN d USING (ext) GROUP BY 1, 2
""",
)
def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15, FN-S21: a dictionary join, broadcast because the dictionary is a fixed list."""
    x = modules(spark, sf_dir).select("project", "file").distinct().select("project", F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1).alias("ext"))
    d = F.broadcast(languages(spark))
    return x.join(d, "ext", "left").groupBy("project", F.coalesce("language", F.lit("Other")).alias("language")).agg(F.count("*").alias("files"), F.coalesce(F.min("priority"), F.lit(99)).alias("priority"))


@R.query(
    "surface_tiers",
    CTE
    + """,
s AS (SELECT project, slug, surface, count(*) AS n FROM e WHERE nullif(surface, '') IS NOT NULL GROUP BY ALL),
g AS (SELECT project, slug, arg_max(surface, (n, surface)) AS surface FROM s WHERE slug IS NOT NULL GROUP BY ALL),
q AS (SELECT project, surface, sum(n) AS n FROM s GROUP BY ALL), p AS (SELECT project, arg_max(surface, (n, surface)) AS surface FROM q GROUP BY project)
SELECT e.entry_idx, coalesce(nullif(e.surface, ''), g.surface, p.surface) AS surface, CASE WHEN nullif(e.surface, '') IS NOT NULL THEN 'own' WHEN g.surface IS NOT NULL THEN 'item' WHEN p.surface IS NOT NULL THEN 'project' ELSE 'none' END AS tier
FROM e LEFT JOIN g ON g.project = e.project AND g.slug = e.slug LEFT JOIN p ON p.project = e.project
""",
)
def surface_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16, JN-17: an entry's own surface, else its work item's commonest, else its project's; and where it came from."""
    e = entries(spark, sf_dir, "slug", "surface")
    s = e.filter(L.given(F.col("surface")).isNotNull()).groupBy("project", "slug", F.col("surface").alias("s")).agg(F.count("*").alias("n"))
    g = s.filter(F.col("slug").isNotNull()).groupBy(F.col("project").alias("g_p"), F.col("slug").alias("g_s")).agg(F.max_by("s", F.struct("n", "s")).alias("item"))
    p = s.groupBy("project", "s").agg(F.sum("n").alias("n")).groupBy(F.col("project").alias("p_p")).agg(F.max_by("s", F.struct("n", "s")).alias("all"))
    own = L.given(F.col("surface"))
    joined = e.join(g, (F.col("project") == F.col("g_p")) & (F.col("slug") == F.col("g_s")), "left").join(p, F.col("project") == F.col("p_p"), "left")
    return joined.select("entry_idx", F.coalesce(own, "item", "all").alias("surface"), F.when(own.isNotNull(), "own").when(F.col("item").isNotNull(), "item").when(F.col("all").isNotNull(), "project").otherwise("none").alias("tier"))


@R.query(
    "entry_roles",
    CTE
    + """
SELECT entry_idx, concat_ws('+', CASE WHEN bool_or(regexp_matches(file, '\\.test\\.[a-z]+$')) THEN 'tested' END, CASE WHEN bool_or(ends_with(file, '.md')) THEN 'documented' END,
  CASE WHEN bool_or(ends_with(file, '.json') OR ends_with(file, '.yaml')) THEN 'configured' END) AS roles FROM t GROUP BY entry_idx
""",
)
def entry_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-18: every role that applies, in a fixed order."""
    f = F.col("file")
    role = lambda cond, name: F.when(F.bool_or(cond), name)
    return modules(spark, sf_dir).groupBy("entry_idx").agg(F.concat_ws("+", role(f.rlike(r"\.test\.[a-z]+$"), "tested"), role(f.endswith(".md"), "documented"), role(f.endswith(".json") | f.endswith(".yaml"), "configured")).alias("roles"))


_RULES = (("typed_web", "tsx"), ("typed_web", "json"), ("script_mix", "py"), ("script_mix", "go"), ("script_mix", "mjs"), ("documented", "md"), ("impossible", "ts"), ("impossible", "rb"))


@R.query(
    "rules_that_hold",
    CTE
    + f""", d(rule, trigger) AS (VALUES {", ".join(map(str, _RULES))}),
x AS (SELECT DISTINCT project, regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) AS fact FROM t)
SELECT project, rule FROM x JOIN d ON fact = trigger GROUP BY project, rule HAVING count(*) = (SELECT count(*) FROM d r WHERE r.rule = d.rule)
""",
)
def rules_that_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = modules(spark, sf_dir).select("project", F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1).alias("fact"))
    return J.all_hold(facts, spark.createDataFrame(list(_RULES), "rule string, trigger string"))


@R.query(
    "orphan_contracts",
    CTE + "SELECT DISTINCT contract_id, project, slug FROM contracts c WHERE slug IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.project = c.project AND e.slug = c.slug)",
)
def orphan_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-20: contracts claimed by a work item that the ledger does not know."""
    known = entries(spark, sf_dir, "slug").select("project", "slug").distinct()
    c = table(spark, sf_dir, "contracts").filter(F.col("slug").isNotNull()).select("contract_id", "project", "slug").distinct()
    return c.join(known, ["project", "slug"], "left_anti").select("contract_id", "project", "slug")


@R.query(
    "near_lines",
    CTE
    + """, n AS (SELECT project, file, line, count(*) AS here FROM f WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL)
SELECT project, file, line, here, CAST(sum(here) OVER (PARTITION BY project, file ORDER BY line RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS BIGINT) AS near FROM n
""",
)
def near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.near_lines(findings(spark, sf_dir, "file", "line"))


@R.query(
    "marks_above",
    CTE
    + """, m AS (SELECT project, file, line, count(*) AS n FROM f WHERE severity = 'risk' AND file IS NOT NULL AND line IS NOT NULL GROUP BY ALL)
SELECT q.project, q.file, q.line, CAST(sum(n) AS BIGINT) AS marks FROM (SELECT DISTINCT project, file, line FROM f) q
JOIN m ON m.project = q.project AND m.file = q.file AND m.line BETWEEN q.line - 5 AND q.line - 1 GROUP BY ALL
""",
)
def marks_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir, "file", "line", "severity").filter(F.col("file").isNotNull() & F.col("line").isNotNull())
    return J.above_within(f.filter(F.col("severity") == "risk"), f)


@R.query(
    "paired_runs",
    """
WITH r AS (SELECT * FROM timings QUALIFY row_number() OVER (PARTITION BY timing_id ORDER BY loaded_at DESC NULLS LAST) = 1),
n AS (SELECT project, kind, total_minutes, row_number() OVER (PARTITION BY project, kind ORDER BY timing_id) AS nth FROM r WHERE total_minutes IS NOT NULL AND NOT isnan(total_minutes) AND kind IN ('fix', 'chore')),
p AS (SELECT a.project, a.total_minutes AS x, b.total_minutes AS y FROM n a JOIN n b ON a.project = b.project AND a.nth = b.nth WHERE a.kind = 'fix' AND b.kind = 'chore'),
c AS (SELECT project, count(*) AS runs FROM n GROUP BY project)
SELECT project, count(*) AS pairs, count(*) FILTER (y < x) AS wins, floor((count(*) FILTER (y < x))::DOUBLE / count(*) * 1e4 + 0.5) / 1e4 AS win_rate, floor(avg(x - y) * 100 + 0.5) / 100 AS mean_reduction, any_value(runs) - 2 * count(*) AS dropped FROM p JOIN c USING (project) GROUP BY project
""",
)
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-23, AGG-36: the i-th run of one kind against the i-th of another: wins, their rate, mean reduction, and the runs dropped for want of a partner."""
    r = latest(table(spark, sf_dir, "timings").select("timing_id", "loaded_at", "project", "kind", "total_minutes"), ["timing_id"], [F.desc_nulls_last("loaded_at")])
    r = r.filter(F.col("kind").isin("fix", "chore") & F.col("total_minutes").isNotNull() & ~F.isnan("total_minutes"))
    n = J.numbered(r, ["project", "kind"], ["timing_id"], F.floor(F.col("timing_id") / 50_000))
    pair = J.zipped(n.filter(F.col("kind") == "fix").select("project", "nth", "total_minutes"), n.filter(F.col("kind") == "chore").select("project", "nth", "total_minutes"), ["project"])
    x, y = F.col("total_minutes"), F.col("b_total_minutes")
    per = pair.groupBy("project").agg(F.count("*").alias("pairs"), F.count_if(y < x).alias("wins"), (F.floor(F.avg(x - y) * 100 + 0.5) / 100).alias("mean_reduction"))
    runs = r.groupBy(F.col("project").alias("r_p")).agg(F.count("*").alias("runs"))
    rate = F.floor(F.col("wins") / F.col("pairs") * 1e4 + 0.5) / 1e4
    return per.join(runs, F.col("project") == F.col("r_p")).select("project", "pairs", "wins", rate.alias("win_rate"), "mean_reduction", (F.col("runs") - 2 * F.col("pairs")).alias("dropped"))


@R.query(
    "changelog_without_manifest",
    CTE + "SELECT entry_idx FROM t GROUP BY entry_idx HAVING bool_or(file = 'CHANGELOG.md') AND NOT bool_or(file = 'package.json' OR ends_with(file, '/package.json'))",
)
def changelog_without_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-24: entries with the one file but not the other, as a semi and an anti join."""
    t = modules(spark, sf_dir)
    has = t.filter(F.col("file") == "CHANGELOG.md").select("entry_idx").distinct()
    return has.join(t.filter(base_name(F.col("file")) == "package.json").select("entry_idx"), "entry_idx", "left_anti")


@R.query(
    "findings_in_scope",
    CTE
    + """, q AS (SELECT finding_id, project, entry_idx, regexp_replace(file, '[\\\\/]+', '/', 'g') AS path FROM f WHERE nullif(file, '') IS NOT NULL)
SELECT project, count(*) AS findings, count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.entry_idx = q.entry_idx AND (t.file = path OR ends_with(path, '/' || t.file) OR ends_with(t.file, '/' || path)))) AS in_scope FROM q GROUP BY project
""",
)
def findings_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-25: findings whose file is among those their entry touched, by suffix: a hash join on entry and base name."""
    q = findings(spark, sf_dir, "file").filter(L.given(F.col("file")).isNotNull()).withColumn("path", F.regexp_replace("file", r"[\\/]+", "/"))
    t = modules(spark, sf_dir).select(F.col("entry_idx").alias("t_e"), F.col("file").alias("t_f"), base_name(F.col("file")).alias("t_b"))
    from tallyforge.functions.paths import same_file

    hit = q.join(t, (F.col("entry_idx") == F.col("t_e")) & (base_name(F.col("path")) == F.col("t_b")) & same_file(F.col("path"), F.col("t_f")), "left_semi").select(F.col("finding_id").alias("h"))
    return q.join(hit, F.col("finding_id") == F.col("h"), "left").groupBy("project").agg(F.count("*").alias("findings"), F.count("h").alias("in_scope"))


@R.query(
    "merged_surfaces",
    CTE
    + """,
o AS (SELECT project, surface, count(*) AS runs, min(feature) AS label FROM e WHERE surface IS NOT NULL AND substr(completed_at, 1, 4) < '2025' GROUP BY ALL),
n AS (SELECT project, surface, count(*) AS runs, min(feature) AS label FROM e WHERE surface IS NOT NULL AND substr(completed_at, 1, 4) >= '2025' GROUP BY ALL)
SELECT project, surface, coalesce(n.runs, o.runs) AS runs, coalesce(o.label, n.label) AS label, CASE WHEN o.runs IS NULL THEN 'added' WHEN n.runs IS NULL THEN 'kept' ELSE 'refreshed' END AS state
FROM o FULL JOIN n USING (project, surface)
""",
)
def merged_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir, "surface", "feature", "completed_at").filter(F.col("surface").isNotNull())
    year = F.substring("completed_at", 1, 4)
    part = lambda cond: e.filter(cond).groupBy("project", "surface").agg(F.count("*").alias("runs"), F.min("feature").alias("label"))
    return J.merged(part(year < "2025"), part(year >= "2025"), ["project", "surface"], ["runs"], ["label"])


@R.query(
    "total_mismatch",
    CTE
    + """
SELECT entry_idx, contract.total AS stated, len(assertions) AS listed FROM e WHERE contract IS NOT NULL AND contract.total IS DISTINCT FROM len(assertions)
""",
)
def total_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-30: a fact stated in two places that differs, nulls compared as values."""
    e = entries(spark, sf_dir, "contract", "assertions").filter(F.col("contract").isNotNull())
    listed = F.when(F.col("assertions").isNotNull(), F.size("assertions")).cast("bigint")
    return e.select("entry_idx", F.col("contract.total").alias("stated"), listed.alias("listed")).filter(~F.col("stated").eqNullSafe(F.col("listed")))


@R.query(
    "duplicate_rules",
    CTE
    + r""",
w AS (SELECT finding_id, project, file, category, list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS words FROM a WHERE nullif(file, '') IS NOT NULL AND suggested_action = 'promote' AND category IS NOT NULL)
SELECT x.finding_id AS finding_a, y.finding_id AS finding_b FROM w x JOIN w y ON x.project = y.project AND x.file = y.file AND x.category = y.category AND x.finding_id < y.finding_id
WHERE len(list_intersect(x.words, y.words)) > 0.5 * least(len(x.words), len(y.words))
""",
)
def duplicate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03: promoted findings of one file and category whose word sets overlap by more than half of the smaller."""
    a = findings(spark, sf_dir, "file", "category", "summary", "status", "suggested_action").filter(L.is_active(F.col("status")) & L.given(F.col("file")).isNotNull() & F.col("category").isNotNull() & (F.col("suggested_action") == "promote"))
    return J.overlapping(a, ["project", "file", "category"], "finding_id", F.col("summary")).select(F.col("a").alias("finding_a"), F.col("b").alias("finding_b"))


@R.query(
    "first_touch_order",
    CTE + "SELECT project, file, min(entry_idx) AS first_touch, row_number() OVER (PARTITION BY project ORDER BY min(entry_idx), file) AS place FROM t GROUP BY project, file",
)
def first_touch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01, SET-06: the union of all lists of a project, each file at the place it was first seen."""
    first = modules(spark, sf_dir).groupBy("project", "file").agg(F.min("entry_idx").alias("first_touch"))
    return J.numbered(first, ["project"], ["first_touch", "file"], F.floor(F.col("first_touch") / 5_000), "place")


@R.query(
    "case_insensitive_first",
    CTE + "SELECT project, lower(surface) AS surface_key, arg_min(surface, entry_idx) AS surface FROM e WHERE surface IS NOT NULL GROUP BY ALL",
)
def case_insensitive_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: one spelling per text whatever its case, the first."""
    e = entries(spark, sf_dir, "surface").filter(F.col("surface").isNotNull())
    return e.groupBy("project", F.lower("surface").alias("surface_key")).agg(F.min_by("surface", "entry_idx").alias("surface"))



