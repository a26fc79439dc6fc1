"""Queries on drifting schemas (p1) and nested records (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import nested, schema_drift
from tallyforge.operators.rows import latest
from tallyforge.registry import Registry, table
from tallyforge.session import materialise, release

R = Registry()

SERIES = ["project", "doc_type"]


#: Columns of the two record types by path, with the forms and former names that are known of them. The union
#: schema starts from these, so the columns are the same whatever a load happens to hold; all else is found in the files.
K = schema_drift.Known
_TOTAL = K(("integer", "decimal", "string"))
KNOWN = {
    "proof": {
        "acceptance_criteria": K(("object", "array", "string"), ("acceptanceCriteria", "criteria_summary")),
        "acceptance_criteria.total": _TOTAL,
        "acceptance_criteria.met": K(("integer",), ("fulfilled", "met_count", "passed")),
        "acceptance_criteria.partial": K(("integer",)),
        **{f"acceptance_criteria.coverage{x}": K((t,)) for x, t in (("", "object"), *((f".{y}", "integer") for y in ("pinned", "judgment", "retired", "uncovered", "weak_only")))},
        "acceptance_criteria[]": K(("object",)),
        **{f"acceptance_criteria[].{x}": K(("string",)) for x in ("id", "state")},
        "verdict_contradictions": K(("array", "string"), ("verdictContradictions", "contradictions")),
        "verdict_contradictions[]": K(("object", "string")),
        "verdict_contradictions[].reason": K(("string",)),
        "verdict_contradictions[].row": K(("integer",)),
        "rejection_cycles": K(("boolean", "integer", "string")),
        "phases": K(("integer",)),
        "surface": K(("string",)),
        "timing": K(("object",)),
        "timing.total_minutes": _TOTAL,
    },
    "contract": {
        "version": K(("integer", "decimal", "string"), ("contractVersion", "schema_version")),
        "assertions": K(("array",)),
        "assertions[]": K(("object",)),
        "assertions[].ac": K(("array", "integer", "string"), ("acs", "covers", "criteria")),
        "assertions[].ac[]": K(("string",)),
        "assertions[].target": K(("string",)),
        "file_changes": K(("array",), ("fileChanges", "files")),
        "file_changes[]": K(("object",)),
        "file_changes[].action": K(("string",), ("op",)),
        "file_changes[].path": K(("string",)),
        "coverage_waivers": K(("array",)),
        "coverage_waivers[]": K(("object",)),
        **{f"coverage_waivers[].{x}": K(("string",)) for x in ("ac", "kind", "reason")},
    },
}


def _schemas(raw: DataFrame) -> DataFrame:
    return schema_drift.file_schemas(raw, SERIES, "file_no", "body")


@R.query(
    "p1_found",
    r"""
WITH docs AS (SELECT project, doc_type, file_no, body FROM raw_records WHERE json_valid(body)),
walk AS (
  SELECT d.project, d.doc_type, d.file_no, t.fullkey, t.type, t.atom
  FROM docs d, json_tree(d.body) t
  WHERE t.type <> 'NULL' AND t.fullkey <> '$' AND json_type(d.body) = 'OBJECT'),
typed AS (
  SELECT DISTINCT project, doc_type, file_no,
    regexp_replace(regexp_replace(substr(fullkey, 3), '\[[0-9]+\]', '[]', 'g'), '"', '', 'g') AS path,
    CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal'
      WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS type
  FROM walk),
s AS (SELECT project, doc_type, file_no, path, string_agg(type, '|' ORDER BY type) AS types FROM typed GROUP BY ALL),
files AS (SELECT DISTINCT project, doc_type, file_no FROM raw_records),
pairs AS (SELECT a.* FROM files a JOIN files b ON a.project = b.project AND a.doc_type = b.doc_type AND a.file_no = b.file_no + 1),
cur AS (SELECT s.* FROM s JOIN pairs USING (project, doc_type, file_no)),
old AS (SELECT s.project, s.doc_type, s.file_no + 1 AS file_no, s.path, s.types FROM s
  JOIN pairs p ON s.project = p.project AND s.doc_type = p.doc_type AND s.file_no + 1 = p.file_no),
diff AS (
  SELECT project, doc_type, file_no, path, coalesce(cur.types, old.types) AS types,
    CASE WHEN old.types IS NULL THEN 'added' WHEN cur.types IS NULL THEN 'removed' ELSE 'retyped' END AS kind
  FROM cur FULL JOIN old USING (project, doc_type, file_no, path)
  WHERE cur.types IS DISTINCT FROM old.types),
top AS (
  SELECT *, regexp_replace(path, '(\.[^.\[]*|\[\])$', '') AS parent0 FROM diff d
  WHERE NOT EXISTS (SELECT 1 FROM diff u WHERE u.project = d.project AND u.doc_type = d.doc_type AND u.file_no = d.file_no
    AND (starts_with(d.path, u.path || '.') OR starts_with(d.path, u.path || '[')))),
topp AS (SELECT *, CASE WHEN parent0 = path THEN '' ELSE parent0 END AS parent FROM top),
moved AS (
  SELECT project, doc_type, file_no, max(path) FILTER (kind = 'removed') AS old_path, max(path) FILTER (kind = 'added') AS new_path
  FROM topp WHERE kind <> 'retyped' GROUP BY project, doc_type, file_no, parent, types
  HAVING count(*) FILTER (kind = 'removed') = 1 AND count(*) FILTER (kind = 'added') = 1)
SELECT project, doc_type, file_no, 'renamed' AS change_kind, old_path, new_path FROM moved
UNION ALL
SELECT project, doc_type, file_no, kind, path, path FROM topp t
WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.project = t.project AND m.doc_type = t.doc_type AND m.file_no = t.file_no
  AND t.path IN (m.old_path, m.new_path))
""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = schema_drift.schema_changes(_schemas(table(spark, sf_dir, "raw_records")), SERIES, "file_no")
    return changes.select("project", "doc_type", "file_no", "change_kind", "old_path", "new_path")


def _union(spark: SparkSession, sf_dir: str, doc_type: str) -> tuple[DataFrame, schema_drift.Node]:
    raw = table(spark, sf_dir, "raw_records").filter(F.col("doc_type") == doc_type)
    schemas = materialise(_schemas(raw), "file-schemas")  # read by the differences, the fold and the search for siblings
    root = schema_drift.union_schema(schemas, schema_drift.schema_changes(schemas, SERIES, "file_no"), KNOWN[doc_type])
    release(schemas)
    return raw, root


def _unified(spark: SparkSession, sf_dir: str, doc_type: str) -> DataFrame:
    raw, root = _union(spark, sf_dir, doc_type)
    return schema_drift.unify(raw, ["raw_id", "project", "doc_type", "file_no", "line_no"], "body", root)


@R.query("p1_unified_proof")
def p1_unified_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All proof records as one typed table."""
    return _unified(spark, sf_dir, "proof")


@R.query("p1_unified_contract")
def p1_unified_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contract records as one typed table."""
    return _unified(spark, sf_dir, "contract")


@R.query("p1_columns")
def p1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_type, column, key, type, files): which key of the records went to which column of the unified tables."""
    rows = [(d, *r) for d in KNOWN for r in schema_drift.column_map(_union(spark, sf_dir, d)[1])]
    return spark.createDataFrame(rows, "doc_type string, column string, key string, type string, files bigint")


_JSON_FIELDS = """
WITH d AS (SELECT raw_id, body::JSON AS b FROM raw_records WHERE doc_type = '{doc_type}' AND json_valid(body) AND json_type(body) = 'OBJECT')
"""


def _first(*names: str) -> str:
    """The first of a record's names whose value is not null, in SQL."""
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(b, '$.{n}') <> 'NULL' THEN b -> '$.{n}' END" for n in names) + ")"


@R.query(
    "p1_proof_fields",
    _JSON_FIELDS.format(doc_type="proof")
    + f""", x AS (SELECT raw_id, {_first("acceptance_criteria", "acceptanceCriteria", "criteria_summary")} AS ac,
  {_first("verdict_contradictions", "verdictContradictions", "contradictions")} AS vc, b ->> '$.timing.total_minutes' AS minutes, b ->> '$.rejection_cycles' AS cycles FROM d)
SELECT raw_id, ac ->> '$.total' AS ac_total, CAST(coalesce(ac ->> '$.met', ac ->> '$.fulfilled', ac ->> '$.met_count', ac ->> '$.passed') AS BIGINT) AS ac_met, CAST(ac ->> '$.coverage.pinned' AS BIGINT) AS ac_pinned,
  CASE WHEN json_type(ac) = 'ARRAY' THEN json_array_length(ac)::BIGINT END AS ac_items, CASE WHEN json_type(ac) = 'VARCHAR' THEN ac ->> '$' END AS ac_text,
  CASE WHEN json_type(vc) = 'ARRAY' THEN json_array_length(vc)::BIGINT WHEN vc IS NOT NULL THEN 1 END AS contradictions,
  CASE WHEN json_type(vc) = 'ARRAY' THEN CASE WHEN json_type(vc, '$[0]') = 'OBJECT' THEN vc ->> '$[0].reason' ELSE vc ->> '$[0]' END ELSE vc ->> '$' END AS first_contradiction, minutes, cycles
FROM x
""",
)
def p1_proof_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the unified proof table, one flat row per valid record."""
    t = p1_unified_proof(spark, sf_dir).filter(F.col("result").isNotNull())
    ac, vc = F.col("acceptance_criteria"), F.col("verdict_contradictions")
    count = lambda c: F.when(c.isNotNull(), F.size(c).cast("bigint"))
    first = F.try_element_at(vc, F.lit(1))
    return t.select("raw_id", ac["total"].alias("ac_total"), ac["met"].alias("ac_met"), ac["coverage"]["pinned"].alias("ac_pinned"), count(ac["_items"]).alias("ac_items"), ac["_value"].alias("ac_text"), count(vc).alias("contradictions"), F.coalesce(first["reason"], first["_value"]).alias("first_contradiction"), F.col("timing.total_minutes").alias("minutes"), F.col("rejection_cycles").alias("cycles"))


@R.query(
    "p1_contract_fields",
    _JSON_FIELDS.format(doc_type="contract")
    + f""", x AS (SELECT raw_id, {_first("version", "contractVersion", "schema_version")} ->> '$' AS version, {_first("file_changes", "fileChanges", "files")} AS f, unnest(CAST(b -> '$.assertions' AS JSON[])) AS b FROM d),
y AS (SELECT raw_id, version, f, {_first("ac", "acs", "covers", "criteria")} AS ac FROM x)
SELECT raw_id, any_value(version) AS version, any_value(json_array_length(f))::BIGINT AS file_changes, any_value(coalesce(f ->> '$[0].action', f ->> '$[0].op')) AS first_action, count(*) AS assertions, count(ac) AS with_ac,
  CAST(sum(CASE WHEN json_type(ac) = 'ARRAY' THEN json_array_length(ac) WHEN ac IS NOT NULL THEN 1 END) AS BIGINT) AS criteria,
  string_agg(CASE WHEN json_type(ac) = 'ARRAY' THEN array_to_string(CAST(ac AS VARCHAR[]), '+') ELSE ac ->> '$' END, ',' ORDER BY CASE WHEN json_type(ac) = 'ARRAY' THEN array_to_string(CAST(ac AS VARCHAR[]), '+') ELSE ac ->> '$' END) AS listed
FROM y GROUP BY raw_id
""",
)
def p1_contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the unified contract table, one flat row per valid record with assertions."""
    t = p1_unified_contract(spark, sf_dir).filter(F.size("assertions") > 0)
    acs = F.transform("assertions", lambda a: a["ac"])
    given = F.filter(acs, lambda x: x.isNotNull())
    listed = F.nullif(F.array_join(F.array_sort(F.transform(given, lambda x: F.array_join(x, "+"))), ","), F.lit(""))
    total = F.when(F.size(given) > 0, F.aggregate(given, F.lit(0), lambda n, x: n + F.size(x)).cast("bigint"))
    return t.select("raw_id", "version", F.when(F.col("file_changes").isNotNull(), F.size("file_changes").cast("bigint")).alias("file_changes"), F.try_element_at("file_changes", F.lit(1))["action"].alias("first_action"), F.size("assertions").cast("bigint").alias("assertions"), F.size(given).cast("bigint").alias("with_ac"), total.alias("criteria"), listed.alias("listed"))


def _children(spark: SparkSession, sf_dir: str, links: bool = True) -> DataFrame:
    entries = latest(table(spark, sf_dir, "entries").select("entry_idx", "ingested_at", "assertions", "contract", "timing"), ["entry_idx"], [F.desc_nulls_last("ingested_at")])
    contracts = latest(table(spark, sf_dir, "contracts").select("contract_id", "sealed_at", "body"), ["contract_id"], [F.desc_nulls_last("sealed_at"), F.desc_nulls_last("body")])
    return nested.entry_tables(entries, links).unionByName(nested.contract_tables(contracts, links))


@R.query(
    "p5_found",
    r"""
WITH e AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_idx ORDER BY ingested_at DESC NULLS LAST) = 1),
c0 AS (SELECT contract_id, body FROM contracts QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY sealed_at DESC NULLS LAST, body DESC NULLS LAST) = 1),
c1 AS (SELECT contract_id, CASE WHEN json_type(body) = 'VARCHAR' THEN body ->> '$' ELSE body END AS body FROM c0 WHERE json_valid(body)),
c2 AS (SELECT contract_id, CASE WHEN json_type(body, '$.data') = 'OBJECT' THEN (body -> '$.data')::VARCHAR ELSE body END AS body FROM c1 WHERE json_valid(body)),
c AS (SELECT contract_id, CASE WHEN json_type(body, '$.contract') = 'OBJECT' THEN (body -> '$.contract')::JSON ELSE body::JSON END AS body FROM c2),
a0 AS (
  SELECT contract_id, unnest(CAST(body -> '$.assertions' AS JSON[])) AS a FROM c WHERE json_type(body, '$.assertions') = 'ARRAY'),
a1 AS (
  SELECT contract_id, a ->> '$.id' AS id, a -> '$.ac' AS ac FROM a0 WHERE json_type(a, '$.assertions') IS NULL
  UNION ALL
  SELECT contract_id, b ->> '$.id', b -> '$.ac' FROM (
    SELECT contract_id, unnest(CAST(a -> '$.assertions' AS JSON[])) AS b FROM a0 WHERE json_type(a, '$.assertions') = 'ARRAY')
  UNION ALL
  SELECT contract_id, k, (v -> k) -> '$.ac' FROM (
    SELECT contract_id, body -> '$.assertions' AS v, unnest(json_keys(body, '$.assertions')) AS k FROM c WHERE json_type(body, '$.assertions') = 'OBJECT')),
a AS (SELECT contract_id, trim(id) AS id, ac FROM a1 WHERE trim(id) <> ''),
ac AS (
  SELECT contract_id, id, unnest(CASE WHEN json_type(ac) = 'ARRAY' THEN CAST(ac AS VARCHAR[]) ELSE [ac ->> '$'] END) AS x
  FROM a WHERE json_type(ac) IN ('ARRAY', 'VARCHAR')),
ac1 AS (SELECT contract_id, id, trim(unnest(string_split(replace(x, ';', ','), ','))) AS x FROM ac),
f0 AS (SELECT contract_id, body -> '$.file_changes' AS f FROM c),
f1 AS (SELECT contract_id, unnest(CAST(f AS JSON[])) AS f FROM f0 WHERE json_type(f) = 'ARRAY'),
f2 AS (SELECT contract_id, f, unnest(json_keys(f)) AS k FROM f0 WHERE json_type(f) = 'OBJECT' AND json_type(f, '$.path') IS NULL),
fp AS (
  SELECT contract_id, f ->> '$' AS p FROM f1 WHERE json_type(f) = 'VARCHAR'
  UNION ALL SELECT contract_id, f ->> '$.path' FROM f1
  UNION ALL SELECT contract_id, f ->> '$.path' FROM f0 WHERE json_type(f) = 'OBJECT'
  UNION ALL SELECT contract_id, CASE WHEN d <> '' THEN rtrim(d, '/') || '/' ELSE '' END || n FROM (
    SELECT contract_id, f ->> '$.dir' AS d, unnest(CAST(f -> '$.files' AS JSON[])) ->> '$.name' AS n FROM f1 WHERE json_type(f, '$.files') = 'ARRAY')
  UNION ALL SELECT contract_id, k FROM f2 WHERE json_type(f -> k) = 'VARCHAR'
  UNION ALL SELECT contract_id, x ->> '$' FROM (
    SELECT contract_id, unnest(CAST(f -> k AS JSON[])) AS x FROM f2 WHERE json_type(f -> k) = 'ARRAY')),
ea AS (SELECT entry_idx, unnest(assertions) AS a FROM e)
SELECT DISTINCT entry_idx::BIGINT AS parent_key, 'entry_assertion' AS child_kind, trim(a.id) AS child_key FROM ea WHERE trim(a.id) <> ''
UNION ALL SELECT DISTINCT entry_idx::BIGINT, 'entry_contract', 'contract' FROM e
  WHERE coalesce(contract.total, contract.satisfied, contract.unsatisfied, contract.deviated) IS NOT NULL
UNION ALL SELECT DISTINCT entry_idx::BIGINT, 'entry_segment', (i - 1)::VARCHAR FROM (
  SELECT entry_idx, timing.segments AS s, unnest(range(1, len(timing.segments) + 1)) AS i FROM e) WHERE s[i] IS NOT NULL
UNION ALL SELECT DISTINCT contract_id, 'assertion', id FROM a
UNION ALL SELECT DISTINCT contract_id, 'assertion_ac', id || '/' || x FROM ac1 WHERE x <> ''
UNION ALL SELECT DISTINCT contract_id, 'file_change', trim(p) FROM fp WHERE trim(p) <> ''
""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _children(spark, sf_dir, links=False).select("parent_key", "child_kind", "child_key").distinct()


@R.query(
    "p5_children",
    r"""
WITH e AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_idx ORDER BY ingested_at DESC NULLS LAST) = 1),
c0 AS (SELECT contract_id, body FROM contracts QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY sealed_at DESC NULLS LAST, body DESC NULLS LAST) = 1),
c1 AS (SELECT contract_id, CASE WHEN json_type(body) = 'VARCHAR' THEN body ->> '$' ELSE body END AS body FROM c0 WHERE json_valid(body)),
c2 AS (SELECT contract_id, CASE WHEN json_type(body, '$.data') = 'OBJECT' THEN (body -> '$.data')::VARCHAR ELSE body END AS body FROM c1 WHERE json_valid(body)),
c AS (SELECT contract_id, CASE WHEN json_type(body, '$.contract') = 'OBJECT' THEN (body -> '$.contract')::JSON ELSE body::JSON END AS body FROM c2),
a0 AS (SELECT contract_id, a, 'assertions[' || i || ']' AS p FROM (
  SELECT contract_id, unnest(CAST(body -> '$.assertions' AS JSON[])) AS a, unnest(range(json_array_length(body, '$.assertions')::BIGINT)) AS i FROM c WHERE json_type(body, '$.assertions') = 'ARRAY')),
a1 AS (
  SELECT contract_id, p, a ->> '$.id' AS id, a FROM a0 WHERE json_type(a, '$.assertions') IS NULL
  UNION ALL
  SELECT contract_id, p || '.assertions[' || j || ']', b ->> '$.id', b FROM (
    SELECT contract_id, p, unnest(CAST(a -> '$.assertions' AS JSON[])) AS b, unnest(range(json_array_length(a, '$.assertions')::BIGINT)) AS j FROM a0 WHERE json_type(a, '$.assertions') = 'ARRAY')
  UNION ALL
  SELECT contract_id, 'assertions[' || j || ']', k, v -> k FROM (
    SELECT contract_id, body -> '$.assertions' AS v, unnest(json_keys(body, '$.assertions')) AS k, unnest(range(len(json_keys(body, '$.assertions')))) AS j FROM c WHERE json_type(body, '$.assertions') = 'OBJECT')),
a AS (SELECT contract_id, p, trim(id) AS id, a -> '$.ac' AS ac, CASE WHEN json_type(a, '$.says') = 'VARCHAR' THEN a ->> '$.says' END AS says FROM a1 WHERE trim(id) <> ''),
ac0 AS (
  SELECT contract_id, id, p, p || '.ac' AS q, list_filter(list_transform(string_split(replace(ac ->> '$', ';', ','), ','), lambda y : trim(y)), lambda y : y <> '') AS xs, true AS own FROM a WHERE json_type(ac) = 'VARCHAR'
  UNION ALL SELECT contract_id, id, p, p || '.ac[' || i || ']', list_filter(list_transform(string_split(replace(x, ';', ','), ','), lambda y : trim(y)), lambda y : y <> ''), false
  FROM (SELECT contract_id, id, p, unnest(CAST(ac AS VARCHAR[])) AS x, unnest(range(json_array_length(ac)::BIGINT)) AS i FROM a WHERE json_type(ac) = 'ARRAY')),
ac AS (SELECT contract_id, id, p, CASE WHEN own OR k > 0 THEN q || '[' || k || ']' ELSE q END AS q, x FROM (SELECT contract_id, id, p, q, own, unnest(xs) AS x, unnest(range(len(xs))) AS k FROM ac0)),
f0 AS (SELECT contract_id, body -> '$.file_changes' AS f FROM c),
f1 AS (SELECT contract_id, f, 'file_changes[' || i || ']' AS p FROM (SELECT contract_id, unnest(CAST(f AS JSON[])) AS f, unnest(range(json_array_length(f)::BIGINT)) AS i FROM f0 WHERE json_type(f) = 'ARRAY')),
f2 AS (SELECT contract_id, f, unnest(json_keys(f)) AS k, unnest(range(len(json_keys(f)))) AS i FROM f0 WHERE json_type(f) = 'OBJECT' AND json_type(f, '$.path') IS NULL),
fp AS (
  SELECT contract_id, p, f ->> '$' AS n, NULL AS action FROM f1 WHERE json_type(f) = 'VARCHAR'
  UNION ALL SELECT contract_id, p, f ->> '$.path', CASE WHEN json_type(f, '$.action') = 'VARCHAR' THEN f ->> '$.action' END FROM f1 WHERE json_type(f) = 'OBJECT'
  UNION ALL SELECT contract_id, 'file_changes', f ->> '$.path', CASE WHEN json_type(f, '$.action') = 'VARCHAR' THEN f ->> '$.action' END FROM f0 WHERE json_type(f) = 'OBJECT'
  UNION ALL SELECT contract_id, p || '.files[' || j || ']', CASE WHEN d <> '' THEN rtrim(d, '/') || '/' ELSE '' END || n, NULL FROM (
    SELECT contract_id, p, f ->> '$.dir' AS d, unnest(CAST(f -> '$.files' AS JSON[])) ->> '$.name' AS n, unnest(range(json_array_length(f, '$.files')::BIGINT)) AS j FROM f1 WHERE json_type(f, '$.files') = 'ARRAY')
  UNION ALL SELECT contract_id, 'file_changes[' || i || ']', k, f ->> k FROM f2 WHERE json_type(f -> k) = 'VARCHAR'
  UNION ALL SELECT contract_id, 'file_changes[' || i || '][' || j || ']', x ->> '$', NULL FROM (
    SELECT contract_id, i, unnest(CAST(f -> k AS JSON[])) AS x, unnest(range(json_array_length(f -> k)::BIGINT)) AS j FROM f2 WHERE json_type(f -> k) = 'ARRAY')),
ea AS (SELECT entry_idx, unnest(assertions) AS a, unnest(range(len(assertions))) AS i FROM e)
SELECT entry_idx::BIGINT AS parent_key, 'entry_assertion' AS child_kind, trim(a.id) AS child_key, NULL::VARCHAR AS parent_path, 'assertions[' || i || ']' AS path, a.says AS detail FROM ea WHERE trim(a.id) <> ''
UNION ALL SELECT entry_idx::BIGINT, 'entry_contract', 'contract', NULL, 'contract', NULL FROM e
  WHERE coalesce(contract.total, contract.satisfied, contract.unsatisfied, contract.deviated) IS NOT NULL
UNION ALL SELECT entry_idx::BIGINT, 'entry_segment', (i - 1)::VARCHAR, NULL, 'segments[' || (i - 1) || ']', s[i].stage FROM (
  SELECT entry_idx, timing.segments AS s, unnest(range(1, len(timing.segments) + 1)) AS i FROM e) WHERE s[i] IS NOT NULL
UNION ALL SELECT contract_id, 'assertion', id, NULL, p, says FROM a
UNION ALL SELECT contract_id, 'assertion_ac', id || '/' || x, p, q, NULL FROM ac
UNION ALL SELECT contract_id, 'file_change', trim(n), NULL, p, action FROM fp WHERE trim(n) <> ''
""",
)
def p5_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child with its links: the path of the row it belongs to, its own path, a describing text."""
    return _children(spark, sf_dir)


@R.query(
    "p5_criteria",
    r"""
WITH c0 AS (SELECT contract_id, body FROM contracts QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY sealed_at DESC NULLS LAST, body DESC NULLS LAST) = 1),
c1 AS (SELECT contract_id, CASE WHEN json_type(body) = 'VARCHAR' THEN body ->> '$' ELSE body END AS body FROM c0 WHERE json_valid(body)),
c2 AS (SELECT contract_id, CASE WHEN json_type(body, '$.data') = 'OBJECT' THEN (body -> '$.data')::VARCHAR ELSE body END AS body FROM c1 WHERE json_valid(body)),
c AS (SELECT contract_id, CASE WHEN json_type(body, '$.contract') = 'OBJECT' THEN (body -> '$.contract')::JSON ELSE body::JSON END AS body FROM c2),
a0 AS (SELECT contract_id, unnest(CAST(body -> '$.assertions' AS JSON[])) AS a FROM c WHERE json_type(body, '$.assertions') = 'ARRAY'),
a1 AS (
  SELECT contract_id, a ->> '$.id' AS id, a FROM a0 WHERE json_type(a, '$.assertions') IS NULL
  UNION ALL SELECT contract_id, b ->> '$.id', b FROM (SELECT contract_id, unnest(CAST(a -> '$.assertions' AS JSON[])) AS b FROM a0 WHERE json_type(a, '$.assertions') = 'ARRAY')
  UNION ALL SELECT contract_id, k, v -> k FROM (SELECT contract_id, body -> '$.assertions' AS v, unnest(json_keys(body, '$.assertions')) AS k FROM c WHERE json_type(body, '$.assertions') = 'OBJECT')),
a AS (SELECT contract_id, trim(id) AS id, a ->> '$.says' AS says, a -> '$.ac' AS ac FROM a1 WHERE trim(id) <> ''),
x AS (SELECT contract_id, id, says, unnest(CASE WHEN json_type(ac) = 'ARRAY' THEN CAST(ac AS VARCHAR[]) ELSE [ac ->> '$'] END) AS x FROM a WHERE json_type(ac) IN ('ARRAY', 'VARCHAR'))
SELECT contract_id AS parent_key, id AS assertion, trim(y) AS criterion, says FROM (SELECT contract_id, id, says, unnest(string_split(replace(x, ';', ','), ',')) AS y FROM x) WHERE trim(y) <> ''
""",
)
def p5_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of contract assertions joined to their assertion by the link: what it says stands beside every criterion."""
    c = _children(spark, sf_dir)
    a = c.filter(F.col("child_kind") == "assertion").select("parent_key", F.col("path").alias("parent_path"), F.col("child_key").alias("assertion"), F.col("detail").alias("says"))
    ac = c.filter(F.col("child_kind") == "assertion_ac").select("parent_key", "parent_path", "child_key")
    return ac.join(a, ["parent_key", "parent_path"]).select("parent_key", "assertion", F.expr("substr(child_key, length(assertion) + 2)").alias("criterion"), "says")
