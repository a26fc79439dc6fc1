"""Queries that read texts: names, documents, reports, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.functions.numeric import gcd, half_up
from tallyforge.operators import nested, scan
from tallyforge.operators.rows import latest
from tallyforge.operators.rules import rule_violations
from tallyforge.plans.rules import documents
from tallyforge.plans.views import CTE, entries, findings, modules
from tallyforge.registry import Registry, table

R = Registry()

_STYLE = r"""(SELECT CASE WHEN length(s.v) <= 1 OR NOT regexp_full_match(s.w, '[A-Za-z][A-Za-z0-9]*((_[A-Za-z0-9]+)*|(-[A-Za-z0-9]+)*)') THEN 'unknown'
 WHEN s.w = upper(s.w) AND NOT contains(s.w, '-') THEN 'SCREAMING_SNAKE_CASE'
 WHEN NOT regexp_matches(s.w, '[_-]') THEN CASE WHEN regexp_matches(s.w, '^[A-Z]') THEN 'PascalCase' WHEN s.w = lower(s.w) THEN 'lowercase' ELSE 'camelCase' END
 WHEN s.w = lower(s.w) THEN CASE WHEN contains(s.w, '-') THEN 'kebab-case' ELSE 'snake_case' END ELSE 'unknown' END FROM (SELECT {0} AS v, trim({0}, '_') AS w) s)"""


_VOTED = "[" + ", ".join(f"'{v}'" for v in X.VOTED) + "]"


@R.query(
    "naming_vote",
    CTE
    + f""", s AS (SELECT project, CASE WHEN anchor NOT IN ('constructor', 'toString', 'valueOf', 'hasOwnProperty', 'toJSON') THEN {_STYLE.format("anchor")} END AS style, count(*) AS n FROM f WHERE anchor IS NOT NULL GROUP BY ALL),
v AS (SELECT project, sum(n) AS total, sum(n) FILTER (list_contains({_VOTED}, style)) AS valid, max(n) FILTER (list_contains({_VOTED}, style)) AS top, arg_max(style, (n, -list_position({_VOTED}, style))) FILTER (list_contains({_VOTED}, style)) AS majority FROM s GROUP BY project)
SELECT project, CAST(total AS BIGINT) AS sample_size, majority, floor(top / valid * 1e4 + 0.5) / 1e4 AS share, coalesce(floor(top / valid * valid / (valid + 5) * 1e4 + 0.5) / 1e4, 0) AS confidence, coalesce(top / valid < 0.7, true) AS mixed FROM v
""",
)
def naming_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, FN-S01, FLT-10: majority naming style of the names that a project's findings point at; the sample counts all names, the confidence shrinks by 5."""
    names = findings(spark, sf_dir, "anchor").filter(F.col("anchor").isNotNull()).select("project", F.lit(None).cast("string").alias("language"), F.col("anchor").alias("name"))
    return scan.naming_votes(names, ["project"]).withColumnRenamed("sample", "sample_size")


@R.query(
    "file_naming_vote",
    CTE
    + f""", s AS (SELECT project, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\..*$', '') AS n FROM (SELECT DISTINCT project, file FROM t)), q AS (SELECT project, {_STYLE.format("n")} AS style FROM s)
SELECT project, style, count(*) AS files, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY project) >= 0.3 AS dominant FROM q GROUP BY project, style
""",
)
def file_naming_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, AGG-24: styles of file names; a style with three tenths of a project's files is dominant."""
    n = modules(spark, sf_dir).select("project", "file").distinct().select("project", X.naming_style(F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"\..*$", "")).alias("style"))
    s = n.groupBy("project", "style").agg(F.count("*").alias("files"))
    return s.withColumn("dominant", F.col("files") / F.sum("files").over(Window.partitionBy("project")) >= 0.3)


@R.query(
    "indentation_vote",
    r"""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents WHERE source IS NOT NULL),
i AS (SELECT source, regexp_extract(l, '^([ \t]+)[^ \t\n]', 1) AS w FROM l), w AS (SELECT source, length(w) AS n, contains(w, chr(9)) AS tab FROM i WHERE w <> ''),
g AS (SELECT source, count(*) AS indented, count(*) FILTER (tab) AS tabs, list_reduce(list(DISTINCT n) FILTER (NOT tab), lambda x, y: gcd(x, y)) AS g FROM w GROUP BY source),
s AS (SELECT *, CASE WHEN tabs::DOUBLE / indented >= 0.7 THEN 'tabs' WHEN (indented - tabs)::DOUBLE / indented >= 0.7 THEN 'spaces' ELSE 'mixed' END AS style FROM g)
SELECT source, indented, tabs, style, floor(greatest(tabs, indented - tabs)::DOUBLE / indented * 1e4 + 0.5) / 1e4 AS confidence, CASE WHEN style = 'spaces' THEN CASE WHEN g IN (2, 4, 8) THEN g WHEN g = 1 THEN 2 ELSE 4 END END AS width FROM s
""",
)
def indentation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22, FN-M01: tabs or spaces from seven tenths of the indented lines on, and the greatest common divisor of the widths.

    Widths other than 2, 4 and 8 count as 4, single blanks as 2. Only the
    different widths of a source are collected, not its lines.
    """
    lines = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull()).select("source", F.explode(F.split("text", "\n")).alias("l"))
    w = lines.select("source", F.regexp_extract("l", "^([ \\t]+)[^ \\t\\n]", 1).alias("w")).filter(F.col("w") != "").select("source", F.length("w").alias("n"), F.col("w").contains("\t").alias("tab"))
    g = w.groupBy("source").agg(F.count("*").alias("indented"), F.count_if("tab").alias("tabs"), F.collect_set(F.when(~F.col("tab"), F.col("n"))).alias("widths"))
    step = F.aggregate("widths", F.lit(0), gcd)
    spaces = F.col("indented") - F.col("tabs")
    style = F.when(F.col("tabs") / F.col("indented") >= 0.7, "tabs").when(spaces / F.col("indented") >= 0.7, "spaces").otherwise("mixed")
    g = g.select("source", "indented", "tabs", style.alias("style"), half_up(F.greatest("tabs", spaces) / F.col("indented"), 4).alias("confidence"), step.alias("g"))
    width = F.when(F.col("g").isin(2, 4, 8), F.col("g")).when(F.col("g") == 1, 2).otherwise(4)
    return g.select("source", "indented", "tabs", "style", "confidence", F.when(F.col("style") == "spaces", width).cast("bigint").alias("width"))


@R.query(
    "truncated_summaries",
    CTE + r"""SELECT finding_id, CASE WHEN length(summary) <= 60 THEN summary ELSE coalesce(nullif(regexp_extract(substr(summary, 1, 61), '(?s)^(.+) ', 1), ''), substr(summary, 1, 60)) || '...' END AS short FROM f WHERE summary IS NOT NULL""",
)
def truncated_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S04."""
    return findings(spark, sf_dir, "summary").filter(F.col("summary").isNotNull()).select("finding_id", X.truncate_words(F.col("summary"), 60).alias("short"))


@R.query(
    "file_references",
    r"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '((?:[\w./-]+/)?[\w.-]+\.(?:tsx|ts|jsx|json|js|yaml|yml|md))', 1)) AS file FROM documents WHERE text IS NOT NULL)
SELECT file, count(DISTINCT doc_id) AS docs FROM r WHERE NOT starts_with(file, '//') GROUP BY file
""",
)
def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S05: files that texts refer to, and in how many."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select(F.explode(X.file_references(F.col("text"))).alias("file")).groupBy("file").agg(F.count("*").alias("docs"))


@R.query(
    "sections",
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, l, sum(CASE WHEN starts_with(l, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l)
SELECT doc_id, CAST(sec AS BIGINT) AS section, count(*) AS lines, count(*) FILTER (trim(l) <> '') AS filled, count(*) FILTER (regexp_matches(l, '^\s*[-*] ')) AS items FROM s GROUP BY doc_id, sec
""",
)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-56, FN-S06: the sections of every text, told apart by splitting before headings.

    A text's lines never leave their row, so no window or shuffle orders them.
    """
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    at = d.select("doc_id", F.posexplode(F.split(F.concat(F.lit("\n"), F.col("text")), "\n(?=#)")).alias("section", "body"))
    # what stands before the first heading is section 0; it has a line only if the text does not begin with a heading
    body = at.select("doc_id", F.col("section").cast("bigint").alias("section"), F.split(F.when(F.col("section") == 0, F.regexp_replace("body", "^\n", "")).otherwise(F.col("body")), "\n").alias("l"), "body")
    body = body.filter((F.col("section") > 0) | (F.col("body") != ""))
    return body.select("doc_id", "section", F.size("l").cast("bigint").alias("lines"), F.size(F.filter("l", lambda x: F.trim(x) != "")).cast("bigint").alias("filled"), F.size(F.filter("l", lambda x: x.rlike(r"^\s*[-*] "))).cast("bigint").alias("items"))


@R.query(
    "compliance_rows",
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, trim(regexp_extract(l, '^\s*\|([^|]*)\|([^|]*)\|([^|]*)\|\s*$', 1)) AS id, trim(regexp_extract(l, '^\s*\|([^|]*)\|([^|]*)\|([^|]*)\|\s*$', 3)) AS status FROM l WHERE regexp_matches(l, '^\s*\|([^|]*)\|([^|]*)\|([^|]*)\|\s*$') AND NOT contains(l, 'Says') AND NOT contains(l, 'Status'))
SELECT status, count(*) AS n, count(DISTINCT doc_id) AS docs, count(DISTINCT id) AS ids FROM c WHERE regexp_matches(id, '^A') GROUP BY status
""",
)
def compliance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S08: rows of compliance tables in reports; rows that hold the words Says or Status are headings."""
    pattern = r"^\s*\|([^|]*)\|([^|]*)\|([^|]*)\|\s*$"
    lines = table(spark, sf_dir, "documents").filter(F.col("text").contains("|")).select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    rows = lines.filter(F.col("l").rlike(pattern) & ~F.col("l").contains("Says") & ~F.col("l").contains("Status")).select("doc_id", F.trim(F.regexp_extract("l", pattern, 1)).alias("id"), F.trim(F.regexp_extract("l", pattern, 3)).alias("status"))
    return rows.filter(F.col("id").startswith("A")).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("id").alias("ids"))


@R.query(
    "verdicts",
    CTE
    + """
SELECT entry_idx, CASE WHEN result = 'PASS' AND len(list_filter(coalesce(assertions, []), lambda x: x.status = 'UNSATISFIED')) > 0 THEN 'FAIL' ELSE result END AS verdict,
  CAST(len(list_filter(coalesce(assertions, []), lambda x: x.status = 'SATISFIED')) AS BIGINT) AS satisfied, CAST(len(list_filter(coalesce(assertions, []), lambda x: x.status = 'UNSATISFIED')) AS BIGINT) AS unsatisfied,
  CASE WHEN result = 'PASS' THEN array_to_string(list_sort(list_filter(list_transform(coalesce(assertions, []), lambda x: CASE WHEN x.status = 'UNSATISFIED' THEN x.id END), lambda i: i IS NOT NULL)), ',') ELSE '' END AS contradicted FROM e
""",
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S09, AGG-41, FN-A01: a PASS with an unsatisfied assertion is a FAIL, and these assertions contradict it."""
    e = entries(spark, sf_dir, "result", "assertions")
    listed = F.coalesce("assertions", F.expr("cast(array() as array<struct<id:string,says:string,status:string,deviation:string>>)"))
    n = lambda s: F.size(F.filter(listed, lambda x: x.status == s)).cast("bigint")
    against = F.array_sort(F.array_compact(F.transform(F.filter(listed, lambda x: x.status == "UNSATISFIED"), lambda x: x.id)))
    passed = F.col("result") == "PASS"
    return e.select("entry_idx", F.when(passed & (n("UNSATISFIED") > 0), "FAIL").otherwise(F.col("result")).alias("verdict"), n("SATISFIED").alias("satisfied"), n("UNSATISFIED").alias("unsatisfied"), F.when(passed, F.array_join(against, ",")).otherwise("").alias("contradicted"))


_KNOWN = ("session_log", "build_report", "verify_report", "commit_note", "scope", "plan", "docs_page", "changelog", "requirement", "retro")


@R.query(
    "nearest_source",
    f"""
WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), k(name) AS (VALUES {", ".join(f"('{k}')" for k in _KNOWN)}),
x AS (SELECT source, name, levenshtein(lower(source), name) AS d FROM s, k)
SELECT source, arg_min(name, (d, name)) AS nearest, min(d) AS distance FROM x WHERE d <= greatest(2, floor(length(source) / 3)) GROUP BY source
""",
)
def nearest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S13: distinct spellings against a fixed list of names, the nearest within max(2, a third of the length)."""
    s = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull()).select("source").distinct()
    x = s.withColumn("name", F.explode(F.array(*[F.lit(k) for k in _KNOWN]))).withColumn("d", F.levenshtein(F.lower("source"), "name"))
    x = x.filter(F.col("d") <= F.greatest(F.lit(2), F.floor(F.length("source") / 3)))
    return x.groupBy("source").agg(F.min_by("name", F.struct("d", "name")).alias("nearest"), F.min("d").cast("bigint").alias("distance"))


@R.query(
    "plain_text",
    r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain
FROM documents WHERE text IS NOT NULL
""",
)
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S14: texts without images and tags."""
    return table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", X.clean_markdown(F.col("text")).alias("plain"))


_KIND_SQL = r"regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[ _-]+', '_', 'g')"


@R.query(
    "first_paragraphs",
    rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND {_KIND_SQL} = 'docs_page'),
f AS (SELECT *, min(i) FILTER (trim(l) <> '') OVER (PARTITION BY doc_id) AS first FROM l),
b AS (SELECT *, min(i) FILTER (trim(l) <> '' AND NOT (i = first AND regexp_matches(l, '^# ?'))) OVER (PARTITION BY doc_id) AS start FROM f),
e AS (SELECT *, coalesce(min(i) FILTER (i >= start AND (trim(l) = '' OR regexp_matches(l, '^##?\s'))) OVER (PARTITION BY doc_id), 1e9::BIGINT) AS stop FROM b)
SELECT doc_id, regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (i >= start AND i < stop), ''), '^\s+|\s+$', '', 'g') AS paragraph FROM e GROUP BY doc_id
""",
)
def first_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S14: the opening paragraph of documentation pages."""
    d = documents(spark, sf_dir, "text").filter(F.col("text").isNotNull() & (F.col("kind") == "docs_page"))
    return d.select("doc_id", X.first_paragraph(F.col("text")).alias("paragraph"))


@R.query(
    "commit_styles",
    r"""
WITH c AS (SELECT project, regexp_extract(text, '^([a-z]+)(\([^)]*\))?: ', 1) AS kind FROM documents WHERE regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[ _-]+', '_', 'g') = 'commit_note' AND text IS NOT NULL),
k AS (SELECT project, kind, count(*) AS n FROM c GROUP BY ALL)
SELECT project, CAST(sum(n) AS BIGINT) AS notes, floor(sum(n) FILTER (kind <> '') / sum(n) * 1e4 + 0.5) / 1e4 AS conventional, arg_max(kind, (n, kind)) FILTER (kind <> '') AS commonest FROM k GROUP BY project HAVING sum(n) FILTER (kind <> '') > 0
""",
)
def commit_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-32: share of notes in the conventional form, and their commonest kind."""
    c = documents(spark, sf_dir, "text").filter((F.col("kind") == "commit_note") & F.col("text").isNotNull()).select("project", F.regexp_extract("text", r"^([a-z]+)(\([^)]*\))?: ", 1).alias("kind"))
    k = c.groupBy("project", "kind").agg(F.count("*").alias("n"))
    ok = F.col("kind") != ""
    g = k.groupBy("project").agg(F.sum("n").alias("notes"), F.sum(F.when(ok, F.col("n"))).alias("good"), F.max_by(F.when(ok, F.col("kind")), F.when(ok, F.struct("n", "kind"))).alias("commonest"))
    return g.filter(F.col("good") > 0).select("project", "notes", half_up(F.col("good") / F.col("notes"), 4).alias("conventional"), "commonest")


_AC_SQL = " || ".join("regexp_extract_all(text, '" + f + "', 1)" for f in X.CRITERION_FORMS)


@R.query(
    "criterion_mentions",
    f"""
WITH m AS (SELECT doc_id, upper(unnest({_AC_SQL})) AS ac FROM documents WHERE text IS NOT NULL)
SELECT ac, count(DISTINCT doc_id) AS docs FROM m GROUP BY ac
""",
)
def criterion_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S16: criteria that texts declare, and how many texts do."""
    return table(spark, sf_dir, "documents").select(F.explode(X.criterion_ids(F.col("text"))).alias("ac")).groupBy("ac").agg(F.count("*").alias("docs"))


@R.query(
    "unclear_criteria",
    f"SELECT doc_id, len({_AC_SQL}) = 0 AND regexp_matches(text, '{X.CRITERION_SIGNS}') AS unclear FROM documents WHERE text IS NOT NULL",
)
def unclear_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S16: texts that mention criteria in a form that declares none."""
    return table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", X.criteria_unclear(F.col("text")).alias("unclear"))


_BODIES = """
WITH c0 AS (SELECT contract_id, body FROM contracts QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY sealed_at DESC NULLS LAST, body DESC NULLS LAST) = 1),
c0v AS MATERIALIZED (SELECT contract_id, body FROM c0 WHERE json_valid(body)),
c1 AS (SELECT contract_id, body AS raw, CASE WHEN json_type(body) = 'VARCHAR' THEN body ->> '$' ELSE body END AS body FROM c0v),
c2 AS (SELECT contract_id, raw, CASE WHEN json_type(body, '$.data') = 'OBJECT' THEN (body -> '$.data')::VARCHAR ELSE body END AS body FROM c1 WHERE json_valid(body)),
c AS (SELECT contract_id, CASE WHEN json_type(body, '$.contract') = 'OBJECT' THEN (body -> '$.contract')::JSON ELSE body::JSON END AS body FROM c2 WHERE json_type(body) = 'OBJECT')
"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = latest(table(spark, sf_dir, "contracts").select("contract_id", "sealed_at", "body"), ["contract_id"], [F.desc_nulls_last("sealed_at"), F.desc_nulls_last("body")])
    return nested.contract_fields(c)


@R.query(
    "version_gate",
    _BODIES
    + r""", v AS (SELECT contract_id, body ->> '$.version' AS v FROM c),
n AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(v, '^v?([0-9]+)', 1), '') AS INTEGER), 0) AS a, coalesce(try_cast(nullif(regexp_extract(v, '^v?[0-9]*\.([0-9]+)', 1), '') AS INTEGER), 0) AS b FROM v)
SELECT v AS version, CASE WHEN v IS NULL OR trim(v) = '' THEN false ELSE a > 1 OR (a = 1 AND b >= 1) END AS gated, count(*) AS contracts FROM n GROUP BY 1, 2
""",
)
def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S17, FN-J01: versions from 1.1 on, compared as numbers, of contracts in every form of body."""
    v = _fields(spark, sf_dir).filter("valid")
    return v.groupBy("version", X.version_at_least(F.col("version"), 1, 1).alias("gated")).agg(F.count("*").alias("contracts"))


@R.query(
    "sealed_hashes",
    CTE
    + """, h AS (SELECT project, unnest(map_keys(hashes)) AS name, unnest(map_values(hashes)) AS hash, entry_idx FROM e),
l AS (SELECT project, name, arg_max(hash, entry_idx) AS last, arg_min(hash, entry_idx) AS first FROM h GROUP BY ALL)
SELECT project, name, last, CASE WHEN nullif(first, '') IS NULL THEN 'UNVERIFIABLE' WHEN first = last THEN 'INTACT' ELSE 'TAMPERED' END AS state, sha256(coalesce(name, '') || chr(31) || coalesce(last, '')) AS seal FROM l
""",
)
def sealed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S18, FN-S19, FN-P01, AGG-54: maps merged over a project's chain, the last entry wins, and each value's seal."""
    h = entries(spark, sf_dir, "hashes").select("project", "entry_idx", F.explode("hashes").alias("name", "hash"))
    last = h.groupBy("project", "name").agg(F.max_by("hash", "entry_idx").alias("last"), F.min_by("hash", "entry_idx").alias("first"))
    return last.select("project", "name", "last", X.seal_state(F.col("last"), F.col("first")).alias("state"), X.seal(F.col("name"), F.col("last")).alias("seal"))


@R.query(
    "ages",
    CTE
    + """, d AS (SELECT entry_idx, completed_at, try_cast(substr(completed_at, 1, 10) AS DATE) AS day FROM e), g AS (SELECT *, date_diff('second', day::TIMESTAMP, TIMESTAMP '2025-06-01 12:00:00') AS s FROM d)
SELECT entry_idx, day, CAST(floor(s / 86400) AS BIGINT) AS days, CASE WHEN s < 3600 THEN '<1h' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h' WHEN s < 30 * 86400 THEN CAST(floor(s / 86400) AS BIGINT) || 'd' ELSE CAST(floor(floor(s / 86400) / 7) AS BIGINT) || 'w' END AS age FROM g WHERE s IS NOT NULL
""",
)
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-D01 to FN-D04: uneven date texts read as far as they can be, and their age at a fixed moment."""
    d = entries(spark, sf_dir, "completed_at").withColumn("day", F.expr("try_cast(substr(completed_at, 1, 10) AS date)"))
    s = F.unix_timestamp(F.lit("2025-06-01 12:00:00").cast("timestamp")) - F.unix_timestamp(F.col("day").cast("timestamp"))
    return d.filter(F.col("day").isNotNull()).select("entry_idx", "day", F.floor(s / 86_400).alias("days"), X.relative_age(s).alias("age"))


@R.query(
    "document_lint",
    r"""
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(len(regexp_extract_all(text, '(?m)^#+ ')) AS BIGINT) AS headings,
  CAST(len(regexp_extract_all(text, '(?i)\b(todo|tbd|fixme)\b')) AS BIGINT) AS placeholders, CAST(len(regexp_extract_all(text, '(?m)^## ')) AS BIGINT) AS phases, len(text) < 20 AS tiny FROM documents WHERE text IS NOT NULL
""",
)
def document_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S25, FN-S27: lines, headings, placeholders and phases of every text."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("lines"), n("(?m)^#+ ").alias("headings"), n(r"(?i)\b(todo|tbd|fixme)\b").alias("placeholders"), n("(?m)^## ").alias("phases"), (F.length("text") < 20).alias("tiny"))


@R.query(
    "slug_checks",
    CTE + "SELECT project, count(*) AS slugs, count(*) FILTER (regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*') AND length(slug) <= 64) AS valid FROM e WHERE slug IS NOT NULL GROUP BY project",
)
def slug_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S23."""
    return entries(spark, sf_dir, "slug").filter(F.col("slug").isNotNull()).groupBy("project").agg(F.count("*").alias("slugs"), F.count_if(X.valid_slug(F.col("slug"))).alias("valid"))


@R.query(
    "contract_violations",
    _BODIES
    + r"""
SELECT contract_id, 'missing' AS violation FROM c0 WHERE body IS NULL
UNION ALL SELECT contract_id, 'broken' FROM c0 WHERE body IS NOT NULL AND contract_id NOT IN (SELECT contract_id FROM c)
UNION ALL SELECT contract_id, 'no version' FROM c WHERE coalesce(json_type(body, '$.version'), 'NULL') = 'NULL'
UNION ALL SELECT contract_id, 'unsealed' FROM c WHERE coalesce(trim(body ->> '$.sealed_by'), '') = ''
UNION ALL SELECT contract_id, 'no assertions' FROM c WHERE coalesce(json_type(body, '$.assertions'), 'NULL') NOT IN ('ARRAY', 'OBJECT') OR json_array_length(CASE WHEN json_type(body, '$.assertions') = 'ARRAY' THEN body -> '$.assertions' ELSE '[0]'::JSON END) = 0
UNION ALL SELECT contract_id, 'no file changes' FROM c WHERE coalesce(json_type(body, '$.file_changes'), 'NULL') NOT IN ('ARRAY', 'OBJECT')
""",
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S24, UDX-01: a registry of rules over the fields of every form of body; a rule that fails is skipped, with a row that says so."""
    rules = {
        "missing": lambda c: c["missing"],
        "broken": lambda c: ~c["missing"] & ~c["valid"],
        "no version": lambda c: c["valid"] & c["version"].isNull(),
        "unsealed": lambda c: c["valid"] & (F.coalesce(F.trim(c["sealed_by"]), F.lit("")) == ""),
        "no assertions": lambda c: c["valid"] & (F.coalesce(c["assertions"], F.lit(0)) == 0),
        "no file changes": lambda c: c["valid"] & c["file_changes"].isNull(),
    }
    return rule_violations(_fields(spark, sf_dir), "contract_id", rules)


@R.query(
    "hygiene",
    r"""
SELECT raw_id AS id, 'conflict marker' AS rule FROM raw_records WHERE regexp_matches(body, '(?m)^(<<<<<<<|>>>>>>>|=======)')
UNION ALL SELECT doc_id, 'environment file' FROM documents WHERE regexp_matches(text, '(^|[ /])\.env\b')
UNION ALL SELECT doc_id, 'key material' FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----')
UNION ALL SELECT doc_id, 'oversized' FROM documents WHERE n_chars > 40000
""",
)
def hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-47: a union of rule queries over records and texts; the patterns for keys are this project's own."""
    raw, d = table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "documents")
    rule = lambda df, key, cond, name: df.filter(cond).select(F.col(key).alias("id"), F.lit(name).alias("rule"))
    return (
        rule(raw, "raw_id", F.col("body").rlike("(?m)^(<<<<<<<|>>>>>>>|=======)"), "conflict marker")
        .unionAll(rule(d, "doc_id", F.col("text").rlike(r"(^|[ /])\.env\b"), "environment file"))
        .unionAll(rule(d, "doc_id", F.col("text").rlike("AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----"), "key material"))
        .unionAll(rule(d, "doc_id", F.col("n_chars") > 40_000, "oversized"))
    )


@R.query(
    "source_variants",
    """
WITH s AS (SELECT source, regexp_replace(lower(trim(source)), '[ _-]+', '_', 'g') AS base, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN count(*) > 1 THEN base || ' (' || count(*) || ' spellings)' ELSE base END AS name, CAST(sum(n) AS BIGINT) AS docs FROM s GROUP BY base
""",
)
def source_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-51: variants collapsed under their base, with their number."""
    s = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull()).groupBy("source", F.regexp_replace(F.lower(F.trim("source")), "[ _-]+", "_").alias("base")).agg(F.count("*").alias("n"))
    g = s.groupBy("base").agg(F.count("*").alias("k"), F.sum("n").alias("docs"))
    return g.select(F.when(F.col("k") > 1, F.format_string("%s (%d spellings)", "base", "k")).otherwise(F.col("base")).alias("name"), "docs")


@R.query(
    "stems",
    CTE
    + r""", n AS (SELECT DISTINCT file, string_split(file, '/') AS d, string_split(regexp_extract(file, '([^/]*)$', 1), '.') AS b FROM t),
m AS (SELECT file, list_filter(d[:-2], lambda x: lower(x) NOT IN ('src', 'test', 'tests', '__tests__')) AS d, CASE WHEN len(b) > 2 AND lower(b[-2]) IN ('test', 'spec') THEN b[:-3] || b[-1:] ELSE b END AS b FROM n)
SELECT file, array_to_string(d || [array_to_string(b, '.')], '/') AS mirrored, regexp_matches(file, '(?i)[._-](test|spec)\.[a-z0-9]+$') OR regexp_matches(file, '(?i)(^|/)(tests?|__tests__|spec)/') OR regexp_matches(file, '(^|/)test_[^/]*\.py$') AS is_test FROM m
""",
)
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S03, FLT-04: a file and its test have one mirrored path."""
    from tallyforge.functions.paths import is_test_path
    from tallyforge.operators.joins import mirrored

    return modules(spark, sf_dir).select("file", mirrored(F.col("file")).alias("mirrored"), is_test_path(F.col("file")).alias("is_test")).distinct()
