"""The ledger's tables, each row once, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.paths import canonical_path
from tallyforge.operators.rows import latest
from tallyforge.registry import table

_FINDING = ("finding_id", "entry_idx", "f_idx", "project")


def entries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Entries as loaded last; name the columns needed beside project and entry_idx."""
    return latest(table(spark, sf_dir, "entries").select("entry_idx", "project", "ingested_at", *columns), ["entry_idx"], [F.desc_nulls_last("ingested_at")]).drop("ingested_at")


def findings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Findings as loaded last; name the columns needed beside the keys."""
    return latest(table(spark, sf_dir, "findings").select(*_FINDING, "ingested_at", *columns), ["finding_id"], [F.desc_nulls_last("ingested_at")]).drop("ingested_at")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, entry_idx, slug, file): the files of each entry, one spelling each, once."""
    rows = entries(spark, sf_dir, "slug", "modules_touched").select("project", "entry_idx", "slug", F.explode("modules_touched").alias("m"))
    return rows.select("project", "entry_idx", "slug", canonical_path(F.col("m")).alias("file")).filter(F.col("file").isNotNull()).distinct()


#: The path of a module in SQL, from a column ``m``.
CANON = r"nullif(regexp_replace(regexp_replace(regexp_replace(m, '^\s+|\s+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./)+|^\.$', ''), '')"

CTE = rf"""
WITH e AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY entry_idx ORDER BY ingested_at DESC NULLS LAST) = 1),
f AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC NULLS LAST) = 1),
t AS (SELECT DISTINCT project, entry_idx, slug, {CANON} AS file FROM (SELECT project, entry_idx, slug, unnest(modules_touched) AS m FROM e) WHERE {CANON} IS NOT NULL),
a AS (SELECT *, CASE WHEN severity IN ('risk', 'debt', 'observation') THEN severity ELSE 'unclassified' END AS sev,
  CASE WHEN suggested_action IN ('promote', 'scope', 'monitor', 'acknowledge') THEN suggested_action ELSE 'unclassified' END AS act
  FROM f WHERE coalesce(nullif(status, ''), 'active') = 'active'),
chain AS (SELECT project, entry_idx, row_number() OVER (PARTITION BY project ORDER BY entry_idx) AS pos, count(*) OVER (PARTITION BY project) AS runs FROM e)
"""
