"""Readers of files: project trees, ledgers, transcripts, documents with front matter, import graphs.

All fail soft: what cannot be read gives no row or nulls, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.schemas import ENTRY, TRANSCRIPT

#: Directories that hold no sources of the project (fixed values).
IGNORED = ("node_modules", ".git", "dist", "build", "coverage", "vendor", "target", "__pycache__", ".venv")


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """SRC-01: (path, name, size, modified_at, text) of the files below a folder, ignored directories left out.

    File names are filtered before contents are read (``pathGlobFilter``); text
    is read as UTF-8.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    kept = raw.filter(~path.rlike("/(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/"))
    return kept.select(path.alias("path"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.decode("content", "UTF-8").alias("text"))


def directories(files: DataFrame, depth: int = 4) -> DataFrame:
    """SRC-02: the directories above files, down to a depth."""
    parts = F.split(F.regexp_replace("path", "^/+", ""), "/")
    up = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.filter(F.size(parts) > 1).select(F.explode(up).alias("dir"), (F.size(parts) - 1).alias("__d")).select("dir").distinct()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """SRC-24: entries of ledger files ``{"entries": [...]}`` with their place, under one explicit schema.

    Files that are broken or hold no entries give no row.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"struct<entries:array<{ENTRY}>>").alias("j"))
    return files.select("file", F.posexplode("j.entries").alias("entry_idx", "entry")).select("file", "entry_idx", "entry.*")


def entry_findings(entries: DataFrame) -> DataFrame:
    """Findings of ledger entries with their place; entries without any give none."""
    return entries.select("file", "entry_idx", F.posexplode("findings").alias("f_idx", "f")).select("file", "entry_idx", "f_idx", "f.*")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """SRC-27: (file, line_no, fields) of JSON-lines transcripts; bad lines are skipped but counted in ``line_no``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    parsed = files.withColumn("j", F.when(F.try_parse_json("line").isNotNull(), F.from_json("line", TRANSCRIPT)))
    return parsed.filter(F.col("j").isNotNull() & F.trim("line").startswith("{")).select("file", "line_no", "j.*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """SRC-28, FLT-11: (nodes, edges) of a stored import graph; ``None`` where either is missing."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<nodes:array<string>,edges:array<struct<`from`:string,`to`:string,names:array<string>>>>").alias("g"))
    good = raw.filter(F.col("g.nodes").isNotNull() & F.col("g.edges").isNotNull())
    if good.isEmpty():
        return None
    return good.select(F.explode("g.nodes").alias("path")), good.select(F.explode("g.edges").alias("e")).select("e.*")


def front_matter(text: Column) -> Column:
    """SRC-29: struct of ``fields`` (a map), ``body`` and ``malformed`` (a block that is not closed).

    A text without a block has a null map and is its own body.
    """
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    opened = text.rlike(r"\A---[ \t]*\r?\n")
    closed = text.rlike(r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|\z)")
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+[ \t]*:"))
    key = lambda x: F.trim(F.regexp_extract(x, r"^([^:]*):", 1))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"""^["']|["']$""", "")
    fields = F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))))
    body = F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|\z)", "")
    return F.struct(F.when(closed, fields).alias("fields"), F.when(closed, body).otherwise(text).alias("body"), (opened & ~closed).alias("malformed"))


def append_entries(entries: DataFrame, path: str) -> None:
    """SNK-01: entries appended as files of their own; the committer makes each write atomic (SNK-07)."""
    entries.write.mode("append").parquet(path)


def latest_records(records: DataFrame, keys: list[str], at: str) -> DataFrame:
    """SNK-05: one record per key, the one captured last."""
    from tallyforge.operators.rows import latest

    return latest(records, keys, [F.desc_nulls_last(at)])
