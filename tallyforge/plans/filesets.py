"""Queries that read files: each writes a few files to the shared folder, reads them with a source and has the rows that must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.samples import rows_sql
from tallyforge.registry import Registry
from tallyforge.session import checkpoint_dir
from tallyforge.sources import files

R = Registry()


def written(spark: SparkSession, texts: dict[str, str]) -> str:
    """A folder that holds these files, gone when the driver ends."""
    folder = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, text in texts.items():
        out = fs.create(path(f"{folder}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()
    fs.deleteOnExit(path(folder))
    return folder


@R.query("read_files", rows_sql("name, text", "('a.ts', 'let a')", "('deep.ts', 'é')"))
def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: the files of a tree by a name pattern at any depth, ignored folders left out."""
    at = written(spark, {"src/a.ts": "let a", "src/x/y/z/w/deep.ts": "é", "src/b.py": "b", "node_modules/c.ts": "c", "src/dist/d.ts": "d"})
    return files.read_tree(spark, at, "*.ts").select("name", "text")


@R.query("read_ledgers", rows_sql("entry_idx, slug, build, findings", "(0, 'a', NULL, 2)", "(1, 'b', 4, NULL)", "(0, NULL, NULL, NULL)"))
def read_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-24: entries of ledger files with their place; broken and empty files give none."""
    at = written(spark, {"good.json": '{"schema": 1, "entries": [{"slug": "a", "findings": [{"id": "F1"}, {}]}, {"slug": "b", "timing": {"build": 4}}]}', "bad.json": '{"entries": [', "none.json": "{}", "odd.json": '{"entries": [{"slug": null}]}'})
    return files.read_ledger(spark, at).select("entry_idx", "slug", F.col("timing.build").alias("build"), F.when(F.col("findings").isNotNull(), F.size("findings")).alias("findings"))


@R.query("read_transcripts", rows_sql("line_no, type, request, tokens", "(0, 'user', NULL, NULL)", "(3, 'assistant', 'r', 5)"))
def read_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-27: lines of transcripts; broken ones are skipped but keep their number."""
    at = written(spark, {"t.jsonl": '{"type": "user"}\nbroken\n\n{"type": "assistant", "requestId": "r", "message": {"usage": {"input_tokens": 5}}}\n[1]\n'})
    return files.read_transcript(spark, at).select("line_no", "type", F.col("requestId").alias("request"), F.col("message.usage.input_tokens").alias("tokens"))


@R.query("read_graphs", rows_sql("src, dst, nodes", "('a', 'b', 2)", "('b', 'a', 2)"))
def read_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-28, FLT-11: a stored graph; one without nodes or edges is none."""
    bad = written(spark, {"g.json": '{"nodes": ["a"]}'})
    good = written(spark, {"g.json": '{"nodes": ["a", "b"], "edges": [{"from": "a", "to": "b", "names": []}, {"from": "b", "to": "a"}], "more": 1}'})
    graph = files.read_graph(spark, bad) or files.read_graph(spark, good)
    nodes, edges = graph
    n = nodes.agg(F.count("*").cast("int").alias("nodes"))
    return edges.select(F.col("from").alias("src"), F.col("to").alias("dst")).crossJoin(F.broadcast(n))  # one row


@R.query("read_front_matter", rows_sql("name, title, priority, body, malformed", "('a.md', 'A', 'high', 'body', false)", "('b.md', NULL, NULL, 'no block', false)", "('c.md', NULL, NULL, '---' || chr(10) || 'title: x', true)"))
def read_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-29: fields and body of documents; a block that is not closed is malformed and part of the body."""
    at = written(spark, {"a.md": '---\ntitle: "A"\npriority: high\n---\nbody', "b.md": "no block", "c.md": "---\ntitle: x"})
    d = files.read_tree(spark, at, "*.md").select("name", files.front_matter(F.col("text")).alias("m"))
    return d.select("name", F.try_element_at("m.fields", F.lit("title")).alias("title"), F.try_element_at("m.fields", F.lit("priority")).alias("priority"), "m.body", "m.malformed")


@R.query("appended_records", rows_sql("key, captured, value", "('build-1', 2, 'new')", "('plan-1', 1, 'only')", "('verify-2', 3, 'late')"))
def appended_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SNK-05, SNK-07: records appended in three writes, each atomic, read as the last one of each role and session."""
    at = f"{checkpoint_dir(spark)}/appended-{uuid.uuid4().hex}"
    for rows in ([("build", 1, 1, "old"), ("plan", 1, 1, "only")], [("build", 1, 2, "new")], [("verify", 2, 3, "late"), ("build", 1, 0, "older")]):
        files.append_entries(spark.createDataFrame(rows, "role string, session int, captured int, value string"), at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    keyed = spark.read.parquet(at).withColumn("key", F.concat_ws("-", "role", "session"))
    return files.latest_records(keyed, ["key"], "captured").select("key", "captured", "value")
