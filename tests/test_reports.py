"""Reports, transcripts, diffs and rules where something is missing or odd; the worked-out cases are queries of plans/samples.py."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import joins as J
from tallyforge.operators import reports as P
from tallyforge.operators import sessions as S
from tallyforge.operators.rules import rule_violations


def one(spark, column, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_findings_without_a_section(spark):
    assert one(spark, P.findings, None, "", "## Findings", "## Other\n- **Code:** x\n", "## Findings\nno bold words\n\n") == [None, [], [], [], []]


def test_findings_end_with_their_section(spark):
    text = "## Findings\n- **Code:** a" + " b" * 2000 + "\n## Next\n- **Test:** c"
    (found,) = one(spark, P.findings, text)
    assert [(f.category, len(f.summary)) for f in found] == [("code", 999)]  # cut at 1,000 characters, then trimmed


def test_findings_of_one_category(spark):
    (found,) = one(spark, P.findings, "## Findings\n**Code:**\n- **One:** x.ts:3\n- more\n- **Two** y\n\n- **Three:** z")
    # a single bold word with a colon is a category of its own, bold text without one an item of the category before
    assert [(f.category, f.summary, f.file) for f in found] == [("one", "x.ts:3 more", "x.ts"), ("one", "Two y", None), ("three", "z", None)]


def test_issues_and_tables_that_are_not_there(spark):
    assert one(spark, P.open_issues, None, "x", "## Open Issues\nNone found\n- **a:** b", "## Open Issues\n- plain\n") == [None, [], [], []]
    assert one(spark, P.compliance, "## Contract Compliance\nnothing", "| A1 | b | SATISFIED |", "## Contract Compliance\n| A1 | b |\n| A2 | c | deviated | d |") == [[], [], [("A2", "c", "DEVIATED", "d")]]
    assert one(spark, P.rejections, "## Previous Findings Resolution\nnone", "") == [[], []]
    assert one(spark, P.deviations, "### B1: x\n### A2 no colon", "") == [[], []]
    assert [tuple(x) for x in one(spark, P.verdict, "no headline", "**Result:** fail", "**result:** pass")] == [("UNKNOWN", "UNKNOWN", []), ("FAIL", "FAIL", []), ("PASS", "PASS", [])]


def test_veto_of_nothing(spark):
    d = spark.createDataFrame([(None,), ([],), ([("verify", None)],), ([(None, [("c", None, None)])],)], "r array<struct<role:string,verdicts:array<struct<claim_id:string,status:string,source:string>>>>")
    assert [r[0] for r in d.select(P.vetoed(F.col("r"), "c")).collect()] == [False] * 4


def test_rules_that_cannot_be_planned_are_skipped(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, x string")
    rules = {"null": lambda c: c["x"].isNull(), "broken": lambda c: c["nothing"] > 1, "unknown": lambda c: c["x"] == "zz"}
    assert sorted((r.k or 0, r.violation) for r in rule_violations(d, "k", rules).collect()) == [(0, "skipped: broken"), (2, "null")]
    assert rule_violations(d, "k", {}).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["f", "g", None]), " ".join(rng.choices(["a", "b", "c", "d", "e", "f", "g", "h", "Hot"], weights=[1] * 8 + [9], k=rng.randint(0, 7)))) for i in range(90)]
    words = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, _, t in rows}
    want = sorted((a, b) for a, fa, _ in rows for b, fb, _ in rows if a < b and fa == fb and words[a] and words[b] and len(words[a] & words[b]) > 0.5 * min(len(words[a]), len(words[b])))
    got = J.overlapping(spark.createDataFrame(rows, "id int, file string, t string"), ["file"], "id", F.col("t"))
    assert sorted(map(tuple, got.collect())) == want


def test_churn_and_tables_of_nothing(spark):
    d = spark.createDataFrame([("a", None), ("b", ""), ("c", "x\ty\tz\n1\t2\t\n\t\t")], "item string, text string")
    assert [tuple(r) for r in S.churn(d).collect()] == [("c", "z", 0, 0)]
    f = spark.createDataFrame([("p", "a.sql", None), ("p", "b.sql", "create table a.b.c (x int)")], "project string, path string, text string")
    assert [tuple(r) for r in S.surviving_tables(f).collect()] == [("p", "b")]  # one schema before the name at most
    assert S.best_schema(f).count() == 0


def test_sessions_without_reads_or_edits(spark):
    lines = spark.createDataFrame([("s", 0, "user", None, None, None, None, None)], "session string, line_no int, type string, request string, at timestamp, input_tokens int, output_tokens int, uses array<struct<name:string,file:string>>")
    (r,) = S.localisation(lines, spark.createDataFrame([], "session string, file string")).collect()
    assert (r.turns, r.reads, r.redundant_ratio, r.tokens_to_edit, r.ms_to_edit) == (0, 0, 0.0, None, None)
