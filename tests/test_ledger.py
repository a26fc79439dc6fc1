"""Gates of the ledger operators, one case below, at and above each constant."""

import pytest

from tallyforge.operators import ledger as L

FINDING = "project string, entry_idx int, f_idx int, id string, category string, summary string, file string, severity string, suggested_action string, status string, resolves array<string>"


def finding(e, i=0, file="a.ts", severity="risk", action=None, status=None, project="p", category="code", id=None, resolves=None):
    return (project, e, i, id or f"F{e}-{i}", category, "s", file, severity, action, status, resolves)


def findings(spark, *rows):
    return spark.createDataFrame(list(rows), FINDING)


def entries(spark, n, project="p", start=0, **more):
    return spark.createDataFrame([(project, start + i) for i in range(n)], "project string, entry_idx int")


def test_hot_modules_gates(spark):
    rows = [finding(1), finding(2), finding(1, 1, "b.ts"), finding(1, 2, "b.ts"), finding(2, 1, "b.ts"), finding(3, 0, "c.ts"), finding(3, 1, "c.ts"), finding(3, 2, "c.ts"), finding(4, 0, None), finding(4, 1, ""), finding(4, 2, "b.ts", status="closed"), finding(5, 0, "b.ts", severity="odd", status="")]
    got = [(r.file, r.findings, r.entries, r.risk, r.unclassified) for r in L.hot_modules(findings(spark, *rows)).collect()]
    assert got == [("b.ts", 4, 3, 3, 1)]


def test_hot_modules_order_and_cap(spark):
    rows = [finding(e, k, f"{name}.ts") for k, name in enumerate("gfedcba") for e in (1, 2, 3)]
    got = [r.file for r in L.hot_modules(findings(spark, *rows)).orderBy("rank").collect()]
    assert got == ["g.ts", "f.ts", "e.ts", "d.ts", "c.ts"]  # equals keep the order of their first finding


@pytest.mark.parametrize(("n", "trend"), [(9, "insufficient_data"), (10, "worsening"), (11, "worsening")])
def test_trend_threshold(spark, n, trend):
    rows = [finding(e, k) for e in range(n) for k in range(1 if e < n // 2 else 3)]
    r = L.trajectory(findings(spark, *rows)).first()
    assert (r.classified, r.trend) == (n, trend)
    assert r.risks_recent == 3.0 or n == 9


def test_trajectory_without_severities(spark):
    r = L.trajectory(findings(spark, finding(1, severity=None), finding(2, severity=""))).first()
    assert (r.trend, r.unclassified, r.classified, r.risks_all) == ("no_classified_data", 2, 0, None)


@pytest.mark.parametrize(("later", "matches", "effect", "pct"), [(4, 0, "tracking", None), (5, 0, "effective", 100), (5, 5, "ineffective", 0), (8, 13, "ineffective", -62)])
def test_promotion_effect(spark, later, matches, effect, pct):
    rows = [finding(0, status="promoted"), finding(0, 5)] + [finding(1 + i % later, 1 + i // later) for i in range(matches)] + [finding(1, 90, file="other.ts"), finding(1, 91, severity=None)]
    r = L.promotion_effect(findings(spark, *rows), entries(spark, later + 1)).first()
    assert (r.later, r.matches, r.effect, r.reduction_pct) == (later, matches, effect, pct)  # -62.5 rounds up


def test_promotion_matches_null_files(spark):
    rows = [finding(0, file=None, status="promoted"), finding(1, file=None), finding(2, file="x")]
    assert L.promotion_effect(findings(spark, *rows), entries(spark, 6)).first().matches == 1


@pytest.mark.parametrize(
    ("n", "touches", "want"),
    [(4, [1], "medium"), (4, [1, 2, 3], "high"), (7, [1], None), (7, [1, 2], "medium"), (7, [1, 2, 3], "high"), (21, list(range(1, 21)), "high"), (41, list(range(1, 31)), "high"), (21, [], None)],
)
def test_staleness(spark, n, touches, want):
    touched = spark.createDataFrame([("p", e, "a.ts") for e in touches] + [("p", 0, "z.ts")], "project string, entry_idx int, file string")
    got = [r.confidence for r in L.staleness(findings(spark, finding(0), finding(0, 1, file=None), finding(0, 2, status="closed")), touched, entries(spark, n)).collect()]
    assert got == ([want] if want else [])


def test_staleness_counts_own_entry_in_rate_only(spark):
    touched = spark.createDataFrame([("p", e, "a.ts") for e in range(20)], "project string, entry_idx int, file string")
    r = L.staleness(findings(spark, finding(10)), touched, entries(spark, 20)).first()
    assert (r.touches, r.later, r.confidence) == (9, 9, "high")


def test_resolution_claims_last_wins(spark):
    rows = [finding(0, id="A"), finding(0, 1, id="B", status="closed"), finding(1, category="upstream", id="U1", resolves=["A", "B", "X", None]), finding(2, category="upstream", id="U2", resolves=["A"]), finding(3, id="U3", resolves=["A"])]
    assert [(r.referenced_id, r.upstream_id) for r in L.resolution_claims(findings(spark, *rows)).collect()] == [("A", "U2")]


def test_recurrence_counts_findings_of_one_entry(spark):
    rows = [finding(0, 0, action="scope", id="A"), finding(0, 1, action="scope", id="B"), finding(0, 2, "x.ts", action="scope"), finding(1, action="promote", id="P", severity=None)]
    got = sorted((r.id, r.severity, r.recurrence) for r in L.promotion_candidates(findings(spark, *rows)).collect())
    assert got == [("B", "risk", 2), ("P", "unclassified", None)]


def test_chain_health_statuses(spark):
    rows = [finding(0, i, status=s) for i, s in enumerate([None, "", "active", "closed", "promoted", "odd"])]
    r = L.chain_health(findings(spark, *rows)).first()
    assert (r.total, r.active, r.closed, r.promoted, r.severity_risk) == (6, 4, 1, 1, 3)


def test_first_pass_rounds_half_up(spark):
    e = spark.createDataFrame([("p", i, 0 if i < 5 else 1, None) for i in range(8)], "project string, entry_idx int, rejection_cycles int, previous_failures array<struct<id:string,summary:string>>")
    assert L.first_pass(e).first().first_pass_pct == 63  # 62.5


def test_lower_and_rounded_medians(spark):
    e = spark.createDataFrame([("p", (v, v, None, v, 0)) for v in (1, 2, 3, 4)], "project string, timing struct<total_minutes:int,think:int,plan:int,build:int,verify:int>")
    assert L.stage_medians(e).first().median_total == 2
    assert L.rounded_medians(e).first().median_total_minutes == 3
    assert L.rounded_medians(e).first().median_verify is None
    assert L.stage_medians(e.limit(2)).count() == 0


def test_positions_do_not_depend_on_row_order(spark, monkeypatch):
    monkeypatch.setattr(L, "CHAIN_BUCKET", 3)
    e = entries(spark, 20).orderBy("entry_idx", ascending=False).unionByName(entries(spark, 3, None, 100))
    got = sorted((str(r.project), r.entry_idx, r.pos, r.runs) for r in L.positions(e).collect())
    assert got == sorted([("p", i, i + 1, 20) for i in range(20)] + [("None", 100 + i, i + 1, 3) for i in range(3)])


def test_empty_ledger(spark):
    f, e = findings(spark), entries(spark, 0)
    t = spark.createDataFrame([], "project string, entry_idx int, file string")
    for df in (L.chain_health(f), L.trajectory(f), L.hot_modules(f), L.promotion_candidates(f), L.promotion_effect(f, e), L.staleness(f, t, e), L.resolution_claims(f), L.audit_by_file(f), L.risk_scores(f), L.severity_rollup(f), L.health_change(f, e)):
        assert df.count() == 0


def test_versions_of_saves(spark):
    from pyspark.sql import functions as F

    from tallyforge.operators.rows import versions

    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x"), ("b", 1, None), ("b", 2, None), ("b", 3, "z")]
    got = versions(spark.createDataFrame(rows, "k string, n int, c string"), ["k"], ["n"], F.col("c")).collect()
    assert sorted((r.k, r.n, r.version) for r in got) == [("a", 1, 1), ("a", 3, 2), ("a", 4, 3), ("b", 1, 1), ("b", 3, 2)]
