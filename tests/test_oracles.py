"""Every core query against the same question in SQL on an independent engine, types included."""

import pytest
from compare import differences

from tallyforge.plans import all_registries

QUERIES = {n: (f, r.sql.get(n)) for r in all_registries() for n, f in r.queries.items()}


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_same_rows(spark, sf, name):
    query, sql = QUERIES[name]
    assert differences(spark, query, sql, sf) == ""


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_runs(spark, sf, name):
    assert QUERIES[name][0](spark, sf).count() >= 0


@pytest.mark.parametrize("name", ["hot_modules", "stale_findings", "cochange_partners", "path_matches", "promotion_effect", "near_lines", "surface_by_prefix", "criterion_coverage"])
def test_no_nested_loop(spark, sf, name):
    plan = QUERIES[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan


@pytest.mark.parametrize("name", ["hot_modules", "cochange_partners", "sample_allocation"])
def test_partitions_do_not_matter(spark, sf, name):
    from compare import spark_rows

    many = spark_rows(QUERIES[name][0](spark, sf))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert spark_rows(QUERIES[name][0](spark, sf)) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_columns_are_pruned(spark, sf):
    plan = QUERIES["risk_scores"][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "summary" not in scan.split("ReadSchema")[-1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
