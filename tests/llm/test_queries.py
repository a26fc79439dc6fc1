import pytest
from compare import differences

from tallyforge.llm.queries import R


@pytest.mark.parametrize("name", sorted(R.sql))
def test_same_rows(spark, sf, name):
    assert differences(spark, R.queries[name], R.sql[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(R.queries) - set(R.sql)))
def test_runs(spark, sf, name):
    assert R.queries[name](spark, sf).count() > 0


def test_same_draw_in_both_queries(spark, sf):
    shares = {(r["mix"], r["source"]): r["tokens"] for r in R.queries["p7_shares"](spark, sf).collect()}
    drawn = R.queries["p7_drawn"](spark, sf).groupBy("mix", "source").agg({"*": "count"}).count()
    assert drawn == sum(v > 0 for v in shares.values())


def test_every_text_is_packed(spark, sf):
    packs = R.queries["p6_packs"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r["count"] for r in packs.select("packing", "doc_id").distinct().groupBy("packing").count().collect()} == {docs}
