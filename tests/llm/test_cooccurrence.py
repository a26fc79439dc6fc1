import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.cooccurrence import cooccurrence, scored

SCHEMA = "project string, slug string, module string, n int, item_a string"


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    return cooccurrence(df, F.col("project"), F.col("slug"), F.col("module"), **how)


def brute(rows, least=1, most=None):
    baskets = {}
    for p, s, m in rows:
        if s is not None and m is not None:
            baskets.setdefault((p, s), set()).add(m)
    baskets = {k: v for k, v in baskets.items() if most is None or len(v) <= most}
    n, c, both = {}, {}, {}
    for (p, _), items in baskets.items():
        n[p] = n.get(p, 0) + 1
        for i in items:
            c[p, i] = c.get((p, i), 0) + 1
        for a, b in combinations(sorted(items), 2):
            both[p, a, b] = both.get((p, a, b), 0) + 1
    return {(p, a, b, c[p, a], c[p, b], k, n[p]) for (p, a, b), k in both.items() if k >= least}


@pytest.mark.parametrize("how", [{}, {"min_together": 3}, {"min_together": 2, "max_items": 5}])
def test_random_against_brute_force(spark, how):
    rng = random.Random(4)
    rows = [(rng.choice(["p", "q", None]), rng.choice([None, *[f"s{i}" for i in range(25)]]), rng.choice([None, *"abcdefghij"])) for _ in range(900)]
    got = {tuple(r) for r in run(spark, rows, **how).collect()}
    assert got == brute(rows, how.get("min_together", 1), how.get("max_items"))


def test_repeated_baskets_and_rows(spark):
    rows = [("p", f"s{i}", m) for i in range(50) for m in ("a", "b", "b", "c")]
    assert {tuple(r) for r in run(spark, rows).collect()} == brute(rows)


def test_empty_and_single(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [("p", "s", "a"), ("p", "s", "a"), ("p", None, "b"), ("p", "t", None)]).count() == 0


def test_long_basket(spark):
    rows = [("p", "s", f"{i:04}" * 50) for i in range(300)]
    assert run(spark, rows).count() == 300 * 299 // 2
    assert run(spark, rows, max_items=299).count() == 0


def test_scores(spark):
    rows = [("p", "1", "a"), ("p", "1", "b"), ("p", "2", "a"), ("p", "2", "b"), ("p", "3", "b"), ("p", "4", "c")]
    r = scored(run(spark, rows)).first()
    assert (r["lift"], r["conviction"]) == (pytest.approx(2 * 4 / (2 * 3)), None)


@pytest.mark.parametrize("how", [{}, {"min_together": 2}])
def test_baskets_of_several_blocks(spark, how):
    rng = random.Random(5)
    rows = [(p, s, f"m{i}") for p in "pq" for s, size in (("s", 64), ("t", 65), ("u", 200)) for i in rng.sample(range(230), size)]
    assert {tuple(r) for r in run(spark, rows, **how).collect()} == brute(rows, how.get("min_together", 1))


def test_query_has_large_items_and_pairs_seen_once(spark, tmp_path):
    from tallyforge.llm.queries import R

    rows = [("p", "large", [f"a/{i:03}.py" for i in range(100)]), ("p", "small", ["a/000.py", "./b.py"]), ("p", None, ["x.py", "y.py"])]
    spark.createDataFrame(rows, "project string, slug string, modules_touched array<string>").write.parquet(f"{tmp_path}/entries.parquet")
    flat = [(p, s, m.removeprefix("./")) for p, s, ms in rows for m in ms]
    got = R.queries["p4_cooccurrence"](spark, str(tmp_path)).select("project", "file_a", "file_b", "n_a", "n_b", "n_ab", "n")
    assert {tuple(r) for r in got.collect()} == brute(flat)
