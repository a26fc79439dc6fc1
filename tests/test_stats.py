import math
import statistics

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import rows as O
from tallyforge.operators import stats as S


def test_calibration_gaps(spark):
    rows = [("a", 0.95, True), ("a", 0.895, False), ("a", 0.90, True), ("a", 0.70, False), ("b", 0.695, True), ("c", 1.0, True), ("c", 0.0, False)]
    df = spark.createDataFrame(rows, "g string, c double, ok boolean")
    got = {r.g: r.ece for r in S.calibration_error(df, "g", F.col("c"), F.col("ok")).collect()}
    assert got == {"a": pytest.approx((abs(0.925 - 1) + 0.7) / 2), "c": 0.0}  # 0.895 and 0.695 are in no bucket


def test_cells(spark):
    values = [1.0, 2.0, 4.0, None, float("nan"), float("inf")]
    df = spark.createDataFrame([("x", v) for v in values] + [("y", 3.0)] + [("z", float(i)) for i in range(40)], "k string, v double")
    got = {r.k: r for r in S.cells(df, ["k"], "v").collect()}
    x = got["x"]
    assert (x.n, x.mean) == (3, pytest.approx(7 / 3))
    assert x.sd == pytest.approx(statistics.stdev([1, 2, 4]))
    assert x.ci_high - x.mean == pytest.approx(4.303 * x.sd / math.sqrt(3))
    assert (got["y"].n, got["y"].sd, got["y"].ci_low) == (1, None, None)
    assert got["z"].ci_high - got["z"].mean == pytest.approx(1.959964 * got["z"].sem)


def test_levels(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 5, 10)] + [("b", 3), ("b", 3)], "g string, n int")
    assert sorted((r.g, r.n, r.level) for r in S.levels(df, ["g"], "n").collect()) == [("a", 0, 0), ("a", 5, 4), ("a", 10, 7), ("b", 3, 0), ("b", 3, 0)]


def test_allocation(spark):
    def places(sizes, budget):
        df = spark.createDataFrame([("p", f"g{i}", n) for i, n in enumerate(sizes)], "part string, grp string, n int")
        return [r.places for r in S.allocate(df, budget, ["part"]).orderBy("grp").collect()]

    assert places([60, 30, 10], 10) == [6, 3, 1]
    assert places([70, 29, 1], 10) == [7, 2, 1]
    assert places([3, 2], 10) == [3, 2]
    assert places([5, 1, 1, 1, 1], 3) == [1, 1, 1, 1, 1]  # the floor of one overshoots


def test_water_filling(spark):
    df = spark.createDataFrame([([100, 10, 50],), ([],), ([5],)], "s array<int>")
    assert [r[0] for r in df.select(S.water_fill(F.col("s"), 90)).collect()] == [90, 0, 5]
    assert spark.createDataFrame([([100, 10, 20],)], "s array<int>").select(S.water_fill(F.col("s"), 90)).first()[0] == 90


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_running_total_whatever_the_buckets(spark, bucket):
    df = spark.createDataFrame([(str(i % 3) if i % 3 else None, i, i * i % 11, "clash") for i in range(200)], "g string, i int, v int, out string")
    got = O.running_total(df, ["g"], ["i"], F.floor(F.col("i") / bucket), "v", "sum").orderBy("i").collect()
    sums = {}
    for r in got:
        sums[r.g] = sums.get(r.g, 0) + r.v
        assert r["sum"] == sums[r.g]
    assert len(got) == 200
    assert O.running_total(df.limit(0), ["g"], ["i"], F.col("i"), "v", "sum").count() == 0


def test_running_until(spark):
    df = spark.createDataFrame([("a", 1, 5, False), ("a", 2, 7, True), ("a", 3, 9, False), ("b", 1, 1, False), ("c", 1, 4, True)], "k string, i int, v int, e boolean")
    assert sorted(map(tuple, S.running_until(df, ["k"], ["i"], "v", F.col("e")).collect())) == [("a", 5, 1), ("b", 1, 1)]


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, None, "only"), (None, 1, "null key")], "k int, at int, v string")
    assert sorted(r.v for r in O.latest(df, ["k"], [F.desc_nulls_last("at")]).collect()) == ["new", "null key", "only"]


def test_cell_statistics_keep_long_runs(spark, tmp_path):
    from tallyforge.plans.stats import R

    rows = [(i, None, "p", "k", v, None, None, None) for i, v in enumerate([1.0, 3.0, 5000.0, float("nan"), float("inf"), None])]
    spark.createDataFrame(rows, "timing_id bigint, loaded_at timestamp, project string, kind string, think double, plan double, build double, verify double").write.parquet(f"{tmp_path}/timings.parquet")
    (r,) = R.queries["cell_statistics"](spark, str(tmp_path)).collect()
    assert (r["metric"], r["n"], r["mean"]) == ("think", 3, 1668.0)
