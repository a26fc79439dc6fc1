import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import quantile as Q

SCHEMA = "grp string, day int, v double, name string, n int, codes string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=40))
def test_codes_keep_order(values):
    x = np.sort(np.array(values))
    c = Q.encode(x)
    assert (np.diff(c) >= 0).all()
    assert ((c >= 0) & (c < 1 << Q.BITS)).all()
    inside = np.isfinite(x) & (np.abs(x) >= 2.0**-1022)
    d = Q.decode(c)
    assert (d[np.isinf(x)] == x[np.isinf(x)]).all()
    assert (np.abs(d[inside] - x[inside]) <= np.abs(x[inside]) * 2.0**-Q.FRACTION).all()
    assert (d[x == 0] == 0).all()


@pytest.mark.parametrize("make", ["uniform", "heavy", "ties", "few"])
def test_rank_error_is_as_stated(make):
    rng = np.random.default_rng(7)
    x = {"uniform": rng.uniform(0, 100, 60_000), "heavy": rng.pareto(0.7, 60_000) * 10, "ties": rng.integers(0, 30, 60_000) * 5.0, "few": rng.normal(0, 50, 9)}[make]
    q = np.linspace(0, 1, 21)
    code, weight = np.unique(Q.encode(x), return_counts=True)
    state = Q.build(np.zeros(len(code), np.int64), code, weight, 1)
    n, values, error = Q.answer(state, q)
    assert n[0] == len(x)
    xs = np.sort(x)
    for p, v in zip(q, values[0], strict=True):
        low = np.searchsorted(xs, v - abs(v) * 2.0**-10, side="left") / len(x)
        high = np.searchsorted(xs, v + abs(v) * 2.0**-10 + 1e-12, side="right") / len(x)
        assert low - error[0] <= max(p, 1 / len(x)) <= high + error[0] + 1 / len(x)
    assert error[0] < 0.04 or make == "few"


@pytest.mark.parametrize("codes", [0, 3, 5000])
def test_stored_round_trip(codes, monkeypatch):
    rng = np.random.default_rng(1)
    code, weight = np.sort(rng.choice(1 << Q.BITS, codes, replace=False)), rng.integers(-5, 6, codes)
    one = Q.Parts()
    one.add(0, *Q._codes(code, weight))
    n, (data,) = one.stored(1)
    again = Q.Parts()
    again.add(0, Q.STORED, data)
    a, b = one.total(1), again.total(1)
    assert n[0] == weight.sum()
    assert (a.cell.tolist(), a.count.tolist(), a.sketch.tolist()) == (b.cell.tolist(), b.count.tolist(), b.sketch.tolist())
    again.add(0, Q.TAKEN, data)
    assert not again.total(1).sketch.any() and not len(again.total(1).cell)


def test_parts_add_up_in_any_order(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.choice(["a", "b", None]), int(d), float(v)) for d, v in zip(rng.integers(0, 5, 4000), rng.exponential(30, 4000), strict=True)]
    df = table(spark, rows)
    q = (0.01, 0.5, 0.9)
    key = lambda r: (str(r["grp"]), r["quantile"])
    whole = sorted(Q.percentiles(df, ["grp"], {"v": F.col("v")}, q).collect(), key=key)
    days = Q.sketches(df, ["grp", "day"], {"v": F.col("v")})
    merged = sorted(Q.ask(Q.merge(days, ["grp", "name"]), ["grp", "name"], q).collect(), key=key)
    assert [tuple(r) for r in whole] == [tuple(r) for r in merged]
    assert {r["grp"] for r in whole} == {"a", "b", None}
    # taking days out again leaves what was never put in
    out = days.withColumn("sign", F.lit(1)).unionByName(days.filter("day >= 2").withColumn("sign", F.lit(-1)))
    left = sorted(Q.ask(Q.merge(out, ["grp", "name"], F.col("sign")), ["grp", "name"], q).collect(), key=key)
    first = sorted(Q.percentiles(df.filter("day < 2"), ["grp"], {"v": F.col("v")}, q).collect(), key=key)
    assert [tuple(r) for r in left] == [tuple(r) for r in first]


def test_weights_and_two_rounds(spark, monkeypatch):
    df = table(spark, [("a", i % 7, float(i % 50)) for i in range(2000)])
    plain = [tuple(r) for r in Q.percentiles(df, [], {"v": F.col("v")}, (0.5,)).collect()]
    monkeypatch.setattr(Q, "_many_parts", lambda df: True)
    monkeypatch.setattr(Q, "SPARSE", 10)
    assert [tuple(r) for r in Q.percentiles(df, [], {"v": F.col("v")}, (0.5,)).collect()] == plain
    counted = df.groupBy("v").agg(F.count("*").alias("w"))
    assert [tuple(r) for r in Q.ask(Q.sketches(counted, [], {"v": F.col("v")}, F.col("w")), ["name"], (0.5,)).collect()] == plain
    huge = Q.sketches(counted, [], {"v": F.col("v")}, F.col("w") * 10**10)
    assert huge.first()["n"] == 2000 * 10**10


def test_edge_values(spark):
    rows = [("n", 0, None), ("n", 0, float("nan")), ("x", 0, float("inf")), ("x", 0, float("-inf")), ("x", 0, 0.0), ("x", 0, -0.0), ("x", 0, 1e-300), ("one", 0, 20.0)]
    got = {(r["grp"], r["quantile"]): (r["value"], r["n"]) for r in Q.percentiles(table(spark, rows), ["grp"], {"v": F.col("v")}, (0.0, 0.5, 1.0)).collect()}
    assert {g for g, _ in got} == {"x", "one"}
    assert got["one", 0.5] == (20.0, 1)
    assert got["x", 0.5] == (0.0, 5)
    assert (got["x", 0.0][0], got["x", 1.0][0]) == (float("-inf"), float("inf"))


def test_the_whole_range_of_doubles_keeps_the_stated_width(spark):
    rows = [("big", 0, 1e12), ("big", 0, 2e12), ("big", 0, 3e12), ("low", 0, -7.0), ("low", 0, -1e-200), ("low", 0, 1e300)]
    got = {r["grp"]: r["value"] for r in Q.percentiles(table(spark, rows), ["grp"], {"v": F.col("v")}, (0.5,)).collect()}
    assert got["big"] == pytest.approx(2e12, rel=2.0**-11)
    assert got["low"] == pytest.approx(-1e-200, rel=2.0**-11)


def test_empty(spark):
    e = table(spark, [])
    assert Q.percentiles(e, ["grp"], {"v": F.col("v")}, (0.5,)).count() == 0
    assert Q.ask(Q.merge(Q.sketches(e, ["grp"], {"v": F.col("v")}), ["grp"]), ["grp"], (0.5,)).count() == 0
