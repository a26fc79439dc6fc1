import random

import pytest

from tallyforge.llm import mixing as M

DOCS = "doc bigint, source string, tokens bigint, share string, total string"
TARGETS = "mix string, source string, target_weight double, max_repeats int, doc int"


def drawn(spark, docs, targets, **how):
    d = spark.createDataFrame([(*x, "clash", "clash") for x in docs], DOCS)
    t = spark.createDataFrame([(*x, 1) for x in targets], TARGETS)
    return [r.asDict() for r in M.draw(d, t, **how).collect()]


def world(n=1500, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["big", "big", "big", "Mid Size", "mid-size", "small"] if i % 20 else ["tiny"]), rng.randint(1, 200)) for i in range(n)]


def test_shares_and_repeats(spark):
    docs = world()
    rows = drawn(spark, docs, [("m", "big", 5.0, 1), ("m", "MID_SIZE", 3.0, 2), ("m", "tiny", 2.0, 3)])
    total = sum(r["tokens"] for r in rows)
    for source, share, most in (("big", 0.5, 1), ("mid_size", 0.3, 2), ("tiny", 0.2, 3)):
        own = [r for r in rows if r["source"] == source]
        assert sum(r["tokens"] for r in own) / total == pytest.approx(share, abs=300 / total)
        times = {}
        for r in own:
            times[r["doc"]] = times.get(r["doc"], 0) + 1
        assert max(times.values()) <= most
        assert len({(r["doc"], r["round"]) for r in own}) == len(own)
        # a document is used again only after every other of its source has been
        assert max(times.values()) - min([*times.values(), 0] if len(times) < sum(M_source(d) == source for d in docs) else times.values()) <= 1
    # the budget is the largest that some source can just give
    sums = {s: sum(d[2] for d in docs if M_source(d) == s) for s in ("big", "mid_size", "tiny")}
    budget = min(sums["big"] / 0.5, sums["mid_size"] * 2 / 0.3, sums["tiny"] * 3 / 0.2)
    assert budget - 201 <= total <= budget


def M_source(d):
    return d[1].lower().replace(" ", "_").replace("-", "_")


def test_same_draw_whatever_the_buckets(spark, monkeypatch):
    docs, targets = world(), [("m", "big", 1.0, 1), ("m", "small", 1.0, 4), ("n", "small", 1.0, 1)]
    key = lambda rows: sorted((r["mix"], r["doc"], r["round"]) for r in rows)
    one = key(drawn(spark, docs, targets))
    monkeypatch.setattr(M, "BUCKET_ROWS", 10)
    assert key(drawn(spark, docs, targets)) == one
    assert key(drawn(spark, docs, targets, seed=7)) != one


def test_given_budget(spark):
    docs, targets = world(), [("m", "big", 1.0, 1), ("m", "tiny", 1.0, 1)]
    rows = drawn(spark, docs, targets, budget=1000)
    assert 800 <= sum(r["tokens"] for r in rows) <= 1000
    everything = drawn(spark, docs, targets, budget=10**9)  # tiny runs out, big goes on
    assert len(everything) == sum(M_source(d) in ("big", "tiny") for d in docs)


def test_odd_targets(spark):
    docs = [(1, "a", 5), (2, "a", 5), (3, None, 5), (4, " ", 5), (5, "b", 0), (6, "b", None)]
    targets = [
        ("m", "a", 1.0, None), ("m", "unknown", 9.0, 1), ("m", "b", 1.0, 5), ("m", None, 1.0, 1), ("m", "a", 1.0, 2),
        ("zero", "a", 0.0, 1), ("none", "a", 1.0, 0), ("null", "a", None, 1), ("nan", "a", float("nan"), 1),
    ]
    rows = drawn(spark, docs, targets)
    assert {r["mix"] for r in rows} == {"m"}
    assert sorted((r["doc"], r["round"]) for r in rows) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_empty(spark):
    assert drawn(spark, [], [("m", "a", 1.0, 1)]) == []
    assert drawn(spark, [(1, "a", 5)], []) == []


def test_ties_and_repeated_rows(spark):
    docs = [(i % 10, "a", 7) for i in range(40)] + [(i, "b", 7) for i in range(40)]
    rows = drawn(spark, docs, [("m", "a", 1.0, 1), ("m", "b", 1.0, 1)])
    assert len(rows) == 80
