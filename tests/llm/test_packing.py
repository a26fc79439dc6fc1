import random

import numpy as np
import pytest

from tallyforge.llm import packing as P

SCHEMA = "doc_id bigint, tokens bigint, part string, capacity string"


def packed(spark, sizes, packings, **how):
    df = spark.createDataFrame([(i, s, "clash", "clash") for i, s in enumerate(sizes)], SCHEMA)
    return [r.asDict() for r in P.pack(df, "doc_id", "tokens", packings, **how).collect()]


def check(sizes, rows, name, capacities):
    top = max(capacities)
    own = [r for r in rows if r["packing"] == name]
    bins = {}
    for i, s in enumerate(sizes):
        parts = sorted((r for r in own if r["item"] == i), key=lambda r: r["part"])
        assert [r["part"] for r in parts] == list(range(len(parts)))
        assert sum(r["tokens"] for r in parts) == (s or 0)
        if not s:
            assert [r["pack_id"] for r in parts] == [None]
        elif s <= top:
            assert len(parts) == 1  # whole
        else:
            assert [r["tokens"] for r in parts[:-1]] == [top] * (len(parts) - 1)
        for r in parts:
            if r["pack_id"] is not None:
                bins.setdefault((r["pack_id"], r["capacity"], r["pack_tokens"]), []).append(r["tokens"])
    assert len({b[0] for b in bins}) == len(bins)
    for (_, capacity, held), inside in bins.items():
        assert sum(inside) == held <= capacity
        assert capacity == min(c for c in capacities if c >= held)  # cut down to its contents
    return sum(b[1] for b in bins), len(bins)


@pytest.mark.parametrize("block", [50_000, 60])
def test_random(spark, block):
    rng = random.Random(1)
    sizes = [rng.choice([None, 0, 1, 5, 127, 128, 129, 1000, int(rng.paretovariate(0.8) * 10)]) for _ in range(400)]
    packings = {"tiny": [128], "usual": [512], "joint": [128, 512, 300, 512]}
    rows = packed(spark, sizes, packings, block_items=block)
    for name, caps in packings.items():
        check(sizes, rows, name, caps)


def test_fill_is_near_the_bound(spark):
    rng = random.Random(2)
    sizes = [int(rng.lognormvariate(5, 1)) + 1 for _ in range(3000)]
    rows = packed(spark, sizes, {"one": [2048], "joint": [128, 512, 2048]})
    room, bins = check(sizes, rows, "one", [2048])
    assert bins <= -(-sum(sizes) // 2048) + 2
    room_joint, _ = check(sizes, rows, "joint", [128, 512, 2048])
    assert sum(sizes) <= room_joint <= room


def test_best_fit_takes_the_fullest_bin():
    where, capacity = P.best_fit(np.array([7, 6, 3, 4]), [10])
    assert where.tolist() == [0, 1, 0, 1]
    assert capacity.tolist() == [10, 10]


def test_least_cost_bin_is_opened():
    # nothing else could fill a larger bin, so the smallest that holds the item is opened
    assert P.best_fit(np.array([60]), [64, 512])[1].tolist() == [64]
    assert P.best_fit(np.array([300, 200]), [256, 512])[1].tolist() == [512]


def test_edges(spark):
    assert packed(spark, [], {"a": [10]}) == []
    assert packed(spark, [5], {"a": [None, 0, -1]}) == []
    rows = packed(spark, [10**6, 5, 5, 5], {"a": [10]})
    check([10**6, 5, 5, 5], rows, "a", [10])
    twice = spark.createDataFrame([(1, 5, "", ""), (1, 5, "", "")], SCHEMA)
    assert P.pack(twice, "doc_id", "tokens", {"a": [10]}).count() == 2


def test_fill_report(spark):
    df = spark.createDataFrame([(i, s, "", "") for i, s in enumerate([5, 5, 7])], SCHEMA)
    r = P.fill(P.pack(df, "doc_id", "tokens", {"a": [10]})).first()
    assert (r["packs"], r["items"], r["tokens"], r["room"]) == (2, 3, 17, 20)
    assert r["fill"] == pytest.approx(0.85)


def test_blocks_do_not_follow_keys(spark):
    rows = packed(spark, [10] * 500, {"a": [100]}, block_items=50)
    blocks = {r["pack_id"] >> 32 for r in rows}
    assert len(blocks) == 10
