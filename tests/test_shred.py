import json
import random

import pyarrow as pa
import pytest

from tallyforge.operators import nested as N
from tallyforge.operators import shred as S


def rebuild(columns, n):
    """All (record, chain of positions, steps, value) that the level sequences hold."""
    out = []
    for path, col in columns.items():
        if not isinstance(path, tuple):
            continue
        ancestors = [path[: i + 1] for i, s in enumerate(path) if s in ("[]", "{}")]
        inner = ancestors[-1] if ancestors else ()
        rows = S.table(columns, inner)
        tables = [S.table(columns, a) for a in ancestors]
        for i, v in enumerate(rows.columns.get(path[len(inner) :], [])):
            if v is None:
                continue
            chain, at = [], i
            for t in reversed(tables):
                chain.append(int(t.pos[at]))
                at = int(t.parent[at])
            out.append((at if tables else int(rows.record[i]), tuple(reversed(chain)), path, v))
    return sorted(out, key=repr)


def expected(records):
    out = []

    def walk(r, v, path, chain):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(r, x, (*path, k), chain)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(r, x, (*path, "[]"), (*chain, i))
        elif v is not None and path:
            out.append((r, chain, path, v))

    for r, v in enumerate(records):
        walk(r, v, (), ())
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(30))
def test_round_trip(seed):
    rng = random.Random(seed)

    def value(depth):
        k = rng.random()
        if depth and k < 0.35:
            return {c: value(depth - 1) for c in rng.sample("abc", rng.randint(0, 3))}
        if depth and k < 0.7:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, 1, "x", True, 2.5])

    records = [rng.choice([{c: value(3) for c in rng.sample("abcd", rng.randint(0, 4))}, None]) for _ in range(rng.randint(0, 8))]
    assert rebuild(S.shred(records), len(records)) == expected(records)


def test_levels():
    cols = S.shred([{"a": [{"b": [1, 2]}, {}, {"b": [3]}]}, {"a": []}, None])
    c = cols[("a", "[]", "b", "[]")]
    assert (c.rep.tolist(), c.value.tolist()) == ([0, 2, 1, 1, 0, 0], [1, 2, None, 3, None, None])
    assert c.defn.tolist() == [5, 5, 2, 5, 1, 0]
    assert list(S.table(cols, ("a", "[]")).pos) == [0, 1, 2]
    assert list(S.table(cols, ("a", "[]")).record) == [0, 0, 0]


def test_empty():
    assert S.shred([]) == {}
    assert len(S.table({}, ("a", "[]")).record) == 0


def children(spark, bodies):
    rows = [(i, json.dumps(b) if not isinstance(b, (str, type(None))) else b, "clash", 1) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "contract_id bigint, body string, parent_key string, pos int")
    return sorted((r.parent_key, r.child_kind, r.child_key) for r in N.contract_tables(df).collect())


def test_contract_forms(spark):
    plain = {"assertions": [{"id": "A1", "ac": "AC1; AC2"}, {"says": "no id"}, None, {"id": " "}], "file_changes": [{"path": "a/b.ts"}, "c.ts", {"action": "x"}, None]}
    blocks = {"contract": {"assertions": [{"block": "x", "assertions": [{"id": "A1", "ac": ["AC1", None, "AC2"]}]}], "file_changes": [{"dir": "a", "files": [{"name": "b.ts"}, {"name": None}]}]}}
    mapped = {"data": {"contract": {"assertions": {"A1": {"says": "s", "ac": "AC1,AC2"}, "A2": None}, "file_changes": {"a/b.ts": "modify", "c.ts": "create"}}}}
    lists = json.dumps(json.dumps({"assertions": {"id": "A1", "says": "one"}, "file_changes": {"create": ["a/b.ts"], "modify": ["c.ts", None]}}))
    single = {"assertions": [], "file_changes": {"path": "a/b.ts", "action": "modify"}}
    got = children(spark, [plain, blocks, mapped, lists, single])
    of = lambda i, kind: [k for p, c, k in got if p == i and c == kind]
    for i in (0, 1, 2):
        assert of(i, "assertion") == ["A1"]
        assert of(i, "assertion_ac") == ["A1/AC1", "A1/AC2"]
    assert of(3, "assertion") == ["A1"]
    assert of(0, "file_change") == of(2, "file_change") == of(3, "file_change") == ["a/b.ts", "c.ts"]
    assert of(1, "file_change") == of(4, "file_change") == ["a/b.ts"]


def test_broken_and_empty_bodies(spark):
    assert children(spark, [None, "", "{", "null", "[]", "7", '"text"', '{"assertions": null, "file_changes": null}', '{"assertions": NaN}']) == []
    assert children(spark, []) == []


def test_long_body(spark):
    big = {"assertions": [{"id": f"A{i}", "ac": [f"AC{j}" for j in range(5)]} for i in range(5000)]}
    assert len(children(spark, [big, big])) == 2 * 5000 * 6


def test_entry_children(spark):
    schema = (
        "entry_idx int, assertions array<struct<id:string,says:string,status:string,deviation:string>>, contract struct<total:int,satisfied:int,unsatisfied:int,deviated:int>, "
        "timing struct<total_minutes:int,segments:array<struct<stage:string,minutes:int,phase:int>>>, child_key string"
    )
    rows = [
        (1, [("A1", None, None, None), None, (None, "s", None, None), ("A1", None, None, None)], (None, 0, None, None), (5, [("plan", 1, None), None, (None, None, None)]), "x"),
        (2, None, (None, None, None, None), None, "x"),
        (3, [], None, (None, None), "x"),
    ]
    got = sorted((r.parent_key, r.child_kind, r.child_key) for r in N.entry_tables(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "entry_assertion", "A1"), (1, "entry_assertion", "A1"), (1, "entry_contract", "contract"), (1, "entry_segment", "0"), (1, "entry_segment", "2")]


@pytest.mark.parametrize("parts", [1, 4])
def test_links_do_not_depend_on_the_partitioning(spark, parts):
    body = json.dumps({"assertions": [{"id": "A1", "says": "one", "ac": ["AC1", "AC2; AC3"]}, {"id": "A2", "ac": "AC4, AC5"}], "file_changes": [{"dir": "d", "files": [{"name": "x"}]}]})
    df = spark.createDataFrame([(i, body) for i in range(4)], "contract_id bigint, body string").repartition(parts)
    rows = N.contract_tables(df).collect()
    own = {(r.child_kind, r.child_key, r.parent_path, r.path) for r in rows if r.parent_key == 0}
    assert own == {
        ("assertion", "A1", None, "assertions[0]"),
        ("assertion", "A2", None, "assertions[1]"),
        ("assertion_ac", "A1/AC1", "assertions[0]", "assertions[0].ac[0]"),
        ("assertion_ac", "A1/AC2", "assertions[0]", "assertions[0].ac[1]"),
        ("assertion_ac", "A1/AC3", "assertions[0]", "assertions[0].ac[1][1]"),
        ("assertion_ac", "A2/AC4", "assertions[1]", "assertions[1].ac[0]"),
        ("assertion_ac", "A2/AC5", "assertions[1]", "assertions[1].ac[1]"),
        ("file_change", "d/x", None, "file_changes[0].files[0]"),
    }
    for key in range(4):
        assert {(r.child_kind, r.child_key, r.parent_path, r.path) for r in rows if r.parent_key == key} == own


def test_arrow_gives_the_same_levels_as_json():
    rng = random.Random(7)
    t = pa.struct([("a", pa.list_(pa.struct([("b", pa.int64()), ("c", pa.list_(pa.string()))]))), ("d", pa.struct([("e", pa.float64())]))])

    def pick(f):
        return None if rng.random() < 0.25 else f()

    for _ in range(20):
        rows = [pick(lambda: {"a": pick(lambda: [pick(lambda: {"b": pick(lambda: 1), "c": pick(lambda: [pick(lambda: "x") for _ in range(rng.randint(0, 2))])}) for _ in range(rng.randint(0, 3))]), "d": pick(lambda: {"e": pick(lambda: 0.5)})}) for _ in range(rng.randint(0, 9))]
        one, two = S.shred(rows), S.shred_arrow(pa.array(rows, t))
        for path, col in one.items():
            assert (col.rep.tolist(), col.defn.tolist(), col.value.tolist()) == (two[path].rep.tolist(), two[path].defn.tolist(), two[path].value.to_pylist())


def test_deep_nesting_needs_no_recursion():
    v = 1
    for _ in range(20_000):
        v = [v]
    cols = S.shred([{"a": v}])
    assert [len(p) for p in cols] == [20_001]
