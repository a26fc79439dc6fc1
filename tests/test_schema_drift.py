import json
import random

import pytest

from tallyforge.operators import schema_drift as D

SCHEMA = "project string, doc_type string, file_no int, body string, path string, types string"


def table(spark, files):
    rows = [("p", "d", n, b, "clash", "clash") for n, bodies in files.items() for b in bodies]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    s = D.file_schemas(table(spark, files), ["project", "doc_type"], "file_no", "body")
    out = D.schema_changes(s, ["project", "doc_type"], "file_no").collect()
    return sorted((r.file_no, r.change_kind, r.old_path, r.new_path) for r in out)


def brute(files):
    def paths(v, at, out):
        if v is None:
            return
        kind = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "decimal" if isinstance(v, float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        if at:
            out.setdefault(at, set()).add(kind)
        for k, x in v.items() if isinstance(v, dict) else []:
            paths(x, f"{at}.{k}" if at else k, out)
        for x in v if isinstance(v, list) else []:
            paths(x, f"{at}[]", out)

    seen = {}
    for n, bodies in files.items():
        seen[n] = {}
        for b in bodies:
            try:
                v = json.loads(b)
            except (ValueError, TypeError):
                continue
            if isinstance(v, dict):
                paths(v, "", seen[n])
    out = []
    for n in files:
        if n - 1 not in files:
            continue
        a, b = seen[n - 1], seen[n]
        diff = {p for p in {*a, *b} if a.get(p) != b.get(p)}
        top = {p for p in diff if not any(p.startswith((u + ".", u + "[")) for u in diff)}
        parent = lambda p: p[:-2] if p.endswith("[]") else p.rpartition(".")[0]
        used = set()
        for p in top:
            if p in a and p not in b:
                gone = [q for q in top if q in a and q not in b and parent(q) == parent(p) and a[q] == a[p]]
                new = [q for q in top if q in b and q not in a and parent(q) == parent(p) and b[q] == a[p]]
                if len(gone) == len(new) == 1:
                    out.append((n, "renamed", p, new[0]))
                    used |= {p, new[0]}
        out += [(n, "added" if p not in a else "removed" if p not in b else "retyped", p, p) for p in top - used]
    return sorted(out)


def test_kinds_of_change(spark):
    files = {
        1: ['{"a": 1, "b": {"c": "x"}, "l": [{"id": "1", "ac": "A"}], "gone": true}'],
        2: ['{"a": 1.0, "b": {"c": "x", "d": null}, "l": [{"id": "1", "ac": ["A"]}], "new1": "t"}'],
        3: ['{"z": 1.0, "b": "text", "l": [], "new1": "t"}'],
    }
    assert changes(spark, files) == brute(files)
    assert (2, "retyped", "l[].ac", "l[].ac") in changes(spark, files)
    assert (3, "retyped", "b", "b") in changes(spark, files)  # nothing below b is listed
    assert (3, "renamed", "a", "z") in changes(spark, files)


def test_broken_null_and_missing(spark):
    files = {1: [None, "", "{", '{"a": NaN}', "<<<"], 2: ['{"a": 1}', '{"a": 1}'], 4: ['{"b": 1}'], 5: ["[1]", '"x"', "7"]}
    assert changes(spark, files) == [(2, "added", "a", "a"), (5, "removed", "b", "b")]


def test_ambiguous_rename(spark):
    files = {1: ['{"a": 1}'], 2: ['{"b": 1, "c": 2}'], 3: ['{"d": 1}']}
    assert changes(spark, files) == [(2, "added", "b", "b"), (2, "added", "c", "c"), (2, "removed", "a", "a"), (3, "added", "d", "d"), (3, "removed", "b", "b"), (3, "removed", "c", "c")]


def test_empty_table(spark):
    assert changes(spark, {}) == []


def test_long_record(spark):
    deep = "{" + ", ".join(f'"k{i}": {{"v": [{i}]}}' for i in range(3000)) + "}"
    assert len(changes(spark, {1: ['{"x": "y"}'], 2: [deep]})) == 3001


@pytest.mark.parametrize("seed", range(4))
def test_random_against_brute_force(spark, seed):
    rng = random.Random(seed)

    def value(depth):
        k = rng.random()
        if depth and k < 0.3:
            return {rng.choice("abcd"): value(depth - 1) for _ in range(rng.randint(0, 3))}
        if depth and k < 0.5:
            return [value(depth - 1) for _ in range(rng.randint(0, 2))]
        return rng.choice([None, True, 1, 1.5, "s"])

    files = {n: [json.dumps({k: value(2) for k in rng.sample("abcdef", 4)}) for _ in range(rng.randint(1, 3))] for n in range(1, 7)}
    assert changes(spark, files) == brute(files)


def test_lattice():
    assert D.promote(["integer", "decimal"]) == "decimal"
    assert D.promote(["decimal", "integer", "string"]) == "string"
    assert D.promote(["boolean", "integer"]) == "string"
    assert D.promote([]) == "string"


def union(spark, files, known=None, keep=("file_no", "body")):
    df = table(spark, files)
    s = D.file_schemas(df, ["project", "doc_type"], "file_no", "body")
    root = D.union_schema(s, D.schema_changes(s, ["project", "doc_type"], "file_no"), known)
    return root, D.unify(df, list(keep), "body", root)


def test_unified_table(spark):
    files = {1: ['{"version": 1, "body": "x"}'], 2: ['{"schema_version": 1.5, "tags": ["a"]}'], 3: ['{"schema_version": 2, "tags": "b"}', "{"]}
    _, out = union(spark, files, {"schema_version": D.Known(("integer",), ("version",))})
    assert out.columns == ["file_no", "body", "body_", "schema_version", "tags", "misfits"]
    got = sorted((r.file_no, r.schema_version, r.tags, r.body_) for r in out.collect() if r.body != "{")
    assert got == [(1, 1.0, None, "x"), (2, 1.5, ["a"], None), (3, 2.0, ["b"], None)]  # a scalar is lifted to a list
    assert out.filter("body = '{'").count() == 1  # broken rows stay, as nulls


def test_renames_are_folded_at_every_depth(spark):
    files = {1: ['{"list": [{"id": "a", "ac": "x"}], "camelCase": 1}'], 2: ['{"list": [{"id": "b", "acs": "y"}], "camel_case": 2}'], 3: ['{"list": [{"id": "c", "covers": "z"}], "camel_case": 3}']}
    _, out = union(spark, files)
    assert dict(out.dtypes)["list"] == "array<struct<ac:string,id:string>>"  # the first name of those in equally many files
    assert sorted((r.file_no, r.list[0].ac, r.camel_case) for r in out.collect()) == [(1, "x", 1), (2, "y", 2), (3, "z", 3)]


def test_names_met_side_by_side_are_two_fields(spark):
    files = {1: ['{"a": 1}'], 2: ['{"b": 1}'], 3: ['{"a": 1, "b": 2}']}
    _, out = union(spark, files)
    assert sorted((r.file_no, r.a, r.b) for r in out.collect()) == [(1, 1, None), (2, None, 1), (3, 1, 2)]


def test_odd_forms_stand_beside_a_struct(spark):
    files = {1: ['{"c": {"total": 3}}', '{"c": ["x", null]}', '{"c": "3 of 4"}', '{"c": null}', '{"c": {}}']}
    _, out = union(spark, files)
    assert dict(out.dtypes)["c"] == "struct<total:bigint,_items:array<string>,_value:string>"
    got = {r.body: r.c.asDict() if r.c else None for r in out.collect()}
    assert got['{"c": {"total": 3}}'] == {"total": 3, "_items": None, "_value": None}
    assert got['{"c": ["x", null]}'] == {"total": None, "_items": ["x", None], "_value": None}
    assert got['{"c": "3 of 4"}'] == {"total": None, "_items": None, "_value": "3 of 4"}
    assert got['{"c": null}'] is None


def test_what_does_not_fit_is_reported(spark):
    big = "9" * 25
    files = {1: ['{"n": 1, "v": 1}', f'{{"n": {big}, "v": 2}}', f'{{"n": {"8" * 5000}}}', '{"v": 3, "w": 4}']}
    _, out = union(spark, files, {"v": D.Known((), ("w",))})
    got = {r.body[:12]: (r.n, r.v, [(m.path, m.value[:30]) for m in r.misfits or []]) for r in out.collect()}
    assert got['{"n": 1, "v"'] == (1, 1, [])
    assert got['{"n": 999999'] == (None, 2, [("n", big)])
    assert got['{"n": 888888'] == (None, None, [("n", "8" * 30)])
    assert got['{"v": 3, "w"'] == (None, 3, [("w", "4")])  # two names of one field in one record


def test_objects_used_as_maps(spark):
    files = {1: ['{"f": {"src/a.ts": "new", "b-c": "old"}}', "{\"f\": {\"src/b.ts\": 1}}"]}
    _, out = union(spark, files)
    assert dict(out.dtypes)["f"] == "map<string,string>"
    assert sorted(sorted(r.f.items()) for r in out.collect()) == [[("b-c", "old"), ("src/a.ts", "new")], [("src/b.ts", "1")]]


def test_columns_do_not_depend_on_the_load(spark, sf):
    from tallyforge.plans import problems as P

    empty = spark.createDataFrame([], "project string, doc_type string, file_no int, body string")
    s = D.file_schemas(empty, P.SERIES, "file_no", "body")
    for kind, columns in (("proof", {"acceptance_criteria", "verdict_contradictions"}), ("contract", {"version", "assertions"})):
        none = D.unify(empty, ["project"], "body", D.union_schema(s, D.schema_changes(s, P.SERIES, "file_no"), P.KNOWN[kind]))
        full = P._unified(spark, sf, kind)
        assert none.count() == 0
        assert columns <= set(none.columns)
        if kind == "proof":
            assert {c: dict(none.dtypes)[c] for c in columns} == {c: dict(full.dtypes)[c] for c in columns}
        else:
            assert "ac:array<string>" in dict(none.dtypes)["assertions"] and "ac:array<string>" in dict(full.dtypes)["assertions"]


def test_the_same_columns_at_every_size(spark, sf):
    from pathlib import Path

    from tallyforge.plans import problems as P

    larger = Path(sf).parent / "sf0.01"
    if not larger.exists():
        pytest.skip("only one size is there")
    for kind in ("proof", "contract"):
        assert P._unified(spark, sf, kind).schema == P._unified(spark, str(larger), kind).schema


def test_union_of_nothing(spark):
    _, out = union(spark, {1: ["{", None, "7"]})
    assert out.columns == ["file_no", "body", "misfits"]
    assert out.count() == 3
