from tallyforge.operators import graph as G
from tallyforge.operators import joins as J

T = "project string, entry_idx int, file string"


def touched(spark, items):
    return spark.createDataFrame([("p", e, f) for e, files in enumerate(items) for f in sorted(set(files))], T)


def none(spark, ddl):
    return spark.createDataFrame([], ddl)


def partners(spark, items, edges=(), nodes=()):
    e = spark.createDataFrame([("p", *x) for x in edges], "project string, src string, dst string") if edges else none(spark, "project string, src string, dst string")
    n = spark.createDataFrame([("p", x) for x in nodes], "project string, file string") if nodes else none(spark, "project string, file string")
    return sorted((r.file, r.partner, r.together, r.relation) for r in J.cochange(touched(spark, items), e, n).collect())


def test_cochange_gates(spark):
    assert partners(spark, [["a", "b"], ["a", "b"], ["a"], ["b"]]) == [("a", "b", 2, "unknown"), ("b", "a", 2, "unknown")]
    assert partners(spark, [["a", "b"], ["a", "b"], ["a"]]) == []  # b has two touches only
    assert partners(spark, [["a", "b"], ["a"], ["a"], ["b"], ["b"]]) == []  # together once


def test_oversized_items_count_touches_only(spark):
    big = [["a", "b", *[f"x{i}" for i in range(39)]]]  # 41 files
    assert partners(spark, [["a", "b"], ["a", "b"], *big])[0][2] == 2
    assert partners(spark, [["a", "b"], *big, *big]) == []
    even = [["a", "b", *[f"x{i}" for i in range(38)]]]  # 40 files
    assert ("a", "b", 3, "unknown") in partners(spark, [["a", "b"], *even, *even])


def test_relations_and_own_tests(spark):
    items = [["src/a.ts", "tests/a.test.ts", "src/b.ts", "src/c.ts", "src/d.ts"]] * 3
    got = partners(spark, items, [("src/b.ts", "src/a.ts")], ["src/a.ts", "src/b.ts", "src/c.ts"])
    of = {(a, b): r for a, b, _, r in got}
    assert ("src/a.ts", "tests/a.test.ts") not in of
    assert of["src/a.ts", "src/b.ts"] == of["src/b.ts", "src/a.ts"] == "imports"
    assert of["src/a.ts", "src/c.ts"] == "hidden"
    assert of["src/a.ts", "src/d.ts"] == "unknown"
    assert ("src/b.ts", "tests/a.test.ts") in of


def test_path_matching(spark):
    P = "project string, path string"
    left = spark.createDataFrame([("p", x) for x in ("a.ts", "/w/src/a.ts", "src/a.ts", "xa.ts", "c/src/b.ts")], P)
    right = spark.createDataFrame([("p", x) for x in ("src/a.ts", "lib/a.ts", "b.ts")] + [("q", "src/a.ts")], P)
    got = sorted((r.path, r.match) for r in J.path_matches(left, right).collect())
    assert got == [("/w/src/a.ts", "src/a.ts"), ("a.ts", "lib/a.ts"), ("a.ts", "src/a.ts"), ("c/src/b.ts", "b.ts"), ("src/a.ts", "src/a.ts")]
    assert {r.path: r.match for r in J.resolved(left, right).collect()}["a.ts"] == "lib/a.ts"
    assert {r.path: r.resolved for r in J.unique_basenames(left, right).collect()}["a.ts"] == "a.ts"  # two files of that name


def test_coverage(spark):
    scope = spark.createDataFrame([(1, x) for x in ("AC1", "AC2", "AC3", "AC4")], "item int, ac string")
    links = spark.createDataFrame([(1, "AC1", "exists"), (1, "AC1", "equals"), (1, "AC2", "truthy"), (2, "AC4", "equals")], "item int, ac string, matcher string")
    waived = spark.createDataFrame([(1, "AC1", "retired"), (1, "AC3", "judgment")], "item int, ac string, way string")
    got = {r.ac: (r.state, r.links, r.weak_only) for r in J.coverage(scope, links, waived).collect()}
    assert got == {"AC1": ("pinned", 2, False), "AC2": ("pinned", 1, True), "AC3": ("judgment", 0, False), "AC4": ("uncovered", 0, False)}


def test_bands(spark):
    rows = spark.createDataFrame([("p", "f", x) for x in (1, 1, 21, 22, 60, None)] + [("p", None, 1)], "project string, file string, line int")
    assert sorted((r.line, r.here, r.near) for r in J.near_lines(rows).collect()) == [(1, 2, 3), (21, 1, 4), (22, 1, 2), (60, 1, 1)]
    marks = spark.createDataFrame([("p", "f", 10)], "project string, file string, line int")
    at = spark.createDataFrame([("p", "f", x) for x in (10, 11, 15, 16)], "project string, file string, line int")
    assert sorted(r.line for r in J.above_within(marks, at).collect()) == [11, 15]


def test_merge_and_division(spark):
    old = spark.createDataFrame([("a", 1, "mine"), ("b", 2, None)], "k string, n int, label string")
    new = spark.createDataFrame([("b", 5, "theirs"), ("c", 6, "x")], "k string, n int, label string")
    got = {r.k: (r.n, r.label, r.state) for r in J.merged(old, new, ["k"], ["n"], ["label"]).collect()}
    assert got == {"a": (1, "mine", "kept"), "b": (5, "theirs", "refreshed"), "c": (6, "x", "added")}
    facts = spark.createDataFrame([("p", "x"), ("p", "x"), ("q", "x"), ("q", "y")], "project string, fact string")
    rules = spark.createDataFrame([("both", "x"), ("both", "y"), ("one", "x")], "rule string, trigger string")
    assert sorted(map(tuple, J.all_hold(facts, rules).collect())) == [("p", "one"), ("q", "both"), ("q", "one")]


def test_prefixes_and_names(spark):
    items = spark.createDataFrame([("p", 1, "packages/a/x.ts"), ("p", 1, "packages/a/y/z.ts"), ("p", 2, "packages/a/x.ts"), ("p", 2, "web/x"), ("p", 3, "packages/ab/x")], "project string, item int, file string")
    prefixes = spark.createDataFrame([("p", "packages/a"), ("p", "web")], "project string, prefix string")
    assert {r.item: r.prefix for r in J.by_prefix(items, prefixes).collect()} == {1: "packages/a", 2: None, 3: None}
    names = spark.createDataFrame([("p", "apps/web"), ("p", "libs/web"), ("p", "api")], "project string, path string")
    assert {r.path: r.name for r in J.collision_names(names).collect()} == {"apps/web": "apps-web", "libs/web": "libs-web", "api": "api"}


def test_imports_resolve(spark):
    files = spark.createDataFrame([("p", x) for x in ("src/a.ts", "src/b/index.ts", "src/c.tsx", "packages/u/src/index.ts", "src/d.ts")], "project string, path string")
    specs = ["./b", "./c.js", "../src/d", "./none", "@/d", "@w/u", "react", "./a"]
    imports = spark.createDataFrame([("p", "src/a.ts", s) for s in specs], "project string, src string, specifier string")
    aliases = spark.createDataFrame([("p", "@/", "src")], "project string, prefix string, target string")
    packages = spark.createDataFrame([("p", "@w/u", "packages/u")], "project string, name string, folder string")
    out = G.resolve_imports(imports, files, aliases, packages)
    got = {r.specifier: r.dst for r in out.collect()}
    assert got == {"./b": "src/b/index.ts", "./c.js": "src/c.tsx", "../src/d": "src/d.ts", "./none": None, "@/d": "src/d.ts", "@w/u": "packages/u/src/index.ts", "react": None}
    assert {r.dst: r.in_degree for r in G.in_degrees(out).collect()}["src/d.ts"] == 1  # two imports, one importer
    assert G.unresolved(out).first().unresolved == 1


def test_coverage_reads_every_form_of_contract(spark, tmp_path):
    import json

    from tallyforge.plans.joins import R

    plain = {"assertions": [{"id": "A1", "matcher": "exists", "ac": ["AC1", "AC7"]}], "coverage_waivers": [{"ac": "ac2", "kind": "retired", "reason": "gone"}, {"ac": "AC3", "kind": "retired", "reason": " "}, {"ac": "AC4", "kind": "other", "reason": "x"}]}  # the last two are no waivers
    blocks = {"assertions": [{"name": "b", "assertions": [{"id": "A1", "matcher": "equals", "ac": "AC1; AC2"}]}]}
    mapped = {"assertions": {"A1": {"matcher": "truthy", "ac": ["AC1"]}}}
    bodies = [plain, {"contract": blocks}, {"data": {"contract": mapped}}, json.dumps(plain), {"assertions": []}]
    rows = [(i, "p", f"s{i}", None, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "p", "s9", None, "{broken")]
    spark.createDataFrame(rows, "contract_id bigint, project string, slug string, sealed_at timestamp, body string").write.parquet(f"{tmp_path}/contracts.parquet")
    spark.createDataFrame([(0, "p", None, "s2", (2,))], "entry_idx int, project string, ingested_at timestamp, slug string, acceptance_criteria struct<total int>").write.parquet(f"{tmp_path}/entries.parquet")
    got = {tuple(r) for r in R.queries["criterion_coverage"](spark, str(tmp_path)).select("item", "ac", "state", "weak_only").collect()}
    whole = {("AC1", "pinned", True), ("AC7", "pinned", True), ("AC2", "retired", False)}
    assert got == {(i, *x) for i in (0, 3) for x in whole} | {(1, "AC1", "pinned", False), (1, "AC2", "pinned", False), (2, "AC1", "pinned", True), (2, "AC2", "uncovered", False)}
    gate = {r["item"]: r["gate"] for r in R.queries["coverage_gate"](spark, str(tmp_path)).collect()}
    assert gate == {0: "active", 1: "active", 2: "block", 3: "active", 4: "degrade"}


def test_most_connected_counts_partners_in_large_entries(spark, tmp_path):
    from tallyforge.plans.rules import R

    rows = [(0, "p", None, "s", [f"a/{i:03}.py" for i in range(150)]), (1, "p", None, "s", ["a/000.py", "b.py"]), (2, "p", None, "s", ["b.py", "c.py", "d.py"])]
    spark.createDataFrame(rows, "entry_idx int, project string, ingested_at timestamp, slug string, modules_touched array<string>").write.parquet(f"{tmp_path}/entries.parquet")
    got = {(r["file"], r["partners"], r["rank"]) for r in R.queries["most_connected"](spark, str(tmp_path)).collect()}
    assert got == {("a/000.py", 150, 1), ("b.py", 3, 3)} | {(f"a/{i:03}.py", 149, 2) for i in range(1, 150)}
