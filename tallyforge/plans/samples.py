"""Queries over small literal inputs, for what the tables do not hold: manifests, source code, an import graph, diffs,
SQL scripts, transcripts, test runs, reports.

Each runs the operator on the input below and has the rows that must come out,
worked out by hand from the rule, as its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import graph, reports, sessions
from tallyforge.operators import joins as J
from tallyforge.operators import stats as S
from tallyforge.registry import Registry
from tallyforge.sources import code, manifests

R = Registry()


def rows_sql(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({columns})"


#: (project, path, text) of a small tree.
TREE = (
    ("web", "package.json", '{"name": "web", "dependencies": {"react": "18", "@scope/ui": "1"}, "devDependencies": {"vitest": "1", "react": "18"}, "peerDependencies": {"zod": "3"}}'),
    ("web", "package-lock.json", '{"lockfileVersion": 3, "packages": {"": {}, "node_modules/react": {}, "node_modules/react/node_modules/@types/node": {}}}'),
    ("api", "requirements.txt", "# pinned\nFlask==2.0\nrequests[socks]>=2 ; python_version > '3'\n-r other.txt\nflask\n"),
    ("api", "pyproject.toml", '[project]\nname = "api"\ndependencies = ["attrs>=2", "Httpx"]\n[tool.poetry.dependencies]\npython = "^3.11"\nrich = "*"\n'),
    ("api", "Pipfile", '[packages]\nClick = "*"\n[dev-packages]\npytest = "*"\n'),
    ("svc", "go.mod", "module svc\ngo 1.22\nrequire github.com/Gin/Gin v1.9\nrequire (\n\tgolang.org/x/net v0.1 // indirect\n\tgopkg.in/yaml.v3 v3.0\n)\n"),
    ("svc", "Cargo.toml", '[package]\nname = "svc"\n[dependencies]\nserde = { version = "1" }\n[dev-dependencies]\nproptest = "1"\n'),
    ("shop", "Gemfile", "source 'https://rubygems.org'\ngem 'rails', '~> 7'\n  gem \"pg\"\n# gem 'no'\n"),
    ("shop", "composer.json", '{"require": {"php": ">=8", "ext-json": "*", "laravel/framework": "10"}, "require-dev": {"phpunit/phpunit": "10"}}'),
    ("web", "src/app.ts", "import React, {\n  useState as state,\n  useMemo,\n} from 'react';\nimport './style.css';\nimport { load } from '@/lib/load.js';\nexport { helper } from '../shared/helper';\n// import { no } from './no';\nexport async function start(a: string) {\n  const x = await import('./lazy');\n}\nexport const stop = (b) => b;\nexport default class App extends Base {\n}\nexport interface Shape { a: string }\n"),
    ("web", "src/lib/load.ts", "import { helper } from '../../shared/helper';\nexport function load() {}\n"),
    ("web", "src/lazy/index.ts", "import { load } from '../lib/load';\nimport { gone } from './gone';\n"),
    ("web", "shared/helper.ts", "export function helper() {}\n"),
    ("web", "tests/lib/load.test.ts", "import { load } from '../../src/lib/load';\n"),
    ("api", "api/main.py", "import os\nfrom .models import User, Role as R\n\n@app.route('/x')\nasync def index():\n    pass\n\nclass Admin(User, mixins.Log):\n    @property\n    def name(self):\n        return 1\n"),
    ("api", "api/bad.py", "def broken(:\n"),
    ("svc", "main.go", 'package main\n\nimport (\n\t"fmt"\n\tlog "github.com/x/log"\n)\n\ntype Server struct {\n}\n\nfunc (s *Server) Run() {}\nfunc helper() {}\n'),
)


def tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TREE), "project string, path string, text string")


@R.query(
    "manifest_dependencies",
    rows_sql(
        "project, manifest, name",
        *[f"('web', 'package.json', '{n}')" for n in ("@scope/ui", "react", "vitest", "zod")],
        *[f"('web', 'package-lock.json', '{n}')" for n in ("@types/node", "react")],
        *[f"('api', 'requirements.txt', '{n}')" for n in ("flask", "requests")],
        *[f"('api', 'pyproject.toml', '{n}')" for n in ("attrs", "httpx", "rich")],
        *[f"('api', 'Pipfile', '{n}')" for n in ("click", "pytest")],
        *[f"('svc', 'go.mod', '{n}')" for n in ("github.com/gin/gin", "golang.org/x/net", "gopkg.in/yaml.v3")],
        *[f"('svc', 'Cargo.toml', '{n}')" for n in ("proptest", "serde")],
        *[f"('shop', 'Gemfile', '{n}')" for n in ("pg", "rails")],
        *[f"('shop', 'composer.json', '{n}')" for n in ("laravel/framework", "phpunit/phpunit")],
    ),
)
def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06 to SRC-15: dependency names of nine kinds of manifest, merged by project."""
    return manifests.dependencies(tree(spark))


@R.query(
    "merged_dependencies",
    rows_sql("root, name, version", "('p', 'react', '19')", "('p', 'zod', '3')", "('p', 'vite', '5')"),
)
def merged_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-54: the dependencies of a repository's roots as one map; the last root that names a package wins."""
    rows = [("p", 0, {"react": "18", "zod": "3"}), ("p", 1, {"react": "19"}), ("p", 2, {"vite": "5", "gone": None})]
    d = spark.createDataFrame(rows, "root string, place int, deps map<string,string>").select("root", "place", F.explode("deps").alias("name", "version")).filter(F.col("version").isNotNull())
    return d.groupBy("root", "name").agg(F.max_by("version", "place").alias("version"))


@R.query(
    "parsed_symbols",
    rows_sql(
        "path, name, kind, line, exported",
        "('src/app.ts', 'start', 'function', 9, true)",
        "('src/app.ts', 'stop', 'function', 12, true)",
        "('src/app.ts', 'App', 'class', 13, true)",
        "('src/lib/load.ts', 'load', 'function', 2, true)",
        "('shared/helper.ts', 'helper', 'function', 1, true)",
        "('api/main.py', 'index', 'function', 5, true)",
        "('api/main.py', 'name', 'function', 10, false)",
        "('api/main.py', 'Admin', 'class', 8, true)",
        "('main.go', 'Run', 'function', 11, true)",
        "('main.go', 'helper', 'function', 12, false)",
        "('main.go', 'Server', 'class', 8, true)",
    ),
)
def parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, SRC-18, SRC-20: functions and classes of source files, and which of them are exported."""
    return code.symbols(code.parse_files(tree(spark)))


@R.query(
    "parsed_imports",
    rows_sql(
        "path, module, names, line",
        "('src/app.ts', 'react', 'useState,useMemo', 1)",
        "('src/app.ts', './style.css', '', 5)",
        "('src/app.ts', '@/lib/load.js', 'load', 6)",
        "('src/app.ts', '../shared/helper', 'helper', 7)",
        "('src/app.ts', './lazy', '', 10)",
        "('src/lib/load.ts', '../../shared/helper', 'helper', 1)",
        "('src/lazy/index.ts', '../lib/load', 'load', 1)",
        "('src/lazy/index.ts', './gone', 'gone', 2)",
        "('tests/lib/load.test.ts', '../../src/lib/load', 'load', 1)",
        "('api/main.py', 'os', '', 1)",
        "('api/main.py', '.models', 'User,Role', 2)",
        "('main.go', 'fmt', '', 4)",
        "('main.go', 'github.com/x/log', '', 5)",
    ),
)
def parsed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, SRC-19: imports of source files, also over several lines; none from comments."""
    return code.parse_files(tree(spark)).select("path", F.explode("imports").alias("i")).select("path", "i.module", F.array_join("i.names", ",").alias("names"), "i.line")


@R.query("parse_errors", rows_sql("path, errors", "('api/bad.py', 1)"))
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17: a file that cannot be parsed is a row with an error, and the others are parsed."""
    return code.parse_files(tree(spark)).filter(F.col("errors") > 0).select("path", "errors")


def import_edges(spark: SparkSession) -> DataFrame:
    t = tree(spark)
    parsed = code.parse_files(t.filter(F.col("project") == "web").select("path", "text"))
    imports = parsed.select(F.lit("web").alias("project"), F.col("path").alias("src"), F.explode("imports.module").alias("specifier")).distinct()
    return graph.resolve_imports(imports, t.select("project", "path"), spark.createDataFrame([("web", "@/", "src")], "project string, prefix string, target string"))


@R.query(
    "resolved_imports",
    rows_sql(
        "src, specifier, dst",
        "('src/app.ts', 'react', NULL)",
        "('src/app.ts', './style.css', NULL)",
        "('src/app.ts', '@/lib/load.js', 'src/lib/load.ts')",
        "('src/app.ts', '../shared/helper', 'shared/helper.ts')",
        "('src/app.ts', './lazy', 'src/lazy/index.ts')",
        "('src/lib/load.ts', '../../shared/helper', 'shared/helper.ts')",
        "('src/lazy/index.ts', '../lib/load', 'src/lib/load.ts')",
        "('src/lazy/index.ts', './gone', NULL)",
        "('tests/lib/load.test.ts', '../../src/lib/load', 'src/lib/load.ts')",
    ),
)
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-28: specifiers resolved to files: relative, with another extension, by an alias, to an index; null for packages and missing files."""
    return import_edges(spark).select("src", "specifier", "dst")


@R.query("import_degrees", rows_sql("dst, in_degree", "('src/lib/load.ts', 3)", "('shared/helper.ts', 2)", "('src/lazy/index.ts', 1)"))
def import_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-33: distinct importers of every file of the graph."""
    return graph.in_degrees(import_edges(spark)).select("dst", F.col("in_degree").cast("int").alias("in_degree"))


@R.query("unresolved_imports", rows_sql("project, unresolved", "('web', 2)"))
def unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-33: relative imports that no file answers to."""
    return graph.unresolved(import_edges(spark)).select("project", F.col("unresolved").cast("int").alias("unresolved"))


#: (entry, files) of a ledger of the tree above.
TOUCHED = (
    (1, ("src/app.ts", "src/lib/load.ts", "shared/helper.ts")),
    (2, ("src/app.ts", "src/lib/load.ts", "tests/lib/load.test.ts", "README.md")),
    (3, ("src/app.ts", "shared/helper.ts", "tests/lib/load.test.ts", "src/lib/load.ts")),
    (4, ("src/lazy/index.ts", "shared/helper.ts", "README.md")),
    (5, ("README.md", "src/lazy/index.ts", "tests/lib/load.test.ts")),
    (6, tuple(f"gen/f{i}.ts" for i in range(39)) + ("src/app.ts", "README.md")),
)


@R.query(
    "graph_partners",
    rows_sql(
        "file, partner, together, relation",
        *[
            f"('{a}', '{b}', {n}, '{r}')"
            for x, y, n, r in (
                ("src/app.ts", "src/lib/load.ts", 3, "imports"),
                ("src/app.ts", "shared/helper.ts", 2, "imports"),
                ("src/app.ts", "tests/lib/load.test.ts", 2, "hidden"),
                ("src/lib/load.ts", "shared/helper.ts", 2, "imports"),
                ("tests/lib/load.test.ts", "README.md", 2, "unknown"),
            )
            for a, b in ((x, y), (y, x))
        ],
    ),
)
def graph_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01, JN-02, SET-04: co-change partners of a project with its real import graph.

    A file and its own test are no partners, files touched less than three times
    take no part, entries of more than forty files count for touches only.
    """
    touched = spark.createDataFrame([("web", e, f) for e, fs in TOUCHED for f in fs], "project string, entry_idx int, file string")
    nodes = tree(spark).filter("project = 'web' AND path LIKE '%.ts'").select("project", F.col("path").alias("file"))
    edges = import_edges(spark).filter(F.col("dst").isNotNull()).select("project", "src", "dst")
    return J.cochange(touched, edges, nodes).select("file", "partner", F.col("together").cast("int").alias("together"), "relation")


@R.query(
    "graph_neighbours",
    rows_sql("file, neighbour, way", "('src/lib/load.ts', 'shared/helper.ts', 'out')", "('src/lib/load.ts', 'src/app.ts', 'in')", "('src/lib/load.ts', 'src/lazy/index.ts', 'in')", "('src/lib/load.ts', 'tests/lib/load.test.ts', 'in')"),
)
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06: one hop in and out of a file of the graph."""
    g = import_edges(spark).filter(F.col("dst").isNotNull())
    out = g.filter(F.col("src") == "src/lib/load.ts").select(F.col("src").alias("file"), F.col("dst").alias("neighbour"), F.lit("out").alias("way"))
    return out.unionByName(g.filter(F.col("dst") == "src/lib/load.ts").select(F.col("dst").alias("file"), F.col("src").alias("neighbour"), F.lit("in").alias("way"))).distinct()


@R.query(
    "neighbours_without_partners",
    rows_sql("file, neighbour", "('src/app.ts', 'src/lazy/index.ts')", "('src/lazy/index.ts', 'src/lib/load.ts')", "('tests/lib/load.test.ts', 'src/lib/load.ts')"),
)
def neighbours_without_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05: edges of the graph whose ends are not also partners."""
    g = import_edges(spark).filter(F.col("dst").isNotNull()).select(F.col("src").alias("file"), F.col("dst").alias("neighbour")).distinct()
    return g.join(graph_partners(spark, sf_dir).select("file", F.col("partner").alias("neighbour")), ["file", "neighbour"], "left_anti")


@R.query(
    "numstat_churn",
    rows_sql("item, file, added, deleted", "('a', 'src/x.ts', 10, 2)", "('a', 'img.png', 0, 0)", "('a', 'odd' || chr(9) || 'name.txt', 1, 1)", "('b', 'y.py', 0, 7)"),
)
def numstat_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22, SRC-23: lines added and deleted by file; binary files count 0."""
    d = spark.createDataFrame([("a", "10\t2\tsrc/x.ts\n-\t-\timg.png\n\nshort\t1\n1\t1\todd\tname.txt\n"), ("b", "0\t7\ty.py"), ("c", "")], "item string, text string")
    return sessions.churn(d).select("item", "file", F.col("added").cast("int").alias("added"), F.col("deleted").cast("int").alias("deleted"))


@R.query("surviving_tables", rows_sql("project, name", "('p', 'users')", "('p', 'orders')", "('q', 'users')"))
def surviving_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-43: tables left after all scripts in the order of their paths."""
    rows = [
        ("p", "db/002.sql", 'DROP TABLE IF EXISTS "Legacy";\ncreate table if not exists public."Orders" (id int);'),
        ("p", "db/001.sql", "CREATE TABLE users (id int); CREATE TABLE legacy(id int); CREATE TABLE tmp (x int); drop table tmp;"),
        ("q", "a.sql", "create table Users (id int); -- dropping table nothing"),
        ("q", "b.sql", None),
    ]
    return sessions.surviving_tables(spark.createDataFrame(rows, "project string, path string, text string"))


@R.query("best_schema", rows_sql("project, folder, models", "('p', 'packages/db/prisma/', 3)", "('q', 'a/', 1)"))
def best_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-44, AGG-55: the schema folder with most models, all its files together."""
    rows = [("p", "examples/schema.prisma", "model A {\n}\nmodel B {\n}"), ("p", "packages/db/prisma/schema.prisma", "model A {\n}\n// model no\nenum E {\n}\n"), ("p", "packages/db/prisma/more.prisma", "  model C {\n}\nmodel D {\n}"), ("q", "b/s.prisma", "model X {"), ("q", "a/s.prisma", "model Y {"), ("q", "x.sql", "model Z {")]
    return sessions.best_schema(spark.createDataFrame(rows, "project string, path string, text string")).select("project", "folder", F.col("models").cast("int").alias("models"))


_LINES = (
    ("s1", 0, "user", None, "2025-01-01 00:00:00", None, None, ()),
    ("s1", 1, "assistant", "r1", "2025-01-01 00:00:10", 100, 20, (("Read", "/repo/src/a.ts"), ("Read", "/repo/src/b.ts"))),
    ("s1", 2, "assistant", "r1", "2025-01-01 00:00:11", 100, 20, (("Read", "/repo/src/a.ts"), ("Bash", None))),
    ("s1", 3, "assistant", "r2", "2025-01-01 00:00:30", 50, 5, (("Edit", "/repo/src/b.ts"),)),
    ("s1", 4, "assistant", "r3", "2025-01-01 00:01:00", 10, 1, (("Write", "C:\\repo\\src\\a.ts"), ("Edit", "/repo/src/a.ts"))),
    ("s1", 5, "assistant", "r4", "2025-01-01 00:02:00", 999, 9, (("Edit", "/repo/src/a.ts"),)),
    ("s2", 0, "assistant", "q1", None, 7, 3, ()),
)


@R.query(
    "session_localisation",
    rows_sql(
        "session, turns, reads, distinct_reads, wrong_reads, redundant_reads, ratio, tokens_to_edit, turns_to_edit, ms_to_edit",
        "('s1', 5, 3, 2, 1, 1, 0.3333::DOUBLE, 186, 4, 60000)",
        "('s2', 1, 0, 0, 0, 0, 0.0, NULL, NULL, NULL)",
    ),
)
def session_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-34, WIN-07: reads of a session, and tokens, turns and time until it first edits a relevant file; tokens once per request."""
    lines = spark.createDataFrame([(*x[:4], x[4], *x[5:]) for x in _LINES], "session string, line_no int, type string, request string, t string, input_tokens int, output_tokens int, uses array<struct<name:string,file:string>>")
    lines = lines.withColumn("at", F.to_timestamp("t")).withColumn("model", F.lit("m")).withColumn("cache_tokens", F.lit(0))
    out = sessions.localisation(lines, spark.createDataFrame([("s1", "src/a.ts"), ("s2", "x.ts")], "session string, file string"))
    whole = [F.col(c).cast("int").alias(c) for c in ("turns", "reads", "distinct_reads", "wrong_reads", "redundant_reads", "tokens_to_edit", "turns_to_edit", "ms_to_edit")]
    return out.select("session", *whole, (F.floor(F.col("redundant_ratio") * 1e4 + 0.5) / 1e4).alias("ratio"))


@R.query(
    "session_labels",
    rows_sql("item, place, label", "('a', 0, 'plan')", "('a', 1, 'build')", "('a', 2, 'build 2')", "('b', 0, 'plan · m1')", "('b', 1, 'build · m2')", "('c', 0, 'build · m1')"),
)
def session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-37, WIN-08: sessions numbered within their role, with the model where it tells them apart."""
    rows = [("a", 0, "plan", "m1", True), ("a", 1, "build", "m1", True), ("a", 2, "build", "m1", True), ("b", 0, "plan", "m1", True), ("b", 1, "build", "m2", True), ("c", 0, "build", "m1", False)]
    return sessions.role_sessions(spark.createDataFrame(rows, "item string, place int, role string, model string, counted boolean"))


_RUNS = (
    ("vitest", "npx vitest run", "Tests  1 failed | 12 passed | 2 skipped (15)\n", 1),
    ("vitest json", "vitest --reporter=json", 'noise {"numTotalTests": 5, "numPassedTests": 3, "numFailedTests":0,"numPendingTests":1,"numTodoTests":1,"testResults":[]}', 0),
    ("jest", "jest", "Tests:       2 skipped, 3 passed, 5 total\n", 0),
    ("pytest", "python -m pytest -q", "===== 3 passed, 1 failed, 2 errors, 1 skipped in 0.50s =====", 1),
    ("go", "go test -json ./...", '{"Action":"run","Test":"A"}\n{"Action":"pass","Package":"p","Test":"A"}\n{"Action":"skip","Test":"B"}\n{"Action":"pass","Package":"p"}\n', 0),
    ("cargo", "cargo test", "test result: ok. 3 passed; 0 failed; 1 ignored; 0 measured\ntest result: ok. 2 passed; 0 failed; 0 ignored; 0 measured\n", 0),
    ("rspec", "bundle exec rspec", "5 examples, 1 failure, 2 pending\n", 1),
    ("junit", "mvn test", '<testsuites tests="9"><testsuite name="a" tests="4" failures="1" errors="0" skipped="1"><testsuite name="b" tests="2"></testsuites>', 1),
    ("dotnet", "dotnet test", "Failed: 0, Passed: 3, Skipped: 1, Total: 4", 0),
    ("prose", "make check", "5 examples, 0 failures", 0),
    ("skipped", "jest", "Tests:  4 skipped, 4 total", 0),
    ("crash", "vitest", "Segmentation fault", 1),
    ("silent", "vitest", "", 0),
    ("killed", "jest", "Tests: 3 passed, 3 total", None),
    ("nothing", "pytest", None, 0),
)


@R.query(
    "captured_runs",
    rows_sql(
        "run, runner, passed, failed, skipped, verdict",
        "('vitest', 'vitest', 12, 1, 2, 'FAIL')",
        "('vitest json', 'vitest', 3, 0, 2, 'PASS')",
        "('jest', 'jest', 3, 0, 2, 'PASS')",
        "('pytest', 'pytest', 3, 3, 1, 'FAIL')",
        "('go', 'go', 1, 0, 1, 'PASS')",
        "('cargo', 'cargo', 5, 0, 1, 'PASS')",
        "('rspec', 'rspec', 2, 1, 2, 'FAIL')",
        "('junit', 'junit', 4, 1, 1, 'FAIL')",
        "('dotnet', 'dotnet', 3, 0, 1, 'PASS')",
        "('prose', NULL, NULL, NULL, NULL, 'ABSTAIN')",
        "('skipped', 'jest', 0, 0, 4, 'ABSTAIN')",
        "('crash', 'vitest', NULL, NULL, NULL, 'FAIL')",
        "('silent', 'vitest', NULL, NULL, NULL, 'ABSTAIN')",
        "('killed', 'jest', 3, 0, 0, 'FAIL')",
        "('nothing', 'pytest', NULL, NULL, NULL, 'ABSTAIN')",
    ),
)
def captured_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-52, FN-S11, FN-S26, UDX-03: runner, counts and verdict of test runs; no pass without a passed test and a clean exit."""
    d = spark.createDataFrame(list(_RUNS), "run string, command string, output string, code int").withColumn("runner", X.test_runner(F.col("command")))
    d = d.withColumn("n", X.test_counts(F.col("output"), F.col("runner")))
    return d.select("run", "runner", "n.passed", "n.failed", "n.skipped", X.capture_verdict(F.col("code"), F.col("n")).alias("verdict"))


@R.query(
    "shell_commands",
    rows_sql(
        "command, refused, words",
        "('npm test', NULL, 'npm,test')",
        "('vitest \"a|b\"', NULL, 'vitest,a|b')",
        "('echo $HOME', NULL, 'echo,$HOME')",
        "('a && b', '&', 'a,&&,b')",
        "('vitest *.ts', '*', 'vitest,*.ts')",
        "('(vitest)', '(', '(vitest)')",
        "('x $(y)', '$(', 'x,$(y)')",
        "('say ''it''\\''''s'' now', NULL, 'say,it''s,now')",
        "('p \"a \\\"q\\\" b\" c\\ d', NULL, 'p,a \"q\" b,c d')",
    ).replace("'x $(y)', '$('", "'x $(y)', '$('"),
)
def shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S22: what in a command would need a shell, and its words without quotes."""
    commands = ["npm test", 'vitest "a|b"', "echo $HOME", "a && b", "vitest *.ts", "(vitest)", "x $(y)", "say 'it'\\''s' now", 'p "a \\"q\\" b" c\\ d']
    d = spark.createDataFrame([(c,) for c in commands], "command string")
    return d.select("command", X.shell_refused(F.col("command")).alias("refused"), F.array_join(X.shell_tokens(F.col("command")), ",").alias("words"))


REPORT = """# Verify report
**Result:** PASS

## Contract Compliance
| ID | Says | Status | Evidence |
|----|------|--------|----------|
| A001 | reads the file | ✅ SATISFIED | test 1 |
| A002 | writes it | ❌ UNSATISFIED | |
| A003 | skips it | maybe |

## AC Walkthrough
- AC1 PASS with notes
- AC2: PARTIAL
  - AC3 FAIL
text PASS

## Findings
- **Code — Slow path:** src/a.ts:12 rereads `loadEverything()` on each call
  and again in `b.ts:3`
- **Test:** no case for an empty list

**Security:**
- **Token in log:** see lib/log.js
- **Old key** stays

1. **Upstream — Bump:** wait

## Notes
**Code:** not here
"""

BUILD = """# Build report
### A001: reads the file
**Instead:** reads a copy
**Reason:** locked
### A002: writes it
nothing
## Open Issues
1. **Cache:** grows in src/cache.ts
   without bound
- **Name** is odd
## Previous Findings Resolution
### Previously UNSATISFIED Assertions
| ID | Previous Issue | Current Status |
|----|---|---|
| A004 | too slow | fixed |
| A005 | wrong order | open |
"""


def _report(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "x string")


@R.query(
    "report_findings",
    rows_sql(
        "place, category, summary, file, anchor",
        "(0, 'code', 'Slow path: src/a.ts:12 rereads `loadEverything()` on each call and again in `b.ts:3`', 'src/a.ts', 'loadEverything()')",
        "(1, 'test', 'no case for an empty list', NULL, NULL)",
        "(2, 'security', 'Token in log: see lib/log.js', 'lib/log.js', NULL)",
        "(3, 'security', 'Old key stays', NULL, NULL)",
        "(4, 'upstream', 'Bump: wait', NULL, NULL)",
    ),
)
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S06: the findings of a report in all forms of list."""
    return _report(spark, REPORT).select(F.posexplode(reports.findings(F.col("x"))).alias("place", "f")).select("place", "f.*")


@R.query("report_compliance", rows_sql("id, says, status, evidence", "('A001', 'reads the file', 'SATISFIED', 'test 1')", "('A002', 'writes it', 'UNSATISFIED', '')", "('A003', 'skips it', 'UNKNOWN', '')"))
def report_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S08: the compliance table of a report."""
    return _report(spark, REPORT).select(F.explode(reports.compliance(F.col("x"))).alias("r")).select("r.*")


@R.query("report_verdict", rows_sql("result, headline, contradicted, total, met, partial", "('FAIL', 'PASS', 'A002', 3, 1, 1)"))
def report_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S09, AGG-41: a report's own table overrules its headline; results of its criteria."""
    v, c = reports.verdict(F.col("x")), reports.criteria_results(F.col("x"))
    return _report(spark, REPORT).select(v["result"].alias("result"), v["headline"].alias("headline"), F.array_join(v["contradicted"], ",").alias("contradicted"), c["total"].alias("total"), c["met"].alias("met"), c["partial"].alias("partial"))


@R.query("report_deviations", rows_sql("id, says, instead, reason, outcome", "('A001', 'reads the file', 'reads a copy', 'locked', NULL::VARCHAR)", "('A002', 'writes it', NULL, NULL, NULL)"))
def report_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S08: deviations of a build report."""
    return _report(spark, BUILD).select(F.explode(reports.deviations(F.col("x"))).alias("r")).select("r.*")


@R.query("report_issues", rows_sql("kind, id, summary, file", "('open', NULL, 'Cache: grows in src/cache.ts without bound', 'src/cache.ts')", "('open', NULL, 'Name is odd', NULL)", "('rejected', 'A004', 'too slow', NULL)", "('rejected', 'A005', 'wrong order', NULL)"))
def report_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S07: open issues of a build report, and the assertions that had failed before."""
    d = _report(spark, BUILD)
    a = d.select(F.lit("open").alias("kind"), F.lit(None).cast("string").alias("id"), F.explode(reports.open_issues(F.col("x"))).alias("r")).select("kind", "id", "r.summary", "r.file")
    b = d.select(F.lit("rejected").alias("kind"), F.explode(reports.rejections(F.col("x"))).alias("r")).select("kind", "r.id", "r.summary", F.lit(None).cast("string").alias("file"))
    return a.unionByName(b)


@R.query("scope_facts", rows_sql("place, summary, kind", "(0, 'Make it' || chr(10) || 'fast', 'fix')", "(1, NULL, NULL)"))
def scope_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S07: intent and kind of a scope."""
    d = spark.createDataFrame([(0, "# S\n## Intent\nMake it\nfast\n\nmore\n## Complexity\n**Kind:** Fix \n"), (1, "**Kind:** other\n")], "place int, x string")
    return d.select("place", reports.scope_summary(F.col("x")).alias("summary"), reports.scope_kind(F.col("x")).alias("kind"))


@R.query("independence_veto", rows_sql("item, veto", "('all four', true)", "('other role', false)", "('other claim', false)", "('kept', false)", "('judged', false)", "('old record', false)", "('none', false)"))
def independence_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S10: four conditions on one verdict of a record."""
    one = lambda role="verify", claim="c:read", status="violated", source="deterministic": [(role, [("x", "violated", "deterministic"), (claim, status, source)])]
    rows = [("all four", one()), ("other role", one(role="build")), ("other claim", one(claim="d")), ("kept", one(status="satisfied")), ("judged", one(source="model")), ("old record", one(source=None)), ("none", [])]
    d = spark.createDataFrame(rows, "item string, records array<struct<role:string,verdicts:array<struct<claim_id:string,status:string,source:string>>>>")
    return d.select("item", reports.vetoed(F.col("records"), "c:read").alias("veto"))


@R.query(
    "readme_sections",
    rows_sql("readme, section, text", "(0, 'description', 'A [tool](u) for `x`.')", "(0, 'setup', 'run it')", "(1, 'architecture', 'layers')", "(1, 'description', 'Opening words' || chr(10) || 'go on')"),
)
def readme_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-30: sections of a README by their heading; without a described one the opening paragraph."""
    texts = [(0, "# Tool\n![b](c)\n\n## About\n\n<b>A</b> [tool](u) for `x`.\n## Getting Started \nrun it\n### more\n## License\nno"), (1, "\n# T\n\nOpening words\ngo on\n\nnot this\n\n## Design\nlayers\n### More\n"), (2, "")]
    d = spark.createDataFrame(texts, "readme int, x string")
    cut = d.select("readme", F.explode(X.readme_sections(F.col("x"))).alias("section", "text"))
    return cut.select("readme", "section", F.regexp_replace("text", r"\n### (?s).*$", "").alias("text"))


@R.query("branch_names", rows_sql("subject, branch", "('Merge pull request #5 from me/feat/x', 'feat/x')", "('Merge branch ''dev'' into main', 'dev')", "('Merge remote-tracking branch ''origin/rel''', 'rel')", "('fix: y', NULL)"))
def branch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S15: the branch that a merge subject names."""
    d = spark.createDataFrame([("Merge pull request #5 from me/feat/x",), ("Merge branch 'dev' into main",), ("Merge remote-tracking branch 'origin/rel'",), ("fix: y",)], "subject string")
    return d.select("subject", X.branch_of_merge(F.col("subject")).alias("branch"))


@R.query("package_names", rows_sql("package, scope, name, kind", "('@s/p', 's', 'p', 'scoped')", "('react', NULL, 'react', 'external')", "('./a', NULL, './a', 'relative')", "('@/x', NULL, '@/x', 'alias')", "('node:fs', NULL, 'node:fs', 'builtin')"))
def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S02, FN-S20: scope and name of packages, and how a specifier names its module."""
    d = spark.createDataFrame([("@s/p",), ("react",), ("./a",), ("@/x",), ("node:fs",)], "package string")
    parts = X.package_parts(F.col("package"))
    return d.select("package", parts["scope"].alias("scope"), parts["name"].alias("name"), X.import_kind(F.col("package")).alias("kind"))


@R.query("name_styles", rows_sql("name, style", *[f"('{n}', '{s}')" for n, s in (("MAX_SIZE", "SCREAMING_SNAKE_CASE"), ("API", "SCREAMING_SNAKE_CASE"), ("max_size", "snake_case"), ("max-size", "kebab-case"), ("MaxSize", "PascalCase"), ("maxSize", "camelCase"), ("max", "lowercase"), ("_private", "lowercase"), ("__Init__", "PascalCase"), ("x", "unknown"), ("a_b-c", "unknown"), ("9lives", "unknown"), ("Max_Size", "unknown"), ("__", "unknown"), ("É_é", "unknown"))]))
def name_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-S01."""
    d = spark.createDataFrame([(n,) for n in ("MAX_SIZE", "API", "max_size", "max-size", "MaxSize", "maxSize", "max", "_private", "__Init__", "x", "a_b-c", "9lives", "Max_Size", "__", "É_é")], "name string")
    return d.select("name", X.naming_style(F.col("name")).alias("style"))


@R.query("water_levels", rows_sql("part, kept", "('a', 10)", "('b', 45)", "('c', 45)", "('d', NULL)"))
def water_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-13: parts share a cap, shorter ones first, and what they leave goes to the longer ones."""
    d = spark.createDataFrame([([("b", 80), ("a", 10), ("d", None), ("c", 300)],)], "parts array<struct<part:string,size:int>>")
    kept = S.water_levels(F.col("parts.size"), 100)
    return d.select(F.explode(F.arrays_zip(F.col("parts.part").alias("part"), kept.alias("kept"))).alias("x")).select("x.part", F.col("x.kept").cast("int").alias("kept"))


@R.query("orphans_and_duplicates", rows_sql("kind, a, b", "('orphan', 'C2', NULL)", "('orphan', 'C3', NULL)", "('duplicate', 'R1', 'R2')"))
def orphans_and_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-20, SET-03 on rows that have cases: claims without a work item; rules of one file that share more than half of the words of the shorter."""
    claims = spark.createDataFrame([("C1", "p", "a"), ("C2", "p", "b"), ("C3", "q", "a")], "id string, project string, slug string")
    items = spark.createDataFrame([("p", "a"), ("q", None)], "project string, slug string")
    orphans = claims.join(items, ["project", "slug"], "left_anti").select(F.lit("orphan").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    texts = [("R1", "x.ts", "never read the whole file"), ("R2", "x.ts", "read the file never"), ("R3", "x.ts", "log every write"), ("R4", "y.ts", "never read the whole file")]
    rules = spark.createDataFrame(texts, "id string, file string, summary string")
    hit = J.overlapping(rules, ["file"], "id", F.col("summary"), 0.5)
    return orphans.unionByName(hit.select(F.lit("duplicate").alias("kind"), "a", "b"))


@R.query("stage_minutes", rows_sql("item, build, verify", "('a', 50, 25)", "('b', 0, 10)", "('c', 5, 0)"))
def stage_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-42, WIN-09: a work item rejected once (30 + 20 minutes of building, 15 + 10 of verifying), one built for more than a day, one without a verify."""
    rows = [
        ("a", "contract", "01 10:00"), ("a", "build", "01 10:30"), ("a", "verify", "01 10:45"), ("a", "build", "01 11:05"), ("a", "verify", "01 11:15"),
        ("b", "contract", "01 10:00"), ("b", "build", "03 10:00"), ("b", "verify", "03 10:10"),
        ("c", "contract", "01 10:00"), ("c", "build", "01 10:05"), ("c", "verify", None),
    ]
    d = spark.createDataFrame(rows, "item string, kind string, t string").select("item", "kind", F.to_timestamp(F.concat(F.lit("2025-01-"), "t")).alias("at"))
    return S.alternating_minutes(d)


@R.query("merged_lines", rows_sql("place, line", "(1, 'dist')", "(2, '.env')", "(3, 'mine')", "(4, '# note')"))
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06: stock lines first, then the user's own in their order without those of the stock, each once, whatever blanks stand around."""
    stock = spark.createDataFrame([(0, "dist"), (1, ".env")], "i int, line string").withColumn("side", F.lit(0))
    user = spark.createDataFrame([(0, "mine"), (1, " dist "), (2, "# note"), (3, "mine"), (4, "")], "i int, line string").withColumn("side", F.lit(1))
    lines = stock.unionByName(user).withColumn("line", F.trim("line")).filter(F.col("line") != "")
    first = lines.groupBy("line").agg(F.min(F.struct("side", "i")).alias("at")).select(F.lit("file").alias("of"), "line", F.col("at.side").alias("side"), F.col("at.i").alias("i"))
    return J.numbered(first, ["of"], ["side", "i"], F.col("side"), "place").select(F.col("place").cast("int").alias("place"), "line")


@R.query("stored_verdicts", rows_sql("claim_id, says, status, reason, source", "('c1', 'reads only', 'violated', 'odd-reason', 'deterministic')", "('c2', '', 'satisfied', 'ok', NULL)"))
def stored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16: verdicts as they are stored: what a claim says is looked up, empty where it is not known; reasons stay as they are, a source stays absent."""
    verdicts = spark.createDataFrame([("c1", "violated", "odd-reason", "deterministic", 7), ("c2", "satisfied", "ok", None, 8)], "claimId string, status string, reason string, source string, extra int")
    says = spark.createDataFrame([({"c1": "reads only"},)], "says map<string,string>")  # one row
    return verdicts.crossJoin(F.broadcast(says)).select(F.col("claimId").alias("claim_id"), F.coalesce(F.try_element_at("says", "claimId"), F.lit("")).alias("says"), "status", "reason", "source")


@R.query(
    "error_envelopes",
    rows_sql("envelope", r"""('{"command":"proof close","error":{"code":"WRONG_BRANCH","message":"on \"main\"","branch":"main"},"meta":{"chain_runs":0,"active":0}}')""", """('{"command":"audit","results":{"n":2},"meta":{"chain_runs":3,"active":1}}')"""),
)
def error_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: a command's answer as JSON, its results or its error with the context, and the chain's health, zero without a chain."""
    rows = [("proof close", None, "WRONG_BRANCH", 'on "main"', "main", None, None), ("audit", 2, None, None, None, 3, 1)]
    d = spark.createDataFrame(rows, "command string, n int, code string, message string, branch string, runs int, active int")
    error = F.when(F.col("code").isNotNull(), F.struct("code", "message", "branch"))
    meta = F.struct(F.coalesce("runs", F.lit(0)).alias("chain_runs"), F.coalesce("active", F.lit(0)).alias("active"))
    return d.select(F.to_json(F.struct("command", F.when(F.col("code").isNull(), F.struct("n")).alias("results"), error.alias("error"), meta.alias("meta"))).alias("envelope"))
