import json

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import code, files, manifests


def names(spark, reader, text):
    return spark.createDataFrame([(text,)], "x string").select(reader(F.col("x"))).first()[0]


CASES = [
    (manifests.package_json, '{"dependencies": {"b": "1", "a": {"v": 1}}, "devDependencies": {"c": "2", "a": "1"}}', ["a", "b", "c"]),
    (manifests.package_lock, '{"packages": {"": {}, "node_modules/a": {}, "node_modules/a/node_modules/@s/b": {}}, "dependencies": {"c": {}}}', ["@s/b", "a", "c"]),
    (manifests.requirements_txt, "# c\nFlask==2\nrequests[x]>=1 ; python_version>'3'\n-r other\n\nflask\n", ["flask", "requests"]),
    (manifests.pyproject, '[project]\nname = "x"\ndependencies = [\n  "Flask>=2",\n  \'attrs\',\n]\n[project.optional-dependencies]\ndev = ["pytest"]\n[tool.poetry.dependencies]\npython = "^3"\nhttpx = "*"\n', ["attrs", "flask", "httpx", "pytest"]),
    (manifests.pipfile, '[packages]\nflask = "*"\n[dev-packages]\n"pytest" = "*"\n', ["flask", "pytest"]),
    (manifests.go_mod, "module m\nrequire github.com/a/b v1.0\nrequire (\n\tc.d/e v2 // indirect\n)\n", ["c.d/e", "github.com/a/b"]),
    (manifests.cargo_toml, '[package]\nname = "x"\n[dependencies]\nserde = "1"\n[dev-dependencies]\nproptest = "1"\n', ["proptest", "serde"]),
    (manifests.gemfile, "source 'x'\ngem 'rails', '~> 7'\n  gem \"pg\"\n# gem 'no'\n", ["pg", "rails"]),
    (manifests.composer_json, '{"require": {"php": "8", "ext-x": "*", "a/b": "1"}, "require-dev": {"c/d": "2"}}', ["a/b", "c/d"]),
]


@pytest.mark.parametrize(("reader", "text", "want"), CASES)
def test_manifests(spark, reader, text, want):
    assert names(spark, reader, text) == want
    assert names(spark, reader, "") == []
    assert names(spark, reader, None) is None
    assert names(spark, reader, "{broken") == [] or reader is manifests.requirements_txt


def test_dependencies_of_projects(spark):
    rows = [("p", "a/package.json", CASES[0][1]), ("p", "b/package.json", CASES[0][1]), ("q", "go.mod", CASES[5][1]), ("q", "x.txt", "y")]
    got = sorted(map(tuple, manifests.dependencies(spark.createDataFrame(rows, "project string, path string, text string")).collect()))
    assert got == [("p", "package.json", "a"), ("p", "package.json", "b"), ("p", "package.json", "c"), ("q", "go.mod", "c.d/e"), ("q", "go.mod", "github.com/a/b")]


def test_tree(spark, tmp_path):
    for p, t in (("src/a.py", "x = 1"), ("node_modules/b/c.py", "no"), ("deep/er/and/more/d.py", "é")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    tree = files.read_tree(spark, str(tmp_path), "*.py")
    assert sorted((r.name, r.text) for r in tree.collect()) == [("a.py", "x = 1"), ("d.py", "é")]
    rel = tree.withColumn("path", F.regexp_replace("path", f"^{tmp_path}/", ""))
    assert sorted(r.dir for r in files.directories(rel, 2).collect()) == ["deep", "deep/er", "src"]


def test_ledger_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"schema": 1, "entries": [{"slug": "a", "findings": [{"id": "F1", "line": 3}, {}]}, {"slug": "b", "timing": {"build": 4}}]}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "empty.json").write_text("{}")
    e = files.read_ledger(spark, str(tmp_path))
    assert sorted((r.entry_idx, r.slug) for r in e.collect()) == [(0, "a"), (1, "b")]
    assert [(r.entry_idx, r.f_idx, r.id) for r in files.entry_findings(e).orderBy("f_idx").collect()] == [(0, 0, "F1"), (0, 1, None)]


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"type": "user"}\nbroken\n\n{"type": "assistant", "requestId": "r", "message": {"usage": {"input_tokens": 5}}}\n')
    got = [(r.line_no, r.type, r.message and r.message.usage.input_tokens) for r in files.read_transcript(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [(0, "user", None), (3, "assistant", 5)]


def test_graph_guard(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": ["a"], "edges": [{"from": "a", "to": "b", "names": []}]}')
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.json"))
    assert (nodes.count(), edges.first()["to"]) == (1, "b")
    (tmp_path / "h.json").write_text('{"nodes": ["a"]}')
    assert files.read_graph(spark, str(tmp_path / "h.json")) is None


def test_front_matter(spark):
    texts = ["---\ntitle: \"A\"\npriority: high\n---\nbody\n", "no block", "---\ntitle: x\nnever closed", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", files.front_matter(F.col("x")).alias("m")).orderBy("i")
    a, b, c, d = (r.m for r in df.collect())
    assert (a.fields, a.body, a.malformed) == ({"title": "A", "priority": "high"}, "body\n", False)
    assert (b.fields, b.body, b.malformed) == (None, "no block", False)
    assert (c.fields, c.malformed) == (None, True)
    assert d.body is None


def test_parsing(spark):
    sources = [
        ("a.py", "import os\nfrom .x import y, z\n__all__ = ['f']\n@deco.rated(1)\nasync def f(): pass\ndef _g(): pass\nclass C(Base): pass\n"),
        ("b.ts", "import { a, b as c } from './x';\nimport 'side';\nexport async function go() {}\nexport const arrow = (x) => x;\nclass D extends E {}\nexport interface I {}\n@Injectable()\n"),
        ("c.go", 'package m\nimport (\n\t"fmt"\n\tx "a/b"\n)\nfunc Run() {}\nfunc (s *S) low() {}\ntype T struct {}\n'),
        ("d.py", "def broken(:"),
        ("e.rb", "x"),
        ("f.py", None),
    ]
    parsed = code.parse_files(spark.createDataFrame(sources, "path string, text string"))
    got = {r.path: r for r in parsed.collect()}
    assert set(got) == {"a.py", "b.ts", "c.go", "d.py", "f.py"}
    assert [(f.name, f["async"]) for f in got["a.py"].functions] == [("f", True), ("_g", False)]
    assert [(i.module, i.names) for i in got["a.py"].imports] == [("os", []), (".x", ["y", "z"])]
    assert [e.name for e in got["a.py"].exports] == ["f"]
    assert [d.name for d in got["a.py"].decorators] == ["deco.rated"]
    assert [(f.name, f["async"]) for f in got["b.ts"].functions] == [("go", True), ("arrow", False)]
    assert [i.module for i in got["b.ts"].imports] == ["./x", "side"]
    assert {e.name for e in got["b.ts"].exports} == {"go", "arrow", "I"}
    assert [(c.name, c.bases) for c in got["b.ts"].classes] == [("D", ["E"])]
    assert [i.module for i in got["c.go"].imports] == ["fmt", "a/b"]
    assert {e.name for e in got["c.go"].exports} == {"Run", "T"}
    assert (got["d.py"].errors, got["f.py"].errors) == (1, 0)
    assert {(r.name, r.exported) for r in code.symbols(parsed).filter("path = 'a.py'").collect()} == {("f", True), ("_g", False), ("C", False)}
