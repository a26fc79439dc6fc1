"""Scans of empty and odd trees; the worked-out cases are queries of plans/scans.py."""

from pyspark.sql import functions as F

from tallyforge.functions.numeric import gcd
from tallyforge.operators import scan
from tallyforge.sources.code import parse_script

FILES = "project string, path string, text string"


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], FILES)
    assert scan.census(none).count() == scan.directories(none).count() == scan.route_validation(none).count() == scan.change_hygiene(none.withColumnRenamed("project", "item")).count() == 0
    assert scan.project_types(none.withColumnRenamed("path", "name")).count() == 0


def test_files_at_the_root_have_no_directory(spark):
    d = spark.createDataFrame([("p", "a.ts", None), ("p", "/b.ts", None), ("p", "x/node_modules/y/z.ts", None)], FILES)
    assert {r.dir for r in scan.directories(d).collect()} == {"", "x"}
    assert scan.census(d).first().source == 2


def test_rules_without_hints_and_ties(spark):
    rules = spark.createDataFrame([("c", "one", "x", 1, 0.9, None, "h", 0.5), ("c", "two", "y", 0, 0.9, None, None, None), ("d", "three", "x", 0, 0.9, "y", None, None)], "category string, name string, dependency string, rank int, confidence double, unless string, hint string, boost double")
    facts = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x"), ("q", "x"), ("r", None)], "project string, dependency string")
    assert sorted(tuple(r)[:4] for r in scan.best_by_rank(facts, rules).collect()) == [("p", "c", "two", 0.9), ("q", "c", "one", 0.9), ("q", "d", "three", 0.9)]
    hints = spark.createDataFrame([("q", "a/h"), ("q", "h"), ("p", "a/xh")], "project string, path string")
    assert {(r.project, r.confidence) for r in scan.best_by_rank(facts, rules, hints).collect() if r.category == "c"} == {("p", 0.9), ("q", 1.0)}


def test_gcd(spark):
    d = spark.createDataFrame([(8, 12), (0, 7), (7, 0), (0, 0), (-6, 4), (1_000_003, 999_983), (None, 3)], "a int, b int")
    assert [r[0] for r in d.select(gcd(F.col("a"), F.col("b"))).collect()][:6] == [4, 7, 7, 0, 2, 1]


def test_imports_in_comments_and_strings():
    text = "/* import a from 'a';\n*/ // require('b')\nconst s = \"import c from 'c'\";\nimport d, {\n  e as f,\n  type G,\n} from 'd';export * from './h';\n"
    assert [(i["module"], i["names"], i["line"]) for i in parse_script(text)["imports"]] == [("d", ["e", "G"], 4), ("./h", [], 7)]
