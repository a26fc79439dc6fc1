import pytest
from pyspark.sql import functions as F

from tallyforge.functions import numeric, paths
from tallyforge.functions import text as X


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(("name", "style"), [("MAX_SIZE", "SCREAMING_SNAKE_CASE"), ("max_size", "snake_case"), ("max-size", "kebab-case"), ("MaxSize", "PascalCase"), ("maxSize", "camelCase"), ("max", "lowercase"), ("MAX", "SCREAMING_SNAKE_CASE"), ("_x", "lowercase"), ("_max", "lowercase"), ("", "unknown"), (None, None)])
def test_styles(spark, name, style):
    assert one(spark, X.naming_style, name) == [style]


def test_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (-0.5, 0.5, 1.5, 2.4, None)], "x double")
    assert [r[0] for r in df.select(numeric.half_up(F.col("x"))).collect()] == [0, 1, 2, 2, None]
    assert [r[0] for r in spark.range(1).select(numeric.ratio(F.lit(1), F.lit(0)), numeric.half_up(F.lit(1.25), 1)).collect()] == [None]


def test_truncate(spark):
    assert one(spark, lambda c: X.truncate_words(c, 10), "short", "exactly 10", "one two three", "unbreakablelong", None) == ["short", "exactly 10", "one two...", "unbreakabl...", None]
    assert one(spark, lambda c: X.truncate_words(c, 9), "aaaa bbbb cccc", " aaaaaaaaaaaa") == ["aaaa bbbb...", " aaaaaaaa..."]  # the blank at the limit counts


def test_references_and_criteria(spark):
    assert one(spark, X.file_references, "see src/a.ts:3 and src/a.ts, http://x.y/z/w.js and b.md lib/b.py.", "none", None) == [["src/a.ts", "b.md"], [], None]
    text = "## AC1\n- ac2: x\n* **AC3** y\n  AC4) z\nsee **AC5:** and AC6"
    assert one(spark, X.criterion_ids, text, "about AC1 and AC-2", "") == [["AC1", "AC2", "AC3", "AC4", "AC5"], [], []]
    assert one(spark, X.criteria_unclear, text, "about AC1", "### Acceptance  Criteria\n- one", "nothing", "MAC3") == [False, True, True, False, False]


def test_markdown(spark):
    text = "# Title\n\n\n\n![i](u)[link](http://x) **bold** `code`\nmore <b>x</b> \n"
    assert one(spark, X.clean_markdown, text) == ["# Title\n\n[link](http://x) **bold** `code`\nmore x"]
    assert one(spark, X.first_paragraph, "# T\n\nOne\ntwo\n\nthree", "# only", "", "\n\nlead\n## next", "## H\nx", "x\n# y") == ["One\ntwo", "", "", "lead", "", "x"]


def test_versions(spark):
    assert one(spark, lambda c: X.version_at_least(c, 1, 1), "1.0", "1.1", "2", "v1.10", "x", None, " ") == [False, True, True, True, False, False, False]


def test_ages(spark):
    df = spark.createDataFrame([(x,) for x in (-5, 3599, 3600, 86_399, 86_400, 30 * 86_400 - 1, 30 * 86_400, None)], "x bigint")
    assert [r[0] for r in df.select(X.relative_age(F.col("x"))).collect()] == ["<1h", "<1h", "1h", "23h", "1d", "29d", "4w", None]


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.9, 0.895, 0.7, 0.5, 0.49, None)], "x double")
    assert [r[0] for r in df.select(X.confidence_band(F.col("x"))).collect()] == ["high", "moderate", "moderate", "low", "uncertain", None]


def test_runners_and_verdicts(spark):
    assert one(spark, X.test_runner, "npx vitest run", "python -m pytest -q", "go test ./...", "make") == ["vitest", "pytest", "go", None]
    rows = [("vitest", "Tests  3 failed | 12 passed", 1), ("vitest", "Tests  12 passed", 0), ("vitest", "Tests  12 passed", 1), ("vitest", "Segmentation fault", 1), ("vitest", "nothing", 0), (None, "12 passed", 0), ("jest", None, None)]
    out = spark.createDataFrame(rows, "r string, x string, code int")
    got = [r[0] for r in out.select(X.capture_verdict(F.col("code"), X.test_counts(F.col("x"), F.col("r")))).collect()]
    assert got == ["FAIL", "PASS", "FAIL", "FAIL", "ABSTAIN", "ABSTAIN", "FAIL"]


def test_seals(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", "")], "x string, y string").withColumn("s", X.seal(F.col("x"), F.col("y")))
    a, b = (r.s for r in df.collect())
    assert a != b
    states = df.select(X.seal_state(F.col("s"), F.lit(a)), X.seal_state(F.col("s"), F.lit(None).cast("string"))).collect()
    assert [tuple(r) for r in states] == [("INTACT", "UNVERIFIABLE"), ("TAMPERED", "UNVERIFIABLE")]


def test_branches_and_slugs(spark):
    assert one(spark, X.branch_of_merge, "Merge pull request #5 from me/feat/x", "Merge branch 'origin/dev' into y", "fix: z") == ["feat/x", "dev", None]
    assert one(spark, X.valid_slug, "a-b-1", "A", "-a", "a--b", "x" * 65) == [True, False, False, False, False]
    assert one(spark, X.shell_refused, "npm test", "a && b", "echo $X", 'vitest "a|b"', "(vitest)", "x '*", None) == [None, "&", None, None, "(", None, None]
    assert one(spark, X.shell_tokens, "A=1 run 'b c' \\\"d", "", None) == [["A=1", "run", "b c", '"d'], [], None]
    assert one(spark, lambda c: X.import_kind(c, "mypkg"), "./a", "@/x", "node:fs", "@s/p", "mypkg.sub", "react") == ["relative", "alias", "builtin", "scoped", "own", "external"]


def test_paths(spark):
    assert one(spark, paths.canonical_path, " ./a//b.ts\t", "a\\b.ts", "././x", ".", "  ", None, "../x") == ["a/b.ts", "a/b.ts", "x", None, None, None, "../x"]
    assert one(spark, paths.base_name, "a/b\\c.ts", "c.ts", "a/") == ["c.ts", "c.ts", ""]
    assert one(spark, paths.stem, "a/work.test.ts", "work.ts", "test_x.py") == ["work", "work", "x"]
    assert one(spark, paths.ancestors, "a/b/c.ts", "c.ts") == [["a", "a/b"], []]
    assert one(spark, paths.is_test_path, "tests/x.ts", "a.spec.js", "test_a.py", "latest/x.ts") == [True, True, True, False]


def test_sources_are_matched_in_every_spelling(spark, tmp_path):
    from tallyforge.plans.text import R

    sources = ["docs_page", "DOCS_PAGE", "docs-page", "Commit Note", "commit-note", "commit_note ", "other"]
    rows = [(i, "p", "s", s, "fix: a") for i, s in enumerate(sources)]
    spark.createDataFrame(rows, "doc_id bigint, project string, slug string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in R.queries["first_paragraphs"](spark, str(tmp_path)).collect()} == {0, 1, 2}
    assert R.queries["commit_styles"](spark, str(tmp_path)).first()["notes"] == 3
