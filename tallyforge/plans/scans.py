"""Queries on what a project is: over literal trees with worked-out rows, and over the files that ledgers name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import scan
from tallyforge.operators.rules import rule_violations
from tallyforge.plans.samples import rows_sql, tree
from tallyforge.plans.views import CTE, modules
from tallyforge.registry import Registry
from tallyforge.sources import code, manifests

R = Registry()

_LISTING = (
    "src/a.ts", "src/a.test.ts", "src/deep/er/and/more/b.py", "src/types.d.ts", "tests/c.ts", "tests/data.json", "spec/d_spec.rb", "test_e.py", "f_test.go", "node_modules/x/y.ts", "dist/z.js",
    "package.json", "apps/web/package.json", "apps/web/tsconfig.build.json", "apps/web/page.tsx", ".env.local", "vitest.config.ts", "README.md", "src/dist/skipped.ts",
)


def _listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p", x, None) for x in _LISTING], "project string, path string, text string")


@R.query("tree_directories", rows_sql("dir", *[f"('{d}')" for d in ("src", "src/deep", "src/deep/er", "src/deep/er/and", "src/deep/er/and/more", "tests", "spec", "apps", "apps/web")]))
def tree_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: directories of a tree down to five levels, ignored ones and what is below them left out."""
    return scan.directories(_listing(spark)).select("dir")


@R.query("tree_census", rows_sql("project, source, test, config, total", "('p', 5, 5, 5, 15)"))
def tree_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: sources (a.ts, b.py, types.d.ts, page.tsx, vitest.config.ts), tests (a.test.ts, tests/c.ts, spec/d_spec.rb, test_e.py, f_test.go) and configuration of a tree."""
    c = scan.census(_listing(spark))
    return c.select("project", *[F.col(x).cast("int").alias(x) for x in ("source", "test", "config", "total")])


@R.query("tree_roots", rows_sql("root, files", "('.', 10)", "('apps/web', 1)", "('src', 4)", "('none', 0)"))
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: source files below each root, at any depth."""
    roots = spark.createDataFrame([("p", r) for r in (".", "apps/web", "src", "none")], "project string, root string")
    return scan.files_by_root(_listing(spark), roots).select("root", F.col("files").cast("int").alias("files"))


@R.query(
    "module_census",
    CTE
    + r""", q AS (SELECT DISTINCT project, file, regexp_extract(file, '([^/]*)$', 1) AS name, regexp_extract(file, '\.([A-Za-z0-9]+)$', 1) AS ext, array_to_string(string_split(file, '/')[:-2], '/') AS folder FROM t),
x AS (SELECT *, regexp_matches(name, '\.(test|spec)\.|^test_|_test\.') OR regexp_matches(folder, '(^|/)(tests?|__tests__|spec)(/|$)') AS apart,
  regexp_matches(name, '\.(test|spec)\.(ts|tsx|js|jsx)$|^test_.*\.py$|_test\.(py|go)$') OR (regexp_matches(folder, '(^|/)(tests?|__tests__)(/|$)') AND ext IN ('ts', 'tsx', 'js', 'jsx')) OR (regexp_matches(folder, '(^|/)tests?(/|$)') AND ext = 'py') OR (regexp_matches(folder, '(^|/)spec(/|$)') AND ext = 'rb') AS test
  FROM q WHERE NOT regexp_matches(folder, '(^|/)(node_modules|\.git|dist|build|out|vendor|target|coverage|tmp|\.cache)(/|$)'))
SELECT project, count(*) FILTER (NOT apart AND ext IN ('ts', 'tsx', 'js', 'jsx', 'py', 'go', 'rs', 'rb', 'php', 'java', 'kt', 'swift', 'c', 'cpp', 'h', 'cs')) AS source, count(*) FILTER (test) AS test FROM x GROUP BY project
""",
)
def module_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03 over all files that the ledgers name."""
    return scan.census(modules(spark, sf_dir).select("project", F.col("file").alias("path")).distinct()).select("project", "source", "test")


_MANAGED = (
    ("a", "pnpm-lock.yaml", None), ("a", "package.json", "{}"), ("a", "apps/web/package.json", '{"packageManager": "bun@1.0"}'), ("a", "apps/web/package-lock.json", None),
    ("b", "package.json", '{"packageManager": "yarn@4.1"}'), ("c", "package.json", '{"packageManager": "other@1"}'), ("d", "go.mod", ""), ("e", "yarn.lock", None), ("e", "package-lock.json", None),
)


@R.query("managers", rows_sql("project, folder, manager", "('a', '', 'pnpm')", "('a', 'apps/web', 'npm')", "('a', 'apps/api', 'pnpm')", "('a', 'v/w/x/y/z', NULL)", "('b', '', 'yarn')", "('c', '', 'npm')", "('d', '', NULL)", "('e', '', 'yarn')"))
def managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-02: the package manager of a directory by the nearest lock file above, then by declaration."""
    files = spark.createDataFrame(list(_MANAGED), "project string, path string, text string")
    start = spark.createDataFrame([("a", ""), ("a", "apps/web"), ("a", "apps/api"), ("a", "v/w/x/y/z"), ("b", ""), ("c", ""), ("d", ""), ("e", "")], "project string, folder string")
    return scan.package_managers(files, start)


_TYPED = (
    ("plain", "package.json", "{}"), ("plain", "yarn.lock", ""), ("bare", "package.json", "{}"), ("mono", "package.json", '{"workspaces": ["a"]}'), ("mono", "Cargo.toml", "[workspace]"),
    ("py", "package.json", "{}"), ("py", "package-lock.json", ""), ("py", "pyproject.toml", '[project]\ndependencies = ["flask"]\n'), ("pytools", "package.json", "{}"), ("pytools", "yarn.lock", ""), ("pytools", "pyproject.toml", "[tool.ruff]\n"),
    ("poetry", "package.json", "{}"), ("poetry", "pyproject.toml", '[tool.poetry.dependencies]\npython = "^3"\nrich = "*"\n'), ("rust", "package.json", "{}"), ("rust", "Cargo.toml", "[workspace]\n"),
    ("tauri", "package.json", "{}"), ("tauri", "Cargo.toml", '[workspace]\n[workspace.dependencies]\ntauri = "2"\n'), ("tauri", "pnpm-workspace.yaml", ""), ("rails", "package.json", '{"workspaces": []}'), ("rails", "Gemfile", ""), ("rails", "yarn.lock", ""),
    ("gonode", "package.json", "{}"), ("gonode", "go.mod", ""), ("go", "go.mod", ""), ("crate", "Cargo.toml", "[package]"), ("php", "composer.json", "{}"), ("setup", "setup.py", ""), ("none", "README.md", ""),
)


@R.query(
    "project_types",
    rows_sql(
        "project, type, confidence",
        *[f"('{p}', '{t}', {c}::DOUBLE)" for p, t, c in (("plain", "node", 0.95), ("bare", "node", 0.7), ("mono", "node", 0.9), ("py", "python", 0.9), ("pytools", "node", 0.95), ("poetry", "python", 0.85), ("rust", "rust", 0.85), ("tauri", "node", 0.8), ("rails", "ruby", 0.9), ("gonode", "go", 0.85), ("go", "go", 0.95), ("crate", "rust", 0.95), ("php", "php", 0.9), ("setup", "python", 0.85), ("none", "unknown", 0.0))],
    ),
)
def project_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-01: the language of a project by what stands at its root, also beside a Node manifest."""
    return scan.project_types(spark.createDataFrame(list(_TYPED), "project string, name string, text string"))


#: Fixed values (category, name, dependency, rank, confidence, unless, hint, boost): frameworks and libraries by dependency.
RULES = (
    ("framework", "nextjs", "next", 0, 0.85, None, "next.config.js", 0.1),
    ("framework", "nestjs", "@nestjs/core", 2, 0.9, None, "src/main.ts", 0.05),
    ("framework", "express", "express", 3, 0.8, "@nestjs/core", "server.js", 0.1),
    # architectures before providers
    *[("ai", name, package, i, 0.8, None, None, None) for i, (package, name) in enumerate((("ai", "Vercel AI"), ("@ai-sdk/core", "Vercel AI"), ("langchain", "LangChain"), ("@langchain/core", "LangChain"), ("@anthropic-ai/sdk", "Anthropic"), ("openai", "OpenAI"), ("@google/generative-ai", "Google AI"), ("@ai-sdk/anthropic", "Vercel AI"), ("@ai-sdk/openai", "Vercel AI"), ("@ai-sdk/google", "Vercel AI"), ("@ai-sdk/mistral", "Vercel AI")))],
    ("validation", "pydantic", "pydantic", 0, 0.75, None, None, None),
    ("validation", "zod", "zod", 1, 0.75, None, None, None),
    ("validation", "joi", "joi", 2, 0.75, None, None, None),
    ("validation", "class-validator", "class-validator", 3, 0.75, None, None, None),
    ("validation", "drf-serializers", "djangorestframework", 4, 0.8, None, None, None),
    ("validation", "yup", "yup", 6, 0.75, None, None, None),
    ("validation", "ajv", "ajv", 7, 0.75, None, None, None),
    ("validation", "validator", "validator", 8, 0.7, None, None, None),
    ("validation", "superstruct", "superstruct", 9, 0.75, None, None, None),
    ("validation", "valibot", "valibot", 10, 0.75, None, None, None),
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "category string, name string, dependency string, rank int, confidence double, unless string, hint string, boost double")


@R.query(
    "detected_libraries",
    rows_sql(
        "project, category, name, confidence, dependency",
        "('a', 'framework', 'nextjs', 0.95::DOUBLE, 'next')",
        "('a', 'validation', 'zod', 0.75, 'zod')",
        "('a', 'ai', 'LangChain', 0.8, 'langchain')",
        "('b', 'framework', 'nestjs', 0.9, '@nestjs/core')",
        "('b', 'validation', 'class-validator', 0.75, 'class-validator')",
        "('c', 'framework', 'express', 0.9, 'express')",
        "('web', 'validation', 'zod', 0.75, 'zod')",
    ),
)
def detected_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-03, CLS-08, UDX-02: frameworks and validators by the first rule of each category that holds, with its confidence; manifests feed it."""
    facts = spark.createDataFrame([("a", "next"), ("a", "react"), ("a", "joi"), ("a", "zod"), ("a", "openai"), ("a", "langchain"), ("b", "express"), ("b", "@nestjs/core"), ("b", "class-validator"), ("c", "express"), ("d", "left-pad")], "project string, dependency string")
    own = manifests.dependencies(tree(spark)).select("project", F.col("name").alias("dependency"))
    hints = spark.createDataFrame([("a", "apps/web/next.config.js"), ("c", "server.js")], "project string, path string")
    return scan.best_by_rank(facts.unionByName(own), rules(spark), hints)


@R.query("import_styles", rows_sql("project, style, confidence, absolute, relative", "('web', 'relative', 0.875::DOUBLE, 1, 7)", "('api', 'relative', 1.0, 0, 1)", "('svc', 'mixed', 0.0, 0, 0)", "('lib', 'absolute', 0.75, 3, 1)"))
def import_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: how a project names its own modules, from parsed imports; packages do not count."""
    t = tree(spark)
    parsed = code.parse_files(t.select("path", "text")).join(t.select("path", "project"), "path")
    imports = parsed.select("project", "language", F.explode("imports.module").alias("module"))
    more = spark.createDataFrame([("lib", "python", "lib.a"), ("lib", "python", "lib"), ("lib", "python", "lib.b.c"), ("lib", "python", ".d"), ("lib", "python", "library"), ("lib", "python", "os")], "project string, language string, module string")
    roots = spark.createDataFrame([("web", "typescript", "@/"), ("lib", "python", "lib"), ("svc", "go", "example.com/svc")], "project string, language string, prefix string")
    out = scan.import_style(imports.unionByName(more), roots)
    return out.select("project", "style", "confidence", F.col("absolute").cast("int").alias("absolute"), F.col("relative").cast("int").alias("relative"))


_CODE = (
    ("p", "a.ts", "import fs from 'fs';\nimport x from './x.js';\nimport y from \"./y\";\nconst p = require('node:path');\ntry { a() } catch (e) { }\ntry { b() } catch { // nothing\n }\nexport default 1;\nlet v: string | null;\ntype T = { a ?: string; b?: number; c?: X; d?: Y };\n", False),
    ("p", "a.test.ts", "try { a() } catch (e) {}\nimport z from '../z.tsx';\n", True),
    ("q", "b.ts", "import react from 'react';\nlet a: A | null = null; let b: B | null;\ntry { } catch (e) { log(e) }\n", False),
)


@R.query("code_habits", rows_sql("project, files, with_ext, local, prefixed, builtin, empty, commented, defaults, absence", "('p', 2, 2, 3, 1, 2, 1, 1, 1, 'undefined')", "('q', 1, 0, 0, 0, 0, 0, 0, 0, 'null')"))
def code_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: ratios of code patterns in whole files."""
    out = scan.code_patterns(spark.createDataFrame(list(_CODE), "project string, path string, text string, is_test boolean"))
    return out.select("project", *[F.col(c).cast("int").alias(c) for c in out.columns[1:-1]], "absence")


@R.query("library_variants", rows_sql("project, variant, files, confidence, main", "('a', 'async', 2, 0.9::DOUBLE, true)", "('a', 'sync', 2, 0.8, false)", "('b', 'sync', 5, 0.85, true)", "('b', 'async', 1, 0.9, false)"))
def library_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25, AGG-26: two variants of a library; most files decide, a tie goes to the asynchronous one, files with both count once."""
    a, s = ("sqlalchemy.ext.asyncio", ["AsyncSession"]), ("sqlalchemy.orm", ["Session", "relationship"])
    rows = [("a", "1.py", *a), ("a", "2.py", *a), ("a", "2.py", *s), ("a", "3.py", *s), ("a", "4.py", "sqlalchemy.orm", ["sessionmaker"]), ("a", "5.py", "sqlalchemy.orm", ["relationship"]), ("b", "x.py", *a)] + [("b", f"{i}.py", *s) for i in range(5)]
    imports = spark.createDataFrame(rows, "project string, path string, module string, names array<string>")
    two = [("sqlalchemy", "async", "sqlalchemy.ext.asyncio", ["AsyncSession", "create_async_engine"], 0.8, None, 0), ("sqlalchemy", "sync", "sqlalchemy.orm", ["Session", "sessionmaker"], 0.7, "sqlalchemy.ext.asyncio", 1)]
    out = scan.variants(imports, spark.createDataFrame(two, "name string, variant string, module string, symbols array<string>, base double, excludes string, rank int"))
    return out.select("project", "variant", F.col("files").cast("int").alias("files"), "confidence", "main")


@R.query("hook_dominance", rows_sql("hook, users, state", "('useQuery', 3, 'dominant')", "('useSWR', 1, 'present')", "('useForm', 0, 'incidental')"))
def hook_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: how many of ten component files use a hook."""
    d = spark.createDataFrame([("useQuery", 3), ("useSWR", 1), ("useForm", 0)], "hook string, users int")
    return d.select("hook", "users", scan.dominance(F.col("users"), F.lit(10)).alias("state"))


_ROOTS = (
    ("p1", "shop", "apps/web", "web", 40, True), ("p1", "shop", "apps/docs", "docs-site", 90, False), ("p1", "shop", "packages/shop", "shop", 500, False),
    ("p2", "trpc", "packages/server", "@trpc/server", 200, False), ("p2", "trpc", "packages/next", "@trpc/next", 300, False), ("p2", "trpc", "examples/big", "big", 900, False),
    ("p3", "tool", "packages/tool", "tool", 9, False), ("p3", "tool", "packages/@x", "@x/tool", 50, False), ("p3", "tool", "packages/rest", "rest", 60, False),
    ("p4", "zed", "a", "@zed/zed", 20, False), ("p4", "zed", "b", "zed", 12, False), ("p4", "zed", "c", "other", 400, False),
    ("p5", "only", "examples/x", "x", 3, False), ("p5", "only", "tests/y", "y", 5, False),
)


@R.query("primary_root_choice", rows_sql("project, root", "('p1', 'apps/web')", "('p2', 'packages/server')", "('p3', 'packages/rest')", "('p4', 'c')", "('p5', 'tests/y')"))
def primary_root_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14: the primary root: a framework's app, a name match that passes the guard, or the most files; asides only if nothing else is there.

    p3: the plain name match has nine files and fails the guard, the scoped one does not step in. p4: twelve files are less than a twentieth of 400.
    """
    return scan.primary_roots(spark.createDataFrame(list(_ROOTS), "project string, name string, root string, package string, files int, hinted boolean"))


@R.query("change_hygiene", rows_sql("item, rule, file", "('a', 'lock without manifest', 'web/yarn.lock')", "('a', 'conflict mark', 'src/x.ts')", "('b', 'environment file', 'api/.env.local')"))
def change_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-47: a lock file changed without its manifest, conflict marks at the start of a line, environment files but examples."""
    rows = [("a", "web/yarn.lock", ""), ("a", "src/x.ts", "a\n<<<<<<< HEAD\nb"), ("a", "src/y.ts", "a <<<<<<< b\n ======="), ("b", "go.sum", ""), ("b", "go.mod", ""), ("b", "api/.env.local", None), ("b", ".env.example", ""), ("b", "x.env", "")]
    return scan.change_hygiene(spark.createDataFrame(rows, "item string, path string, text string"))


@R.query(
    "lock_desync",
    CTE
    + """, l AS (SELECT entry_idx, file, CASE WHEN ends_with(file, 'pnpm-lock.yaml') OR ends_with(file, 'package-lock.json') OR ends_with(file, 'yarn.lock') THEN 'package.json' WHEN ends_with(file, 'Cargo.lock') THEN 'Cargo.toml' WHEN ends_with(file, 'go.sum') THEN 'go.mod' WHEN ends_with(file, 'poetry.lock') THEN 'pyproject.toml' END AS m FROM t),
h AS (SELECT entry_idx, count(*) FILTER (m IS NOT NULL) AS locks, count(*) FILTER (ends_with(file, 'package.json')) AS manifests FROM l GROUP BY entry_idx)
SELECT h.entry_idx, locks > 0 AS locked, manifests > 0 AS manifest, locks > 0 AND EXISTS (SELECT 1 FROM l WHERE l.entry_idx = h.entry_idx AND l.m IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l k WHERE k.entry_idx = l.entry_idx AND ends_with(k.file, l.m))) AS desync FROM h
""",
)
def lock_desync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-47 over all entries: whether each touches lock files, manifests, and a lock file without its manifest."""
    t = modules(spark, sf_dir).select(F.col("entry_idx").alias("item"), F.col("file").alias("path"), F.lit(None).cast("string").alias("text"))
    off = scan.change_hygiene(t).filter(F.col("rule") == "lock without manifest").select(F.col("item").alias("o_i")).distinct()
    lock = F.lit(False)
    for name, _ in scan.LOCK_OF:
        lock = lock | F.col("path").endswith(name)
    per = t.groupBy("item").agg(F.bool_or(lock).alias("locked"), F.bool_or(F.col("path").endswith("package.json")).alias("manifest"))
    return per.join(off, F.col("item") == F.col("o_i"), "left").select(F.col("item").alias("entry_idx"), "locked", "manifest", F.col("o_i").isNotNull().alias("desync"))


@R.query("commit_habits", rows_sql("project, conventional, strategy, confidence, co_author", "('a', 0.67::DOUBLE, 'mixed', 0.5::DOUBLE, 'Bo <b@x>')", "('b', 0.0, 'merge', 0.8, NULL)", "('c', 1.0, 'squash', 0.7, 'Al <a@x>')"))
def commit_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-32: conventional subjects, merge strategy and the commonest co-author, the first seen of equals."""
    rows = [("a", 0, "feat(x): y", "t\nCo-authored-by: Al <a@x>\nCo-authored-by: Bo <b@x>", False), ("a", 1, "fix!: z", "Co-authored-by: Bo <b@x>", False), ("a", 2, "Merge branch 'x'", "", True)]
    rows += [("b", i, "Merge pull request", "", True) for i in range(16)] + [("c", 0, "docs: a", "Co-authored-by: Al <a@x>", False), ("c", 1, "", "Co-authored-by: Bo <b@x>", False)]
    return scan.commit_habits(spark.createDataFrame(rows, "project string, place int, subject string, body string, is_merge boolean"))


@R.query(
    "application_shapes",
    rows_sql("project, shape", *[f"('{p}', '{s}')" for p, s in (("mcp", "mcp-server"), ("mcpweb", "web-app"), ("agent", "ai-agent"), ("mobile", "mobile-app"), ("worker", "worker"), ("api", "api-server"), ("full", "full-stack"), ("cli", "cli"), ("lib", "library"), ("none", "unknown"), ("dj", "full-stack"), ("rs", "unknown"))]),
)
def application_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-04: what kind of application a project is."""
    projects = [("mcp", "node", None, False, True), ("mcpweb", "node", "nextjs", False, False), ("agent", "node", None, True, False), ("mobile", "node", "react", False, False), ("worker", "node", None, False, False), ("api", "node", "express", False, False), ("full", "node", "express", False, False), ("cli", None, None, True, True), ("lib", "node", None, False, True), ("none", "node", None, False, False), ("dj", "python", "django", True, False), ("rs", "rust", None, True, False)]
    deps = [("mcp", "@modelcontextprotocol/sdk"), ("mcpweb", "@modelcontextprotocol/sdk"), ("agent", "langchain"), ("mobile", "expo"), ("worker", "bullmq"), ("api", "bullmq"), ("full", "next"), ("lib", "lodash")]
    return scan.application_shapes(spark.createDataFrame(projects, "project string, type string, framework string, has_bin boolean, has_main boolean"), spark.createDataFrame(deps, "project string, dependency string"))


@R.query(
    "architectures",
    rows_sql("project, architecture, confidence", *[f"('{p}', '{a}', {c}::DOUBLE)" for p, a, c in (("a", "microservices", 0.9), ("b", "microservices", 0.85), ("c", "domain-driven", 0.8), ("d", "layered", 0.95), ("e", "layered", 0.7), ("f", "library", 0.9), ("g", "monolith", 0.7), ("h", "domain-driven", 0.85), ("i", "monolith", 0.7))]),
)
def architectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-05: the first architecture that a project's directories fit."""
    projects = [("a", "node", None, True), ("b", "go", None, True), ("c", "node", None, True), ("d", "python", None, True), ("e", "python", None, True), ("f", "node", None, False), ("g", "node", None, True), ("h", "node", "NestJS", True), ("i", "node", None, False)]
    dirs = [("a", "services/x"), ("a", "services/y"), ("a", "models"), ("b", "cmd/x"), ("b", "cmd/y"), ("c", "features/a"), ("c", "modules/b"), ("d", "app/models"), ("d", "app/services"), ("d", "app/routes"), ("e", "src/controllers"), ("f", "lib"), ("g", "lib"), ("h", "src/modules/a"), ("h", "src/modules/b")]
    return scan.architectures(spark.createDataFrame(projects, "project string, type string, framework string, has_entry boolean"), spark.createDataFrame(dirs, "project string, dir string"))


_SITE = (
    ("a", "app/api/users/route.ts", "import { z } from 'zod';\n"), ("a", "app/api/route.js", "const s = require('./schemas/user')\n"), ("a", "app/api/x/route.tsx", "\n" * 31 + "import zod from 'zod'"), ("a", "pages/api/old.ts", "// zod\nexport default h"), ("a", "examples/app/api/z/route.ts", "import 'zod'"), ("a", "app/route.ts", ""),
    ("a", "app/page.tsx", ""), ("a", "app/error.tsx", ""), ("a", ".env", ""), ("a", ".env.example", ""), ("a", ".gitignore", "node_modules\n.env*\n"),
    ("b", "app/page.tsx", ""), ("b", "app/x/page.jsx", ""), ("b", "e2e/app/error.tsx", ""), ("b", ".env.local", ""), ("b", ".gitignore", "dist\n"), ("c", "x.py", None),
)


@R.query("route_checks", rows_sql("project, routes, validated", "('a', 4, 2)"))
def route_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-45: route files whose first thirty lines import a validator."""
    out = scan.route_validation(spark.createDataFrame(list(_SITE), "project string, path string, text string"))
    return out.select("project", F.col("routes").cast("int").alias("routes"), F.col("validated").cast("int").alias("validated"))


@R.query("boundary_checks", rows_sql("project, pages, error_pages, env_state", "('a', 1, 1, 'clean')", "('b', 2, 0, 'no example, not ignored')", "('c', 0, 0, 'none')"))
def boundary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-46: error pages beside pages, and how a project keeps its environment files."""
    out = scan.boundaries(spark.createDataFrame(list(_SITE), "project string, path string, text string"))
    return out.select("project", F.col("pages").cast("int").alias("pages"), F.col("error_pages").cast("int").alias("error_pages"), "env_state")


@R.query("scan_freshness", rows_sql("project, age_days, commits, stale", "('a', 8, 51, true)", "('b', 8, 50, false)", "('c', 7, 99, false)", "('d', 8, NULL, true)"))
def scan_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-53: both thresholds must be passed; the age decides alone where commits are unknown."""
    rows = [("a", "2025-01-01 00:00:00", "2025-01-09 01:00:00", 51), ("b", "2025-01-01 00:00:00", "2025-01-09 01:00:00", 50), ("c", "2025-01-01 02:00:00", "2025-01-09 01:00:00", 99), ("d", "2025-01-01 00:00:00", "2025-01-09 01:00:00", None), ("e", None, "2025-01-09 01:00:00", 99)]
    d = spark.createDataFrame(rows, "project string, s string, n string, commits int").select("project", F.to_timestamp("s").alias("scanned_at"), F.to_timestamp("n").alias("now"), "commits")
    return scan.freshness(d).select("project", F.col("age_days").cast("int").alias("age_days"), "commits", "stale")


@R.query(
    "detected_surfaces",
    rows_sql("root, name, signal", "('packages/cli', 'cli', 1)", "('apps/web', 'apps-web', 2)", "('apps/Big_App.v2', 'big-appv2', 2)", "('sites/web', 'sites-web', 3)", "('services/api/v2', 'api-v2', 4)"),
)
def detected_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-07: surfaces by the first of four signals, with names that tell them apart."""
    rows = [
        (".", 900, True, False, ["dev"], [], ["next.config.js"]),
        ("packages/cli", 9, True, False, ["dev"], [], []),
        ("packages/tiny", 4, True, False, ["dev"], [], []),
        ("apps/web", 10, False, False, [], [], ["next.config.ts"]),
        ("apps/Big_App.v2", 51, False, False, [], [], []),
        ("apps/small", 50, False, False, [], [], []),
        ("sites/web", 8, False, False, [], [], ["astro.config.mjs"]),
        ("packages/ui", 80, False, True, ["dev"], [], ["vite.config.ts"]),
        ("services/api/v2", 15, False, False, ["start:dev"], ["express"], []),
        ("services/few", 14, False, False, ["dev"], ["express"], []),
        ("packages/tsconfig", 99, True, False, ["dev"], [], []),
        ("examples/web", 99, True, False, ["dev"], [], []),
    ]
    d = spark.createDataFrame([("p", *r) for r in rows], "project string, root string, files int, has_bin boolean, is_library boolean, scripts array<string>, deps array<string>, configs array<string>")
    return scan.surfaces(d).select("root", "name", "signal")


@R.query("ui_systems", rows_sql("project, ui", "('a', 'shadcn/ui (Tailwind)')", "('b', 'Tailwind CSS')"))
def ui_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-09: the UI system by its signature of packages."""
    three = ("tailwindcss", "class-variance-authority", "tailwind-merge")
    rows = [("a", d) for d in (*three, "@radix-ui/react-dialog")] + [("b", d) for d in three] + [("c", "@radix-ui/react-dialog"), ("c", "tailwind-merge")]
    return scan.ui_systems(spark.createDataFrame(rows, "project string, dependency string"))


@R.query("testing_elsewhere", rows_sql("project, testing", "('py', 'pytest')", "('go', 'Go testing')", "('rb', 'RSpec')", "('rb', 'Minitest')", "('rs', 'Cargo test')"))
def testing_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-09: test frameworks of other languages."""
    projects = spark.createDataFrame([("py", "python"), ("py2", "python"), ("go", "go"), ("rb", "ruby"), ("rs", "rust"), ("js", "node")], "project string, type string")
    facts = spark.createDataFrame([("py", "pytest"), ("js", "pytest"), ("py2", "flask")], "project string, dependency string")
    files = spark.createDataFrame([("rb", ".rspec"), ("rb", "test/a_test.rb"), ("rb", "test/b_test.rb"), ("js", "test/x.js")], "project string, path string")
    return scan.testing_elsewhere(projects, facts, files)


@R.query("deployments", rows_sql("project, platform, path", "('a', 'vercel', 'apps/web/vercel.json')", "('b', 'fly', 'fly.toml')"))
def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-10: the platform of the primary root, else the first that was found."""
    rows = [("a", 0, "docker", "Dockerfile", ".", "apps/web"), ("a", 1, "vercel", "apps/web/vercel.json", "apps/web", "apps/web"), ("b", 0, "fly", "fly.toml", ".", None), ("b", 1, "docker", "x/Dockerfile", "x", None)]
    return scan.deployments(spark.createDataFrame(rows, "project string, place int, platform string, path string, root string, primary string"))


@R.query("blind_spots", rows_sql("project, violation", "('a', 'no repository')", "('a', 'no tests')", "('b', 'environment file not ignored')", "('b', 'tests of an unknown runner')", "('c', 'no analysis')"))
def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-11, UDX-01: what a scan cannot see, by a registry of rules."""
    rows = [("a", None, False, False, 0, 0, None), ("b", "f00", True, False, 0, 4, None), ("c", "f00", True, True, 1, 0, "timeout"), ("d", "f00", False, False, 2, 9, None)]
    d = spark.createDataFrame(rows, "project string, head string, env boolean, env_ignored boolean, runners int, test_files int, failure string")
    return rule_violations(d, "project", scan.BLIND_SPOTS)


@R.query(
    "symbol_names",
    rows_sql(
        "project, kind, sample, majority, share, confidence, mixed",
        "('p', 'function', 6, 'snake_case', 0.75::DOUBLE, 0.3333::DOUBLE, false)",
        "('p', 'class', 2, 'PascalCase', 1.0, 0.2857, false)",
        "('q', 'function', 4, 'snake_case', 0.5, 0.1429, true)",
        "('q', 'class', 2, NULL, NULL, 0.0, true)",
    ),
)
def symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, FLT-10: naming styles of functions and classes; keywords, demanded names and lower-case words do not vote, equals go by the order of styles."""
    rows = [("p", "function", "python", n) for n in ("load_file", "save_file", "read_all", "doIt", "run", "lambda")] + [("p", "class", "python", n) for n in ("Reader", "FileStore")]
    rows += [("q", "function", "typescript", n) for n in ("toString", "get_one", "getTwo", "constructor")] + [("q", "class", "go", n) for n in ("x", "range")]
    out = scan.naming_votes(spark.createDataFrame(rows, "project string, kind string, language string, name string"), ["project", "kind"])
    return out.withColumn("sample", F.col("sample").cast("int"))


_WORKSPACE = (
    ("m", "package.json", '{"name": "mono", "workspaces": ["apps/*", "./packages/**"], "scripts": {"build": "x"}}'),
    ("m", "apps/web/package.json", '{"name": "@m/web", "scripts": {"dev": "next", "build": "x"}, "dependencies": {"next": "14", "react": "18"}}'),
    ("m", "apps/web/next.config.js", ""), ("m", "apps/web/src/a.ts", ""), ("m", "apps/web/src/b.tsx", ""),
    ("m", "packages/tools/cli/package.json", '{"name": "cli", "bin": {"cli": "x.js"}, "scripts": {"dev": "tsx"}, "peerDependencies": {"zod": "3"}}'),
    *[("m", f"packages/tools/cli/src/{i}.ts", "") for i in range(6)],
    ("m", "packages/lib/package.json", '{"name": "lib", "exports": "./x.js"}'), ("m", "packages/broken/package.json", "{"), ("m", "other/package.json", "{}"), ("m", "apps/web/deep/package.json", "{}"), ("m", "node_modules/z/package.json", "{}"),
    ("n", "package.json", '{"name": "one", "main": "i.js"}'), ("n", "sub/package.json", "{}"), ("n", "sub/x.js", ""),
)


@R.query(
    "workspace_packages",
    rows_sql(
        "project, root, package, files, has_bin, is_library, scripts, deps, configs",
        "('m', '.', 'mono', 9, false, false, 'build', '', '')",
        "('m', 'apps/web', '@m/web', 3, false, false, 'build,dev', 'next,react', 'next.config.js')",
        "('m', 'packages/tools/cli', 'cli', 6, true, false, 'dev', 'zod', '')",
        "('m', 'packages/lib', 'lib', 0, false, true, '', '', '')",
        "('n', '.', 'one', 1, false, true, '', '', '')",
        "('n', 'sub', NULL, 1, false, false, '', '', '')",
    ),
)
def workspace_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: the packages of a repository by the patterns of its top manifest, each with its sources, scripts and dependencies."""
    w = scan.workspaces(spark.createDataFrame(list(_WORKSPACE), "project string, path string, text string"))
    return w.select("project", "root", "package", "files", "has_bin", "is_library", *[F.array_join(c, ",").alias(c) for c in ("scripts", "deps", "configs")])


@R.query("workspace_surfaces", rows_sql("root, name, signal", "('packages/tools/cli', 'cli', 1)"))
def workspace_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05, CLS-07: the surfaces among the packages of a repository; the web app has too few sources."""
    return scan.surfaces(scan.workspaces(spark.createDataFrame(list(_WORKSPACE), "project string, path string, text string"))).select("root", "name", "signal")


_PURPOSES = ", ".join(f"('{k}', '{v}')" for k, v in scan.PURPOSES.items())


@R.query(
    "known_directories",
    CTE
    + f""", k(base, purpose) AS (VALUES {_PURPOSES}),
d AS (SELECT DISTINCT project, regexp_extract(file, '^([^/]+)/', 1) AS dir FROM t WHERE contains(file, '/') AND NOT starts_with(file, '/'))
SELECT project, dir, purpose FROM d JOIN k ON k.base = d.dir WHERE dir NOT IN ({", ".join(f"'{x}'" for x in scan.IGNORED)})
""",
)
def known_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13, CLS-06: top-level directories of a project whose purpose is known."""
    dirs = scan.directories(modules(spark, sf_dir).select("project", F.col("file").alias("path")).distinct(), 1)
    return scan.directory_purposes(dirs.filter(F.col("dir") != "")).filter((F.col("depth") == 1) & (F.col("purpose") != "Unknown")).select("project", "dir", "purpose")


@R.query("tree_purposes", rows_sql("dir, depth, purpose", "('src', 1, 'Source code')", "('src/deep', 2, 'Unknown')", "('src/deep/er', 3, 'Unknown')", "('src/deep/er/and', 4, 'Unknown')", "('src/deep/er/and/more', 5, 'Unknown')", "('tests', 1, 'Tests')", "('spec', 1, 'Spec tests')", "('apps', 1, 'Applications')", "('apps/web', 2, 'Web assets')"))
def tree_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-06: what the directories of a tree are for."""
    return scan.directory_purposes(scan.directories(_listing(spark))).select("dir", "depth", "purpose")


@R.query("test_locations", rows_sql("project, location, confidence, structure", "('a', '__tests__/', 1.0::DOUBLE, 0.875::DOUBLE)", "('b', '*.test.ts', 0.85, 0.8375)", "('c', '*_test.go', 1.0, 0.875)", "('d', 'tests/', 1.0, 0.875)"))
def test_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-06, AGG-29: where tests are, and the confidence in a structure whose entry point is sure and whose architecture is half sure."""
    projects = spark.createDataFrame([("a", "node"), ("b", "node"), ("c", "go"), ("d", "rust"), ("e", "node"), ("f", "rust")], "project string, type string")
    files = spark.createDataFrame([("a", "test/x.ts"), ("a", "__tests__/y.ts"), ("b", "vitest.config.ts"), ("d", "tests/z.rs"), ("e", "src/tests/x.ts"), ("f", "src/x.rs")], "project string, path string")
    return scan.test_locations(projects, files).withColumn("structure", scan.structure_confidence(F.lit(1.0), F.col("confidence"), F.lit(0.5)))


@R.query("branch_habits", rows_sql("project, prefix, uses", "('a', 'feat/', 2)", "('b', 'fix/', 1)"))
def branch_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, AGG-32: the commonest branch prefix of merges, without bots; of branches where merges name none; the first of equals."""
    merges = [("a", 0, "Merge pull request #1 from me/dependabot/x"), ("a", 1, "Merge pull request #2 from me/feat/x"), ("a", 2, "Merge branch 'feat/y'"), ("a", 3, "Merge pull request #3 from me/dependabot/y"), ("a", 4, "Merge branch 'plain'"), ("b", 0, "Merge pull request #1 from me/renovate/x")]
    branches = [("a", 0, "origin/zzz/1"), ("b", 0, "origin/HEAD -> origin/main"), ("b", 1, "origin/fix/1"), ("b", 2, "origin/feat/1"), ("b", 3, "origin/snyk-fix/2")]
    out = scan.branch_habits(spark.createDataFrame(merges, "project string, place int, subject string"), spark.createDataFrame(branches, "project string, place int, name string"))
    return out.select("project", "prefix", F.col("uses").cast("int").alias("uses"))


def _commits(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [("q", d, a, f) for d, a, f in ((0, "x", ["src/a.ts", "README.md"]), (6, "y", ["src/a.ts", "src/notes.md"]), (8, "x", ["src/b.py", "tests/c.ts"]), (27, "z", ["src/b.py"]), (29, "w", []), (31, "v", ["src/a.ts"]))]
    rows += [("busy", d % 20, f"p{d % 3 if d % 20 < 14 else 9}", ["m.go"]) for d in range(320)]
    d = spark.createDataFrame(rows, "project string, d int, author string, files array<string>")
    at = F.expr("timestamp'2025-06-30 12:00:00' - make_dt_interval(d)")
    return d.select("project", at.alias("at"), "author", "files"), spark.createDataFrame([("q",), ("busy",)], "project string").withColumn("now", F.expr("timestamp'2025-06-30 12:00:00'"))


@R.query("recent_activity", rows_sql("project, days, contributors, weeks", "('q', 30, 4, '2,1,0,1')", "('busy', 14, 4, '112,112,96,0')"))
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30: window, contributors and weekly commits; fourteen days (and the fifteenth's first moment) where thirty have over 300 commits."""
    s, _ = scan.recent_activity(*_commits(spark))
    return s.select("project", "days", F.col("contributors").cast("int").alias("contributors"), F.array_join(F.col("weeks").cast("array<string>"), ",").alias("weeks"))


@R.query("churning_files", rows_sql("project, file, commits", "('q', 'src/a.ts', 2)", "('q', 'src/b.py', 2)", "('q', 'src/notes.md', 1)", "('busy', 'm.go', 240)"))
def churning_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30: the files with most commits in the window; no Markdown outside of sources, nothing aside from the product."""
    _, f = scan.recent_activity(*_commits(spark))
    return f.select("project", "file", F.col("commits").cast("int").alias("commits"))
