"""What a project is, read off its file list, manifests and imports.

Facts are tables (files, dependencies, imports) and rules are data: ordered
tables that are hashed against the facts, the first or best rule by rank. So a
scan of a hundred thousand projects is a few joins with small dictionaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numeric import half_up, ratio
from tallyforge.functions.paths import base_name, endings
from tallyforge.functions.text import DEMANDED, KEYWORDS, VOTED, branch_of_merge, naming_style

#: Directories that no census looks into.
IGNORED = ("node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", "__pycache__", ".pytest_cache", "venv", ".venv", "vendor", "target", "coverage", ".coverage", ".nyc_output", ".turbo", ".cache", "tmp", ".vitest")
#: Extensions of source files.
SOURCE = ("ts", "tsx", "js", "jsx", "py", "go", "rs", "rb", "php", "java", "kt", "swift", "c", "cpp", "h", "cs")
#: Names of configuration files, and names with a free part in the middle or at the end.
CONFIG = ("package.json", "tsconfig.json", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "Gemfile", "composer.json", "pom.xml", "build.gradle", "build.gradle.kts", "Makefile", "CMakeLists.txt", "docker-compose.yml", "docker-compose.yaml", "Dockerfile", ".dockerignore", ".gitignore", ".editorconfig", "turbo.json", "turbo.jsonc", "nx.json", "lerna.json", "pnpm-workspace.yaml", ".env", ".babelrc", ".eslintrc", ".prettierrc")
CONFIG_FORMS = r"^(tsconfig\..*\.json|\.env\..*|(\.eslintrc|\.prettierrc)\.(js|json|cjs)|(eslint|prettier|vitest|jest|webpack|vite|rollup|next|tailwind|postcss|babel)\.config\.(js|ts|mjs))$"


def _folders(path: Column) -> Column:
    return F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)


def _looked_into(path: Column) -> Column:
    return ~F.exists(_folders(path), lambda s: s.isin(*IGNORED))


def directories(files: DataFrame, most: int = 5) -> DataFrame:
    """SRC-02: (project, dir): every directory of ``files(project, path)`` down to ``most`` levels, not those ignored or below one."""
    folders = _folders(F.col("path"))
    each = F.transform(F.sequence(F.lit(1), F.least(F.size(folders), F.lit(most))), lambda i: F.array_join(F.slice(folders, F.lit(1), i), "/"))
    dirs = files.filter(F.size(folders) > 0).select("project", F.explode(each).alias("dir")).distinct()
    return dirs.filter(_looked_into(F.concat("dir", F.lit("/x"))))


def census(files: DataFrame) -> DataFrame:
    """SRC-03: (project, source, test, config, total) of ``files(project, path)``: a test is no source; configuration may be either too."""
    path, name = F.col("path"), base_name(F.col("path"))
    ext = F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)
    folder = F.array_join(_folders(path), "/")
    apart = name.rlike(r"\.(test|spec)\.|^test_|_test\.") | folder.rlike("(^|/)(tests?|__tests__|spec)(/|$)")
    test = (
        name.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$|^test_.*\.py$|_test\.(py|go)$")
        | (folder.rlike("(^|/)tests?(/|$)") & ext.isin("ts", "tsx", "js", "jsx", "py"))
        | (folder.rlike("(^|/)__tests__(/|$)") & ext.isin("ts", "tsx", "js", "jsx"))
        | (folder.rlike("(^|/)spec(/|$)") & (ext == "rb"))
    )
    config = name.isin(*CONFIG) | name.rlike(CONFIG_FORMS)
    n = lambda cond: F.count_if(cond)
    counted = files.filter(_looked_into(path)).groupBy("project").agg(n(ext.isin(*SOURCE) & ~apart).alias("source"), n(test).alias("test"), n(config).alias("config"))
    return counted.withColumn("total", F.col("source") + F.col("test") + F.col("config"))


def files_by_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """SRC-04: (project, root, files): source files below each of ``roots(project, root)`` (``.`` is the project itself)."""
    source = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).isin(*SOURCE)
    up = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(_folders(F.col("path"))) + 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/")))
    at = files.filter(source & _looked_into(F.col("path"))).select(F.col("project").alias("f_p"), "path", F.explode(F.array_distinct(up)).alias("above"))
    hit = roots.join(at, (F.col("project") == F.col("f_p")) & (F.col("root") == F.col("above")), "left")
    return hit.groupBy("project", "root").agg(F.count("path").alias("files"))


#: Lock files in the order they are looked for.
LOCKS = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("package-lock.json", "npm"))


def package_managers(files: DataFrame, start: DataFrame, levels: int = 5) -> DataFrame:
    """CLS-02: (project, folder, manager) for directories ``start(project, folder)``: the lock file met first on the way up, at most
    ``levels`` directories; else what the directory's manifest declares; else npm with a manifest, null without."""
    segments = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    up = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(levels - 1))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(segments, F.lit(1), F.size(segments) - i), "/").alias("dir")))
    walk = start.select("project", "folder", F.explode(up).alias("u")).select("project", "folder", "u.depth", "u.dir")
    rank = F.lit(None).cast("int")
    for i, (lock, _) in enumerate(LOCKS):
        rank = F.when(base_name(F.col("path")) == lock, i).otherwise(rank)
    own = files.select(F.col("project").alias("f_p"), F.array_join(_folders(F.col("path")), "/").alias("f_d"), rank.alias("rank"), base_name(F.col("path")).alias("name"), "text")
    met = walk.join(own.filter(F.col("rank").isNotNull()), (F.col("project") == F.col("f_p")) & (F.col("dir") == F.col("f_d"))).groupBy(F.col("project").alias("m_p"), F.col("folder").alias("m_a")).agg(F.min(F.struct("depth", "rank"))["rank"].alias("lock"))
    declared = F.regexp_extract(F.trim(F.get_json_object("text", "$.packageManager")), "^([a-z]+)@?", 1)
    manifest = own.filter(F.col("name") == "package.json").select(F.col("f_p").alias("d_p"), F.col("f_d").alias("d_d"), F.when(declared.isin("npm", "pnpm", "yarn", "bun"), declared).otherwise("npm").alias("declared"))
    joined = start.join(met, (F.col("project") == F.col("m_p")) & (F.col("folder") == F.col("m_a")), "left").join(manifest, (F.col("project") == F.col("d_p")) & (F.col("folder") == F.col("d_d")), "left")
    names = F.array(*[F.lit(m) for _, m in LOCKS])
    return joined.select("project", "folder", F.coalesce(F.try_element_at(names, F.col("lock") + 1), "declared").alias("manager"))


def best_by_rank(facts: DataFrame, rules: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """CLS-03, CLS-08, UDX-02, AGG-28: per project and category the first rule whose dependency it has.

    ``facts(project, dependency)``, ``rules(category, name, dependency, rank,
    confidence, unless, hint, boost)``: a rule does not hold where the project
    also has ``unless``; ``hints(project, path)`` raise the confidence by
    ``boost`` where a path ends in ``hint``. Confidence is one at most. The
    rules are a dictionary of fixed size.
    """
    facts = facts.select("project", "dependency").distinct()
    held = facts.join(F.broadcast(rules), "dependency")
    against = facts.select(F.col("project").alias("a_p"), F.col("dependency").alias("a_d"))
    held = held.join(against, (F.col("project") == F.col("a_p")) & (F.col("unless") == F.col("a_d")), "left_anti")
    if hints is not None:
        ends = hints.select(F.col("project").alias("h_p"), F.explode(endings(F.col("path"))).alias("h_e")).distinct()
        held = held.join(ends, (F.col("project") == F.col("h_p")) & (F.col("hint") == F.col("h_e")), "left").withColumn("hit", F.col("h_e").isNotNull())
    else:
        held = held.withColumn("hit", F.lit(False))
    score = F.least(F.lit(1.0), F.col("confidence") + F.when(F.col("hit"), F.coalesce("boost", F.lit(0.0))).otherwise(0.0))
    best = held.groupBy("project", "category").agg(F.min_by(F.struct("name", half_up(score, 2).alias("confidence"), "dependency"), "rank").alias("x"))
    return best.select("project", "category", "x.name", "x.confidence", "x.dependency")


def project_types(facts: DataFrame) -> DataFrame:
    """CLS-01: (project, type, confidence) by ordered rules over what stands at a project's root.

    ``facts(project, name, text)`` are the files at the root. A Node manifest
    beside another language's counts for that one if its file says that it is
    real: dependencies in ``pyproject.toml``, a workspace in ``Cargo.toml``.
    """
    has = lambda *names: F.coalesce(F.bool_or(F.col("name").isin(*names)), F.lit(False))
    text = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    listed = r"(?s)(?:^|\n)dependencies\s*=\s*\[[^\]]*[\"'][^\"']+[\"']"
    poetry = r"(?m)^\[tool\.poetry\.dependencies\]\s*$(?s:(?:(?!\n\[).)*?)^\s*(?!python\s*=)[A-Za-z]"
    f = facts.groupBy("project").agg(
        has("package.json").alias("node"),
        has(*[lock for lock, _ in LOCKS], "bun.lock").alias("lock"),
        (F.get_json_object(text("package.json"), "$.workspaces").isNotNull()).alias("workspaces"),
        F.coalesce(text("pyproject.toml").rlike(listed) | text("pyproject.toml").rlike(poetry), F.lit(False)).alias("python_deps"),
        F.coalesce(text("Cargo.toml").rlike(r"(?m)^\[workspace\]"), F.lit(False)).alias("crates"),
        F.coalesce(text("Cargo.toml").rlike(r"(?m)^[ \t]*tauri[ \t]*="), F.lit(False)).alias("tauri"),
        has("pnpm-workspace.yaml").alias("pnpm_workspace"),
        *[has(n).alias(c) for n, c in (("Gemfile", "gemfile"), ("go.mod", "go"), ("pyproject.toml", "pyproject"), ("Cargo.toml", "cargo"), ("composer.json", "php"), ("requirements.txt", "requirements"), ("Pipfile", "pipfile"), ("setup.py", "setup"))],
    )
    c = F.col
    node, sure = c("node"), lambda a, b: F.when(c("lock"), a).otherwise(b)
    tauri = c("crates") & c("tauri") & c("pnpm_workspace")
    rules: Sequence[tuple[Column, str, Column | float]] = (
        (node & c("workspaces") & ~c("gemfile"), "node", 0.9),
        (node & c("lock") & ~c("pyproject") & ~c("cargo") & ~c("go") & ~c("gemfile"), "node", 0.95),
        (node & c("python_deps"), "python", sure(0.9, 0.85)),
        (node & tauri, "node", sure(0.85, 0.8)),
        (node & c("crates"), "rust", sure(0.9, 0.85)),
        (node & c("gemfile"), "ruby", sure(0.9, 0.85)),
        (node & c("go"), "go", sure(0.9, 0.85)),
        (node, "node", sure(0.95, 0.7)),
        (c("pyproject"), "python", 0.95),
        (c("requirements") | c("pipfile"), "python", 0.9),
        (c("setup"), "python", 0.85),
        (c("go"), "go", 0.95),
        (c("cargo"), "rust", 0.95),
        (c("gemfile"), "ruby", 0.9),
        (c("php"), "php", 0.9),
    )
    answer = F.struct(F.lit("unknown").alias("type"), F.lit(0.0).alias("confidence"))
    for cond, kind, confidence in reversed(rules):
        answer = F.when(cond, F.struct(F.lit(kind).alias("type"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))).otherwise(answer)
    return f.select("project", answer.alias("x")).select("project", "x.type", "x.confidence")


def import_style(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """AGG-21, FN-S02: (project, style, confidence, absolute, relative) from seven tenths of the project's own imports.

    ``imports(project, language, module)``; ``roots(project, language, prefix)``
    are what own absolute imports begin with (an alias, a package, a module path).
    Imports of packages do not count; a project without own ones is mixed with 0.
    """
    m = F.col("module")
    own = roots.select(F.col("project").alias("r_p"), F.col("language").alias("r_l"), "prefix")
    begins = (m == F.col("prefix")) | m.startswith(F.when(F.col("language") == "python", F.concat("prefix", F.lit("."))).otherwise(F.col("prefix")))
    marked = imports.withColumn("i", F.monotonically_increasing_id())
    hit = marked.join(own, (F.col("project") == F.col("r_p")) & (F.col("language") == F.col("r_l")) & begins, "left").groupBy("project", "language", "module", "i").agg(F.bool_or(F.col("prefix").isNotNull()).alias("own"))
    relative = F.when(F.col("language") == "python", m.startswith(".")).when(F.col("language") == "go", False).otherwise(m.startswith("./") | m.startswith("../"))
    absolute = ~relative & (F.col("own") | (F.col("language").isin("typescript", "javascript") & m.startswith("src/")))
    n = hit.groupBy("project").agg(F.count_if(absolute).alias("a"), F.count_if(relative).alias("r"))
    share_a, share_r = F.coalesce(ratio(F.col("a"), F.col("a") + F.col("r")), F.lit(0.0)), F.coalesce(ratio(F.col("r"), F.col("a") + F.col("r")), F.lit(0.0))
    style = F.when(share_a >= 0.7, "absolute").when(share_r >= 0.7, "relative").otherwise("mixed")
    return n.select("project", style.alias("style"), half_up(F.greatest(share_a, share_r), 4).alias("confidence"), F.col("a").alias("absolute"), F.col("r").alias("relative"))


#: Modules that come with the runtime.
BUILTINS = ("fs", "path", "os", "child_process", "crypto", "http", "https", "net", "stream", "url", "util", "events", "buffer", "assert", "readline", "worker_threads", "cluster", "dns", "tls", "zlib", "querystring", "string_decoder", "timers", "console", "process", "perf_hooks", "async_hooks", "diagnostics_channel", "inspector", "vm", "v8", "fs/promises", "timers/promises", "stream/promises", "readline/promises")
#: What in a text is a local import, an import that may be of the runtime, a catch block, a default export, a nullable type, an optional field.
LOCAL_IMPORT = r"(?:from\s+|require\s*\(\s*)['\"](\.[^'\"]+)['\"]"
PLAIN_IMPORT = r"(?:from|require\()\s*['\"]((?:node:)?[a-z_/]+)['\"]"
CATCH_BLOCK = r"catch\s*(?:\([^)]*\))?\s*\{([^}]*)\}"
DEFAULT_EXPORT, NULLABLE, OPTIONAL = r"export\s+default\b", r"\|\s*null\b", r"\w\s*\?:"


def code_patterns(files: DataFrame) -> DataFrame:
    """AGG-23: per project, from ``files(project, path, text, is_test)``: local imports with an extension, runtime modules with
    ``node:``, empty and commented catch blocks outside tests, files with a default export, and how absence is written."""
    t = F.col("text")
    local = F.regexp_extract_all(t, F.lit(LOCAL_IMPORT), F.lit(1))
    built = F.regexp_extract_all(t, F.lit(PLAIN_IMPORT), F.lit(1))
    built = F.filter(built, lambda m: F.regexp_replace(m, "^node:", "").isin(*BUILTINS))
    bodies = F.transform(F.regexp_extract_all(t, F.lit(CATCH_BLOCK), F.lit(1)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    said = lambda b: F.regexp_replace(F.regexp_replace(b, r"//[^\n]*|/\*(?s).*?\*/", ""), r"\s", "")
    per = files.select(
        "project",
        F.size(F.filter(local, lambda m: m.rlike(r"\.(js|jsx|ts|tsx)$"))).alias("with_ext"),
        F.size(local).alias("local"),
        F.size(F.filter(built, lambda m: m.startswith("node:"))).alias("prefixed"),
        F.size(built).alias("builtin"),
        F.when(F.col("is_test"), 0).otherwise(F.size(F.filter(bodies, lambda b: b == ""))).alias("empty"),
        F.when(F.col("is_test"), 0).otherwise(F.size(F.filter(bodies, lambda b: (b != "") & (said(b) == "")))).alias("commented"),
        t.rlike(DEFAULT_EXPORT).cast("int").alias("defaults"),
        F.regexp_count(t, F.lit(NULLABLE)).alias("nulls"),
        F.regexp_count(t, F.lit(OPTIONAL)).alias("optionals"),
    )
    s = per.groupBy("project").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in per.columns[1:]])
    both = F.col("nulls") + F.col("optionals")
    style = F.when(F.col("nulls") > 0.7 * both, "null").when(F.col("optionals") > 0.7 * both, "undefined").otherwise("mixed")
    return s.select("project", "files", "with_ext", "local", "prefixed", "builtin", "empty", "commented", "defaults", style.alias("absence"))


def dominance(users: Column, of: Column) -> Column:
    """AGG-24: dominant from three tenths of the component files, present from one tenth, else incidental; present where there are none."""
    share = ratio(users, of)
    return F.when(share.isNull(), "present").when(share >= 0.3, "dominant").when(share >= 0.1, "present").otherwise("incidental")


def variants(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """AGG-25, AGG-26: (project, name, variant, files, confidence, main) of competing variants of one library.

    ``imports(project, path, module, names)``; ``rules(name, variant, module,
    symbols, base, excludes, rank)``: files that import one of the symbols from
    a module that contains ``module``, not those that import from ``excludes``
    too. Confidence is the base and 0.15 from five files on, else 0.1; the
    variant with most files is the main one, of equals the one of least rank.
    """
    i = imports.select("project", "path", "module", "names")
    r = F.broadcast(rules)
    used = i.join(r.withColumnRenamed("module", "m"), F.col("module").contains(F.col("m")) & F.arrays_overlap("names", "symbols")).select("project", "path", "name", "variant", "base", "excludes", "rank").distinct()
    other = i.select(F.col("project").alias("o_p"), F.col("path").alias("o_f"), F.col("module").alias("o_m"))
    used = used.join(other, (F.col("project") == F.col("o_p")) & (F.col("path") == F.col("o_f")) & F.col("o_m").contains(F.col("excludes")), "left_anti")
    n = used.groupBy("project", "name", "variant", "base", "rank").agg(F.count("*").alias("files"))
    first = n.groupBy(F.col("project").alias("f_p"), F.col("name").alias("f_n")).agg(F.min_by("variant", F.struct(-F.col("files"), F.col("rank"))).alias("first"))
    score = half_up(F.least(F.lit(1.0), F.col("base") + F.when(F.col("files") >= 5, 0.15).otherwise(0.1)), 2)
    return n.join(first, (F.col("project") == F.col("f_p")) & (F.col("name") == F.col("f_n"))).select("project", "name", "variant", "files", score.alias("confidence"), (F.col("variant") == F.col("first")).alias("main"))


#: Path segments of what is not the product, and names that stand for it within its scope.
ASIDE = ("examples", "example", "example-apps", "templates", "template", "e2e", "test", "tests", "testing", "fixtures", "fixture", "playground", "playgrounds", "sandbox", "demos", "demo", "starters", "starter", "samples", "sample", "boilerplate", "references", "reference")
IDENTITY = ("core", "server")


def is_aside(path: Column, first: int | None = None) -> Column:
    """FLT-02, FLT-03: whether one of a path's segments (of the ``first`` ones, for files deep in a tree) is aside from the product, or the last ends in ``-e2e``."""
    segments = F.split(F.lower(path), "/")
    looked = segments if first is None else F.slice(segments, 1, first)
    return F.exists(looked, lambda s: s.isin(*ASIDE)) | (F.element_at(segments, -1).endswith("-e2e") if first is None else F.lit(False))


def primary_roots(roots: DataFrame) -> DataFrame:
    """WIN-14: (project, root) of ``roots(project, name, root, package, files, hinted)``: one per project by four policies.

    Paths aside from the product are left out where others remain. Then the
    largest of ``apps/`` with signs of a framework; then the best match of a
    package's name with the project's, in four tiers, if it has ten files and a
    twentieth of the largest; then the one with most files.
    """
    aside = is_aside(F.col("root"))
    size = roots.groupBy(F.col("project").alias("s_p")).agg(F.bool_or(~aside).alias("any_left"))
    left = roots.join(size, F.col("project") == F.col("s_p")).filter(~aside | ~F.col("any_left"))
    most = left.groupBy(F.col("project").alias("m_p")).agg(F.max("files").alias("most"))
    left = left.join(most, F.col("project") == F.col("m_p"))
    scope, bare, own = F.lower(F.regexp_extract("package", "^@([^/]+)/", 1)), F.lower(F.regexp_replace("package", "^@[^/]+/", "")), F.lower("name")
    tier = F.when((bare == own) & (scope == ""), 1).when(bare == own, 2).when(bare.isin(*IDENTITY) & scope.contains(own), 3).when((scope != "") & (bare == scope), 4)
    named = F.when((F.col("root") != ".") & F.col("package").isNotNull() & (own != ""), tier)
    # the guard is on the best match alone: a smaller match does not step in for one that fails it
    ranked = left.withColumn("tier", named)
    best = ranked.filter(F.col("tier").isNotNull()).groupBy(F.col("project").alias("b_p")).agg(F.min_by(F.struct("root", "files", "most"), F.struct("tier", -F.col("files"), "root")).alias("b"))
    best = best.filter((F.col("b.files") >= 10) & (F.col("b.files") >= 0.05 * F.col("b.most"))).select("b_p", F.col("b.root").alias("b_root"))
    app = ranked.filter(F.col("root").startswith("apps/") & F.col("hinted")).groupBy(F.col("project").alias("a_p")).agg(F.min_by("root", F.struct(-F.col("files"), F.col("root"))).alias("a_root"))
    any_ = ranked.groupBy("project").agg(F.min_by("root", F.struct(-F.col("files"), F.col("root"))).alias("any"))
    joined = any_.join(app, F.col("project") == F.col("a_p"), "left").join(best, F.col("project") == F.col("b_p"), "left")
    return joined.select("project", F.coalesce("a_root", "b_root", "any").alias("root"))


#: Which manifest a lock file goes with.
LOCK_OF = (("pnpm-lock.yaml", "package.json"), ("package-lock.json", "package.json"), ("yarn.lock", "package.json"), ("Gemfile.lock", "Gemfile"), ("Pipfile.lock", "Pipfile"), ("poetry.lock", "pyproject.toml"), ("Cargo.lock", "Cargo.toml"), ("composer.lock", "composer.json"), ("go.sum", "go.mod"))


def change_hygiene(changes: DataFrame) -> DataFrame:
    """AGG-47: (item, rule, file) of ``changes(item, path, text)``: a lock file without its manifest, conflict marks, environment files."""
    lock = F.lit(None).cast("string")
    for name, manifest in LOCK_OF:
        lock = F.when(F.col("path").endswith(name), manifest).otherwise(lock)
    locks = changes.select("item", "path", lock.alias("manifest")).filter(F.col("manifest").isNotNull())
    touched = changes.select(F.col("item").alias("c_i"), F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col("path").endswith(m).alias("is")) for m in sorted({m for _, m in LOCK_OF})])).alias("x")).filter("x.is").select("c_i", F.col("x.m").alias("c_m"))
    desync = locks.join(touched, (F.col("item") == F.col("c_i")) & (F.col("manifest") == F.col("c_m")), "left_anti").groupBy("item", F.lit("lock without manifest").alias("rule"), base_name(F.col("path")).alias("b")).agg(F.min("path").alias("file")).select("item", "rule", "file")
    marks = changes.filter(F.col("text").rlike(r"(?m)^<{7}\s|^={7}$|^>{7}\s")).select("item", F.lit("conflict mark").alias("rule"), F.col("path").alias("file"))
    name = base_name(F.col("path"))
    env = changes.filter(name.rlike(r"^\.env(\..*)?$") & ~name.isin(".env.example", ".env.test")).select("item", F.lit("environment file").alias("rule"), F.col("path").alias("file"))
    return desync.unionByName(marks).unionByName(env)


#: Kinds of commit of the conventional form.
COMMITS = r"^(feat|fix|chore|docs|refactor|test|ci|style|perf|build)(\(.+\))?(!)?:"


def commit_habits(commits: DataFrame) -> DataFrame:
    """AGG-32: per project from ``commits(project, place, subject, body, is_merge)``, newest first: share of conventional subjects
    among 50, merge strategy among 20, and the commonest co-author of 20."""
    said = F.col("subject") != ""
    head = commits.filter(F.col("place") < 50).groupBy("project").agg(half_up(F.avg(F.when(said, F.col("subject").rlike(COMMITS).cast("int"))), 2).alias("conventional"))
    merges = commits.filter(F.col("is_merge")).groupBy(F.col("project").alias("m_p")).agg(F.least(F.count("*"), F.lit(20)).alias("n"))
    trailer = F.regexp_extract_all("body", F.lit(r"Co-authored-by:\s*([^\n]+)"), F.lit(1))
    with_ = commits.filter(F.col("place") < 20).select(F.col("project").alias("t_p"), "place", F.posexplode(trailer).alias("i", "who")).groupBy("t_p", "who").agg(F.count("*").alias("k"), F.min(F.struct("place", "i")).alias("first"))
    author = with_.groupBy("t_p").agg(F.min_by("who", F.struct(-F.col("k"), F.col("first"))).alias("co_author"))
    n = F.coalesce("n", F.lit(0))
    strategy = F.when(n >= 15, "merge").when(n == 0, "squash").otherwise("mixed")
    sure = F.when(n >= 15, n / 20).when(n == 0, F.lit(0.7)).otherwise(0.5)
    return head.join(merges, F.col("project") == F.col("m_p"), "left").join(author, F.col("project") == F.col("t_p"), "left").select("project", "conventional", strategy.alias("strategy"), half_up(sure, 2).alias("confidence"), "co_author")


#: Dependencies and frameworks by what they say of an application.
SHAPES = {
    "protocol": ("@modelcontextprotocol/sdk",),
    "agent": ("langchain", "@langchain/core", "crewai", "@anthropic-ai/claude-agent-sdk", "autogen"),
    "mobile": ("react-native", "expo"),
    "job": ("inngest", "bullmq", "@trigger.dev/sdk", "bee-queue", "agenda"),
    "browser": ("nextjs", "remix", "react-router", "react", "vue", "angular", "svelte", "nuxt", "astro", "sveltekit", "solid"),
    "browser package": ("next", "@angular/core", "solid-js"),
    "server": ("express", "fastify", "koa", "hono", "nestjs", "adonis"),
}
#: Shapes by framework outside of Node.
SHAPE_OF = {"fastapi": "api-server", "django": "full-stack", "django-drf": "api-server", "flask": "api-server", "typer": "cli", "click": "cli", "gin": "api-server", "echo": "api-server", "chi": "api-server", "cobra-cli": "cli", "fiber": "api-server", "axum": "api-server", "actix-web": "api-server", "rocket": "api-server", "clap-cli": "cli"}


def application_shapes(projects: DataFrame, facts: DataFrame) -> DataFrame:
    """CLS-04: (project, shape) of ``projects(project, type, framework, has_bin, has_main)`` and ``facts(project, dependency)``.

    A protocol server, agent or worker is one only without a web framework; the
    framework decides next, then what the package offers.
    """
    d = F.col("dependency")
    flags = facts.groupBy(F.col("project").alias("f_p")).agg(*[F.bool_or(d.isin(*SHAPES[k])).alias(k) for k in ("protocol", "agent", "mobile", "job")], F.bool_or(d.isin(*SHAPES["browser"], *SHAPES["browser package"])).alias("ui"))
    p = projects.join(flags, F.col("project") == F.col("f_p"), "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    f = F.col("framework")
    browser, server = F.coalesce(f.isin(*SHAPES["browser"]), F.lit(False)), F.coalesce(f.isin(*SHAPES["server"]), F.lit(False))
    web = browser | server
    other = F.lit("unknown")
    for name, shape in SHAPE_OF.items():
        other = F.when(f == name, shape).otherwise(other)
    node = (
        F.when(has("protocol") & ~web, "mcp-server")
        .when(has("agent") & ~web, "ai-agent")
        .when(has("mobile"), "mobile-app")
        .when(has("job") & ~web, "worker")
        .when(browser, "web-app")
        .when(server, F.when(has("ui"), "full-stack").otherwise("api-server"))
        .when(has("has_bin"), "cli")
        .when(has("has_main"), "library")
        .otherwise("unknown")
    )
    return p.select("project", F.when(F.coalesce(F.col("type"), F.lit("node")) == "node", node).otherwise(other).alias("shape"))


def architectures(projects: DataFrame, dirs: DataFrame) -> DataFrame:
    """CLS-05: (project, architecture, confidence) of ``projects(project, type, framework, has_entry)`` and ``dirs(project, dir)``:
    microservices, domain-driven, layered, library, monolith, the first that fits."""
    d = F.col("dir")
    n = lambda pattern: F.count_if(d.rlike(pattern))
    holds = lambda *words: F.bool_or(F.array_contains(F.array(*[d.contains(w) for w in words]), True)).cast("int")
    base = base_name(d)
    seen = dirs.groupBy(F.col("project").alias("d_p")).agg(
        n(r"^services/\w+").alias("services"),
        n(r"^apps/\w+").alias("apps"),
        n(r"^cmd/\w+").alias("cmds"),
        n(r"^(features|modules|contexts|domains)/\w+").alias("domains"),
        n(r"^src/modules/\w+").alias("nest"),
        (holds("models") + holds("services", "domain", "business") + holds("api", "routes", "controllers", "handlers")).alias("layers"),
        F.bool_or(base.isin("lib", "pkg") | d.rlike("^(lib|pkg)/")).alias("lib"),
    )
    p = projects.join(seen, F.col("project") == F.col("d_p"), "left")
    c = lambda k: F.coalesce(F.col(k), F.lit(0))
    answer = lambda name, confidence: F.struct(F.lit(name).alias("architecture"), F.lit(confidence).alias("confidence"))
    x = (
        F.when((c("services") >= 2) | (c("apps") >= 2), answer("microservices", 0.9))
        .when((F.col("type") == "go") & (c("cmds") >= 2), answer("microservices", 0.85))
        .when(c("domains") >= 3, answer("domain-driven", 0.9))
        .when(c("domains") == 2, answer("domain-driven", 0.8))
        .when((F.lower("framework") == "nestjs") & (c("nest") >= 2), answer("domain-driven", 0.85))
        .when(c("layers") == 3, answer("layered", 0.95))
        .when(c("layers") == 2, answer("layered", 0.85))
        .when(c("layers") == 1, answer("layered", 0.7))
        .when(~F.col("has_entry") & F.coalesce("lib", F.lit(False)), answer("library", 0.9))
        .otherwise(answer("monolith", 0.7))
    )
    return p.select("project", x.alias("x")).select("project", "x.architecture", "x.confidence")


#: Modules and parts of paths that stand for validation.
VALIDATORS = ("zod", "yup", "joi", "class-validator", "valibot", "@sinclair/typebox", "schema", "validate", "validation")


def route_validation(files: DataFrame) -> DataFrame:
    """AGG-45: (project, routes, validated): route files of ``files(project, path, text)`` and those whose first thirty lines import something that validates."""
    path = F.col("path")
    route = path.rlike(r"(^|/)api/(.*/)?route\.(ts|js|tsx|jsx)$") | path.rlike(r"(^|/)pages/api/.*\.(ts|js|tsx|jsx)$")
    lines = F.transform(F.slice(F.split("text", "\n"), 1, 30), lambda x: F.lower(x))
    good = F.exists(lines, lambda x: (x.contains("import") | x.contains("require")) & F.exists(F.array(*[F.lit(v) for v in VALIDATORS]), lambda v: x.contains(v)))
    own = files.filter(route & ~path.rlike(r"\.(d\.ts|min\.js)$") & _looked_into(path) & ~is_aside(path, 3))
    return own.groupBy("project").agg(F.count("*").alias("routes"), F.count_if(F.coalesce(good, F.lit(False))).alias("validated"))


def boundaries(files: DataFrame) -> DataFrame:
    """AGG-46: (project, pages, error_pages, env, env_example, env_ignored, env_state) of ``files(project, path, text)``; pages aside from the product do not count."""
    path, name = F.col("path"), base_name(F.col("path"))
    product = _looked_into(path) & ~is_aside(path, 3)
    q = files.groupBy("project").agg(
        F.count_if(product & name.isin("page.tsx", "page.jsx")).alias("pages"),
        F.count_if(product & name.isin("error.tsx", "error.jsx")).alias("error_pages"),
        F.bool_or(path.isin(".env", ".env.local")).alias("env"),
        F.bool_or(path == ".env.example").alias("env_example"),
        F.coalesce(F.bool_or((path == ".gitignore") & F.col("text").rlike(r"(?m)^\s*\.env(\*|\.\*)?\s*$")), F.lit(False)).alias("env_ignored"),
    )
    state = F.when(~F.col("env") & ~F.col("env_example"), "none").when(F.col("env_example") & F.col("env_ignored"), "clean").otherwise(F.concat_ws(", ", F.when(~F.col("env_example"), "no example"), F.when(~F.col("env_ignored"), "not ignored")))
    return q.withColumn("env_state", state)


def freshness(scans: DataFrame, days: int = 7, commits: int = 50) -> DataFrame:
    """AGG-53: (project, age_days, commits, stale) of ``scans(project, scanned_at, now, commits)``: older than ``days`` with more than
    ``commits`` since; the age alone decides where commits are not known. Without a time there is no row."""
    age = F.floor((F.unix_timestamp("now") - F.unix_timestamp("scanned_at")) / 86_400)
    old = age > days
    return scans.filter(F.col("scanned_at").isNotNull()).select("project", age.alias("age_days"), "commits", F.when(F.col("commits").isNull(), old).otherwise(old & (F.col("commits") > commits)).alias("stale"))


#: Files that only a framework's own application has, packages that are no surfaces, and server frameworks by package.
STRONG_CONFIG = r"^((next|vite|nuxt|svelte|vue|remix|react-router|astro)\.config\.(ts|js|mjs)|nest-cli\.json|angular\.json)$"
INFRASTRUCTURE = ("tsconfig", "eslint-config", "prettier-config", "tailwind-config", "config-typescript", "biome-config")
SERVER_PACKAGES = ("express", "fastify", "koa", "hono", "@hono/node-server", "@nestjs/core", "elysia", "polka", "restify", "h3")


def surfaces(roots: DataFrame) -> DataFrame:
    """CLS-07: (project, root, name, signal) of the packages of a repository that someone develops.

    ``roots(project, root, files, has_bin, is_library, scripts, deps, configs)``,
    the last three arrays of names. Four signals in order: a command with a dev
    script, an app with a framework's file or more than fifty sources, a
    framework's file (a library that is built with vite does not count), a
    server package with a dev script and fifteen sources. Names are the last
    segment, with the parent's before it for versions and where two are alike.
    """
    root = F.col("root")
    last = F.element_at(F.split(root, "/"), -1)
    parent = F.lower(F.coalesce(F.try_element_at(F.split(root, "/"), F.lit(-2)), F.lit("")))
    left = roots.filter(~root.isin(".", "") & (F.col("files") >= 5) & ~F.lower(last).isin(*INFRASTRUCTURE) & ~is_aside(root))
    strong = F.exists("configs", lambda c: c.rlike(STRONG_CONFIG))
    vite = F.exists("configs", lambda c: c.startswith("vite.config.")) & F.col("is_library")
    runs = lambda *names: F.arrays_overlap("scripts", F.array(*[F.lit(n) for n in names]))
    signal = (
        F.when(F.col("has_bin") & runs("dev"), 1)
        .when(root.startswith("apps/") & (strong | (F.col("files") > 50)), 2)
        .when(strong & ~vite, 3)
        .when((F.col("files") >= 15) & F.arrays_overlap("deps", F.array(*[F.lit(n) for n in SERVER_PACKAGES])) & runs("dev", "start:dev"), 4)
    )
    plain = F.replace(F.replace(F.lower(last), F.lit("_"), F.lit("-")), F.lit("."), F.lit(""))
    before = lambda name: F.when(parent != "", F.concat(parent, F.lit("-"), name)).otherwise(name)
    named = left.withColumn("signal", signal).filter(F.col("signal").isNotNull()).select("project", "root", "signal", F.when(last.rlike(r"^v?\d+$"), before(plain)).otherwise(plain).alias("raw"), parent.alias("parent"))
    alike = named.groupBy(F.col("project").alias("n_p"), F.col("raw").alias("n_r")).agg(F.count("*").alias("n"))
    joined = named.join(alike, (F.col("project") == F.col("n_p")) & (F.col("raw") == F.col("n_r")))
    name = F.when((F.col("n") > 1) & (F.col("parent") != ""), F.concat("parent", F.lit("-"), "raw")).otherwise(F.col("raw"))
    return joined.select("project", "root", name.alias("name"), "signal")


def naming_votes(names: DataFrame, group: list[str]) -> DataFrame:
    """AGG-20, FLT-10: (group..., sample, majority, share, confidence, mixed) of ``names(group..., language, name)``.

    Words of the language and names that a runtime demands do not vote, nor do
    lower-case words; the confidence shrinks by five names, below seven tenths a
    group is mixed. A group without a voting name has no majority, confidence 0.
    """
    chosen = ~F.col("name").isin(*DEMANDED)
    for language, words in KEYWORDS.items():
        chosen = chosen & ~((F.col("language") == language) & F.col("name").isin(*words))
    style = F.when(F.coalesce(chosen, F.lit(True)), naming_style(F.col("name")))
    n = names.groupBy(*group, style.alias("style")).agg(F.count("*").alias("n"))
    votes = F.col("style").isin(*VOTED)
    rank = F.array_position(F.array(*[F.lit(v) for v in VOTED]), F.col("style"))
    g = n.groupBy(*group).agg(F.sum("n").alias("sample"), F.sum(F.when(votes, F.col("n"))).alias("valid"), F.max_by(F.when(votes, F.struct("style", "n")), F.when(votes, F.struct("n", (-rank).alias("r")))).alias("top"))
    share = F.col("top.n") / F.col("valid")
    return g.select(*group, "sample", F.col("top.style").alias("majority"), half_up(share, 4).alias("share"), half_up(F.coalesce(share * F.col("valid") / (F.col("valid") + 5), F.lit(0.0)), 4).alias("confidence"), F.coalesce(share < 0.7, F.lit(True)).alias("mixed"))


def ui_systems(facts: DataFrame) -> DataFrame:
    """CLS-09: (project, ui) of projects with tailwind: shadcn/ui where its three companions are there too."""
    d = F.col("dependency")
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    q = facts.groupBy("project").agg(has(d == "tailwindcss").alias("tailwind"), (has(d == "class-variance-authority") & has(d == "tailwind-merge") & has(d.startswith("@radix-ui/"))).alias("shadcn"))
    return q.filter("tailwind").select("project", F.when(F.col("shadcn"), "shadcn/ui (Tailwind)").otherwise("Tailwind CSS").alias("ui"))


def testing_elsewhere(projects: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """CLS-09: (project, testing) outside of Node, of ``projects(project, type)``, ``facts(project, dependency)`` and ``files(project, path)``:
    what a language brings along, or its usual package or folder."""
    d = facts.filter(F.col("dependency").isin("pytest", "unittest")).select("project", F.col("dependency").alias("testing"), F.lit("python").alias("of")).distinct()
    path = F.col("path")
    r = files.select("project", F.when(path == ".rspec", "RSpec").when(path.startswith("test/"), "Minitest").alias("testing"), F.lit("ruby").alias("of")).filter(F.col("testing").isNotNull()).distinct()
    own = d.unionByName(r).withColumnRenamed("project", "o_p")
    found = projects.join(own, (F.col("project") == F.col("o_p")) & (F.col("type") == F.col("of"))).select("project", "testing")
    fixed = projects.select("project", F.when(F.col("type") == "go", "Go testing").when(F.col("type") == "rust", "Cargo test").alias("testing")).filter(F.col("testing").isNotNull())
    return found.unionByName(fixed)


def deployments(found: DataFrame) -> DataFrame:
    """CLS-10: (project, platform, path) of ``found(project, place, platform, path, root, primary)``: the first at the primary root, else the first of all."""
    at_root = F.coalesce(F.col("root") == F.col("primary"), F.lit(False))
    best = found.groupBy("project").agg(F.min_by(F.struct("platform", "path"), F.struct(~at_root, F.col("place"))).alias("x"))
    return best.select("project", "x.platform", "x.path")


#: CLS-11: what a scan cannot see or misses, each a rule over ``(project, head, env, env_ignored, runners, test_files, failure)``.
BLIND_SPOTS = {
    "no repository": lambda p: p["head"].isNull(),
    "environment file not ignored": lambda p: p["env"] & ~p["env_ignored"],
    "no tests": lambda p: (p["runners"] == 0) & (p["test_files"] == 0),
    "tests of an unknown runner": lambda p: (p["runners"] == 0) & (p["test_files"] > 0),
    "no analysis": lambda p: p["failure"].isNotNull(),
}


def workspaces(files: DataFrame) -> DataFrame:
    """SRC-05: (project, root, package, files, has_bin, is_library, scripts, deps, configs) of every package of ``files(project, path, text)``.

    A package is a folder with a Node manifest that is valid JSON, ``.`` at the
    top; below the top only folders that the top's ``workspaces`` name (``a/*``
    one level, ``a/**`` any, without a list all). Sources are counted below each.
    """
    path, text = F.col("path"), F.col("text")
    folder = F.array_join(_folders(path), "/")
    at = F.when(folder == "", ".").otherwise(folder)
    keys = lambda k: F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{k}")), F.array().cast("array<string>"))
    has = lambda *ks: F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in ks]).isNotNull()
    m = files.filter((base_name(path) == "package.json") & _looked_into(path) & F.try_parse_json(text).isNotNull())
    listed = F.coalesce(F.get_json_object(text, "$.workspaces.packages"), F.get_json_object(text, "$.workspaces"))
    m = m.select("project", at.alias("root"), F.get_json_object(text, "$.name").alias("package"), has("bin").alias("has_bin"), has("main", "module", "exports").alias("is_library"), F.array_sort(keys("scripts")).alias("scripts"), F.array_sort(F.array_distinct(F.concat(keys("dependencies"), keys("peerDependencies")))).alias("deps"), F.from_json(listed, "array<string>").alias("globs"))
    tops = m.filter((F.col("root") == ".") & F.col("globs").isNotNull()).select(F.col("project").alias("t_p"), F.col("globs").alias("named"))
    form = lambda g: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(g, r"^\./|/$", ""), r"\.", r"\\\\."), r"\*\*", "\x00"), r"\*", "[^/]+"), F.lit("$"))
    fits = F.exists("named", lambda g: F.regexp_like(F.col("root"), F.replace(form(g), F.lit("\x00"), F.lit(".+"))))
    kept = m.join(tops, F.col("project") == F.col("t_p"), "left").filter((F.col("root") == ".") | F.col("named").isNull() | fits)
    configs = files.filter(base_name(path).rlike(STRONG_CONFIG)).groupBy(F.col("project").alias("c_p"), at.alias("c_r")).agg(F.array_sort(F.collect_set(base_name(path))).alias("configs"))
    roots = kept.join(configs, (F.col("project") == F.col("c_p")) & (F.col("root") == F.col("c_r")), "left")
    sized = files_by_root(files.select("project", "path"), kept.select("project", "root")).select(F.col("project").alias("s_p"), F.col("root").alias("s_r"), "files")
    joined = roots.join(sized, (F.col("project") == F.col("s_p")) & (F.col("root") == F.col("s_r")))
    return joined.select("project", "root", "package", F.col("files").cast("int").alias("files"), "has_bin", "is_library", "scripts", "deps", F.coalesce("configs", F.array().cast("array<string>")).alias("configs"))


#: What a directory of a name is for.
PURPOSES = {
    "src": "Source code", "lib": "Library code", "app": "Application code", "api": "API endpoints", "routes": "API routes", "controllers": "Request controllers", "handlers": "Request handlers",
    "models": "Data models", "schemas": "Data schemas", "services": "Service modules", "domain": "Domain logic", "core": "Core modules", "utils": "Utility functions", "helpers": "Helper functions",
    "middleware": "Request middleware", "middlewares": "Request middleware", "config": "Configuration", "engine": "Engine code", "shared": "Shared utilities", "common": "Common utilities",
    "tests": "Tests", "test": "Tests", "__tests__": "Jest tests", "spec": "Spec tests", "e2e": "End-to-end tests", "integration": "Integration tests", "cypress": "Cypress tests", "playwright": "Playwright tests",
    "fixtures": "Test fixtures", "docs": "Documentation", "email-templates": "Email templates", "documentation": "Documentation", "components": "UI components", "pages": "Page routes", "views": "View templates",
    "layouts": "Layout components", "styles": "Stylesheets", "css": "Stylesheets", "scss": "Sass stylesheets", "public": "Public static files", "static": "Static files", "assets": "Assets", "web": "Web assets",
    "hooks": "React hooks", "store": "State management", "stores": "State management", "migrations": "Database migrations", "alembic": "Database migrations (Python)", "schema": "Database schema",
    "database": "Database code", "db": "Database code", "seeds": "Database seeds", "repositories": "Data repositories", "prisma": "Prisma schema", "supabase": "Supabase config", "drizzle": "Drizzle config",
    "features": "Feature modules", "modules": "Feature modules", "contexts": "Contexts", "domains": "Domain modules", "infrastructure": "Infrastructure code", "apps": "Applications", "packages": "Workspace packages",
    "cmd": "CLI commands", "internal": "Internal packages", "pkg": "Public packages", "dist": "Build output", "build": "Build output", "out": "Build output", ".next": "Next.js build cache", ".nuxt": "Nuxt build cache",
    "target": "Rust build output", ".github": "GitHub config", ".vscode": "VS Code config", ".idea": "JetBrains config", "scripts": "Build/utility scripts", "tools": "Development tools", "deployments": "Deployment configs",
    "docker": "Docker configurations", "templates": "Template files", "examples": "Example code", "prompts": "LLM prompts", "benchmarks": "Performance benchmarks", "concerns": "Rails concerns", "mailers": "Email mailers",
    "jobs": "Background jobs", "workers": "Worker processes", "tasks": "Rake tasks", "resources": "Application resources", "providers": "Service providers", "vendor": "Third-party dependencies", "locales": "Internationalization",
    "i18n": "Internationalization", "types": "Type definitions", "generated": "Generated code", "protos": "Protocol buffer definitions", "graphql": "GraphQL schemas",
}


def directory_purposes(dirs: DataFrame) -> DataFrame:
    """CLS-06: ``dirs(project, dir)`` with ``depth`` and ``purpose`` by the last segment, Unknown for other names; a broadcast dictionary."""
    known = F.broadcast(dirs.sparkSession.createDataFrame(list(PURPOSES.items()), "base string, known string"))
    own = dirs.withColumn("base", base_name(F.col("dir"))).join(known, "base", "left")
    return own.select("project", "dir", F.size(F.split("dir", "/")).alias("depth"), F.coalesce("known", F.lit("Unknown")).alias("purpose"))


def test_locations(projects: DataFrame, files: DataFrame) -> DataFrame:
    """CLS-06: (project, location, confidence) of ``projects(project, type)`` outside of Python: the first test folder at the root, else what the runner's file implies; no row without any."""
    path = F.col("path")
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    q = files.groupBy(F.col("project").alias("f_p")).agg(*[has(path.startswith(f"{d}/")).alias(d) for d in ("__tests__", "tests", "test")], has(path == "vitest.config.ts").alias("vitest"), has(path == "jest.config.js").alias("jest"))
    p = projects.join(q, F.col("project") == F.col("f_p"), "left")
    at = lambda where, sure: F.struct(F.lit(where).alias("location"), F.lit(sure).alias("confidence"))
    node = F.when(F.col("__tests__"), at("__tests__/", 1.0)).when(F.col("tests"), at("tests/", 1.0)).when(F.col("test"), at("test/", 1.0)).when(F.col("vitest") | F.col("jest"), at("*.test.ts", 0.85))
    found = F.when(F.col("type") == "node", node).when(F.col("type") == "go", at("*_test.go", 1.0)).when((F.col("type") == "rust") & F.col("tests"), at("tests/", 1.0))
    return p.select("project", found.alias("x")).filter(F.col("x").isNotNull()).select("project", "x.location", "x.confidence")


def structure_confidence(entry: Column, test: Column, architecture: Column) -> Column:
    """AGG-29: half the confidence of entry points, a quarter each of test locations and architecture."""
    return entry * 0.5 + test * 0.25 + architecture * 0.25


#: Prefixes of branches that no person made.
BOTS = ("dependabot/", "renovate/", "snyk-", "greenkeeper/", "imgbot/")


def branch_habits(merges: DataFrame, branches: DataFrame) -> DataFrame:
    """FLT-12, AGG-32: (project, prefix, uses) of the commonest branch prefix: of the branches that ``merges(project, place, subject)``
    name, newest first, or, in a project whose merges name none, of ``branches(project, place, name)``. Bots' branches do not
    count; of equals the first seen is taken."""
    no_bot = ~F.exists(F.array(*[F.lit(b) for b in BOTS]), lambda b: F.col("name").startswith(b))
    named = merges.filter(F.col("place") < 50).select("project", "place", branch_of_merge(F.col("subject")).alias("name")).filter(F.col("name").isNotNull() & no_bot)
    has = named.select(F.col("project").alias("h_p")).distinct()
    own = branches.select("project", "place", F.regexp_replace("name", "^origin/", "").alias("name")).filter(no_bot & ~F.col("name").contains(" -> ") & (F.col("name") != "HEAD"))
    used = named.unionByName(own.join(has, F.col("project") == F.col("h_p"), "left_anti"))
    prefixed = used.select("project", "place", F.regexp_extract("name", "^([^/]+/)", 1).alias("prefix")).filter(F.col("prefix") != "")
    n = prefixed.groupBy("project", "prefix").agg(F.count("*").alias("uses"), F.min("place").alias("first"))
    return n.groupBy("project").agg(F.min_by(F.struct("prefix", "uses"), F.struct(-F.col("uses"), F.col("first"))).alias("x")).select("project", "x.prefix", "x.uses")


def recent_activity(commits: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-30: of ``commits(project, at, author, files)`` before ``now(project, now)``: (project, days, contributors, weeks) and
    (project, file, commits), the ten files of the product with most commits.

    The window is thirty days, fourteen where these have over 300 commits; weeks
    are the commits of the last four, the newest first, the rest of 28 days in
    the last. Files count if they are sources, or Markdown below ``src``.
    """
    day = 86_400
    c = commits.join(now, "project").withColumn("age", F.unix_timestamp("now") - F.unix_timestamp("at")).filter(F.col("age").between(0, 30 * day))
    size = c.groupBy(F.col("project").alias("s_p")).agg(F.count("*").alias("n")).select("s_p", F.when(F.col("n") > 300, 14).otherwise(30).alias("days"))
    sized = c.join(size, F.col("project") == F.col("s_p"))
    inside = F.col("age") <= F.col("days") * day
    week = lambda i: F.count_if((F.col("age") <= 28 * day) & (F.least(F.floor(F.col("age") / (7 * day)), F.lit(3)) == i))
    summary = sized.groupBy("project", "days").agg(F.count_distinct(F.when(inside, F.col("author"))).alias("contributors"), F.array(*[week(i) for i in range(4)]).alias("weeks"))
    files = sized.filter(inside).select("project", F.explode("files").alias("file"))
    ext = F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)
    counted = ext.isin("ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "rb", "swift", "kt") | ((ext == "md") & F.col("file").rlike("(^|/)src/"))
    n = files.filter(counted & ~is_aside(F.col("file"), 3)).groupBy("project", "file").agg(F.count("*").alias("commits"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("commits"), "file"))
    return summary, n.withColumn("r", rank).filter(F.col("r") <= 10).select("project", "file", "commits")
