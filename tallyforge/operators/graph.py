"""The import graph: specifiers resolved to files, degrees, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand behind a specifier without an extension, in the order tried (fixed values).
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")


def _joined(folder: Column, specifier: Column) -> Column:
    """A relative specifier applied to a folder: ``.`` and ``..`` taken out, segment by segment."""
    parts = F.concat(F.split(folder, "/"), F.split(specifier, "/"))
    step = lambda a, x: F.when((x == ".") | (x == ""), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """JN-28: (project, src, specifier, dst): the file of each import, null where it is none of the project's.

    ``imports(project, src, specifier)``, ``files(project, path)``; ``aliases(project,
    prefix, target)`` maps prefixes such as ``@/`` to folders, ``packages(project,
    name, folder)`` names to workspace folders (their ``src`` and root are tried).
    Candidates are hashed against the files and the first in order is taken; an
    extension ``.js`` also stands for ``.ts``. Imports of itself are left out.
    """
    folder = F.regexp_extract("src", "^(.*)/[^/]*$", 1)
    spec = F.col("specifier")
    base = imports.select("project", "src", "specifier", F.when(spec.startswith("."), _joined(folder, spec)).alias("base"), F.lit(0).alias("tier"))
    tries = [base.filter(F.col("base").isNotNull())]
    if aliases is not None:
        a = aliases.select(F.col("project").alias("a_p"), "prefix", "target")
        hit = imports.join(a, F.col("project").eqNullSafe(F.col("a_p")) & (F.regexp_extract(spec, "^([^/]*/)", 1) == F.col("prefix")))
        tries.append(hit.select("project", "src", "specifier", _joined(F.col("target"), F.expr("substring(specifier, length(prefix) + 1)")).alias("base"), F.lit(1).alias("tier")))
    if packages is not None:
        p = packages.select(F.col("project").alias("p_p"), F.col("name").alias("p_n"), F.col("folder").alias("p_f"))
        name = F.regexp_extract(spec, "^(@[^/]+/[^/]+|[^/@.][^/]*)", 1)
        hit = imports.join(p, F.col("project").eqNullSafe(F.col("p_p")) & (name == F.col("p_n")))
        rest = F.regexp_replace(spec, "^(@[^/]+/[^/]+|[^/@.][^/]*)/?", "")
        for i, sub in enumerate(("src", "")):
            tries.append(hit.select("project", "src", "specifier", _joined(F.concat_ws("/", "p_f", F.lit(sub)), rest).alias("base"), F.lit(2 + i).alias("tier")))
    every = tries[0]
    for t in tries[1:]:
        every = every.unionByName(t)
    bare = F.regexp_replace("base", r"\.(js|jsx|mjs)$", "")
    shapes = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat("base", F.lit(s)).alias("path")) for i, s in enumerate(SUFFIXES)], *[F.struct(F.lit(20 + i).alias("rank"), F.concat(bare, F.lit(s)).alias("path")) for i, s in enumerate((".ts", ".tsx"))])
    candidates = every.select("project", "src", "specifier", "tier", F.explode(shapes).alias("c"))
    f = files.select(F.col("project").alias("f_p"), F.col("path").alias("f_path")).distinct()
    found = candidates.join(f, F.col("project").eqNullSafe(F.col("f_p")) & (F.col("c.path") == F.col("f_path")))
    best = found.groupBy(F.col("project").alias("b_p"), F.col("src").alias("b_s"), F.col("specifier").alias("b_i")).agg(F.min_by("f_path", F.struct("tier", "c.rank")).alias("dst"))
    out = imports.join(best, F.col("project").eqNullSafe(F.col("b_p")) & (F.col("src") == F.col("b_s")) & (spec == F.col("b_i")), "left").select("project", "src", "specifier", "dst")
    return out.filter(F.col("dst").isNull() | (F.col("dst") != F.col("src")))


def in_degrees(edges: DataFrame) -> DataFrame:
    """AGG-33: distinct importers of every file."""
    return edges.filter(F.col("dst").isNotNull()).select("project", "src", "dst").distinct().groupBy("project", "dst").agg(F.count("*").alias("in_degree"))


def unresolved(resolved: DataFrame) -> DataFrame:
    """AGG-33: relative imports per project that no file answers to."""
    return resolved.filter(F.col("dst").isNull() & F.col("specifier").startswith(".")).groupBy("project").agg(F.count("*").alias("unresolved"))
