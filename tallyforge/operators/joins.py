"""Joins over the ledger: co-change, path matching, coverage, bands, overlays, merges.

None of these plans a nested loop: fuzzy path matches are hash joins on the base
name with a residual, prefix matches are hash joins on exploded ancestors, bands
are hash joins or windows over counts per line, and pairings by place are hash
joins on the place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.paths import ancestors, base_name, endings, is_test_path, same_file, stem
from tallyforge.operators.rows import running_total


def numbered(df: DataFrame, part: list[str], order: list[str], bucket: Column, out: str = "nth") -> DataFrame:
    """Adds the place (from 1) of each row in ``order`` within ``part``, counted in two levels."""
    return running_total(df.withColumn("__one", F.lit(1).cast("bigint")), part, order, bucket, "__one", out).drop("__one")


#: Directories that hold the sources or the tests of what stands beside them.
SIDES = ("src", "test", "tests", "__tests__")


def _is_test_name(p: Column) -> Column:
    return F.lower(F.try_element_at(F.split(base_name(p), r"\."), F.lit(-2))).isin("test", "spec")


def mirrored(p: Column) -> Column:
    """The segments of a path without those in ``SIDES`` and without the test part of its name: a file and its own test agree."""
    segments, parts = F.split(p, "/"), F.split(base_name(p), r"\.")
    folders = F.filter(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda s: ~F.lower(s).isin(*SIDES))
    plain = F.when(_is_test_name(p) & (F.size(parts) > 2), F.concat(F.slice(parts, F.lit(1), F.size(parts) - 2), F.slice(parts, -1, 1))).otherwise(parts)
    return F.array_join(F.concat(folders, F.array(F.array_join(plain, "."))), "/")


def own_test(a: Column, b: Column, match: Callable[[Column, Column], Column] = same_file) -> Column:
    """Whether one of two files is the test of the other; ``match`` (UDX-04) compares their mirrored paths.

    Where one is a bare name there are no directories to compare, and stems decide.
    """
    test = lambda c: F.coalesce(_is_test_name(c) & (F.size(F.split(base_name(c), r"\.")) > 2), F.lit(False))
    bare = ~a.contains("/") | ~b.contains("/")
    return (test(a) != test(b)) & F.when(bare, stem(a) == stem(b)).otherwise(match(mirrored(a), mirrored(b)))


def cochange(touched: DataFrame, edges: DataFrame, nodes: DataFrame, least_touches: int = 3, least_together: int = 2, most_files: int = 40) -> DataFrame:
    """JN-01, JN-02, SET-04: co-change partners of every file, told apart by the import graph.

    ``touched(project, entry_idx, file)`` once each. Touches count all entries;
    pairs come from entries of at most ``most_files`` files. Files with fewer
    touches than the gate are left out before pairing, since no pair of theirs
    can pass. A file and its own test are no partners. ``relation`` is imports
    (an edge either way), hidden (both in the graph, no edge) or unknown.
    """
    touches = touched.groupBy("project", "file").agg(F.count("*").alias("touches")).filter(F.col("touches") >= least_touches)
    small = touched.groupBy(F.col("entry_idx").alias("s_e")).agg(F.count("*").alias("n")).filter(F.col("n") <= most_files)
    kept = touched.join(small, F.col("entry_idx") == F.col("s_e"), "left_semi")
    t = touches.select(F.col("project").alias("t_p"), F.col("file").alias("t_f"))
    kept = kept.join(t, F.col("project").eqNullSafe(F.col("t_p")) & (F.col("file") == F.col("t_f")), "left_semi")
    # equal lists of files are one with a weight; a list has ``most_files`` at most, and its pairs are enumerated once
    lists = kept.groupBy("project", "entry_idx").agg(F.array_sort(F.collect_list("file")).alias("files")).filter(F.size("files") > 1).groupBy("project", "files").agg(F.count("*").alias("weight"))
    first = lists.select("project", "files", "weight", F.explode("files").alias("file_a"))
    both = first.select("project", "file_a", F.explode(F.filter("files", lambda y: y > F.col("file_a"))).alias("file_b"), "weight")
    pairs = both.groupBy("project", "file_a", "file_b").agg(F.sum("weight").alias("together"))
    pairs = pairs.filter((F.col("together") >= least_together) & ~own_test(F.col("file_a"), F.col("file_b")))
    # edges in one direction: the pair is ordered
    link = edges.select(F.col("project").alias("e_p"), F.least("src", "dst").alias("e_a"), F.greatest("src", "dst").alias("e_b")).distinct()
    na, nb = nodes.select(F.col("project").alias("na_p"), F.col("file").alias("na")), nodes.select(F.col("project").alias("nb_p"), F.col("file").alias("nb"))
    joined = (
        pairs.join(link, F.col("project").eqNullSafe(F.col("e_p")) & (F.col("file_a") == F.col("e_a")) & (F.col("file_b") == F.col("e_b")), "left")
        .join(na, F.col("project").eqNullSafe(F.col("na_p")) & (F.col("file_a") == F.col("na")), "left")
        .join(nb, F.col("project").eqNullSafe(F.col("nb_p")) & (F.col("file_b") == F.col("nb")), "left")
    )
    relation = F.when(F.col("na").isNull() | F.col("nb").isNull(), "unknown").when(F.col("e_a").isNotNull(), "imports").otherwise("hidden")
    pairs = joined.select("project", "file_a", "file_b", "together", relation.alias("relation"))
    both = F.explode(F.array(F.struct(F.col("file_a").alias("file"), F.col("file_b").alias("partner")), F.struct(F.col("file_b").alias("file"), F.col("file_a").alias("partner"))))
    return pairs.select("project", both.alias("x"), "together", "relation").select("project", "x.file", "x.partner", "together", "relation")


def path_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN-03: (project, path, match, exact) of two tables of distinct paths (project, path).

    Paths match that are equal or where one ends in the other after a ``/``. The
    endings of each path at a ``/`` are hashed against the whole paths of the
    other side, so only matches meet, however many files share a base name.
    """
    a = left.select("project", "path")
    b = right.select(F.col("project").alias("__p"), F.col("path").alias("match"))
    same = F.col("project").eqNullSafe(F.col("__p"))
    longer = a.withColumn("__end", F.explode(endings(F.col("path")))).join(b, same & (F.col("__end") == F.col("match")))
    shorter = a.join(b.withColumn("__end", F.explode(endings(F.col("match")))).filter(F.col("__end") != F.col("match")), same & (F.col("path") == F.col("__end")))
    return longer.select("project", "path", "match", (F.col("path") == F.col("match")).alias("exact")).unionByName(shorter.select("project", "path", "match", F.lit(False).alias("exact")))


def overlapping(rows: DataFrame, group: list[str], key: str, text: Column, above: float = 0.5) -> DataFrame:
    """SET-03: (a, b), a < b: rows of one group whose texts share more than ``above`` of the words of the shorter one.

    The shorter row must share more than ``above * n`` of its n words, so of any
    ``n - floor(above * n)`` of its words at least one: its rarest in the group
    are looked up among all words of the others, and what meets is verified. A
    text without words is in no pair.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    g = [f"__g{i}" for i in range(len(group))]
    own = rows.select(*[F.col(c).alias(n) for c, n in zip(group, g, strict=True)], F.col(key).alias("k"), words.alias("ws")).filter(F.size("ws") > 0)
    each = own.select(*g, "k", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    common = each.groupBy(*[F.col(x).alias(f"c_{x}") for x in g], F.col("w").alias("c_w")).agg(F.count("*").alias("c"))
    on = F.col("w") == F.col("c_w")
    for x in g:
        on = on & F.col(x).eqNullSafe(F.col(f"c_{x}"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("c", "w"))
    head = each.join(common, on).withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.floor(F.col("n") * above)).select(*g, F.col("k").alias("short"), F.col("n").alias("short_n"), "w")
    other = each.select(*[F.col(x).alias(f"o_{x}") for x in g], F.col("k").alias("long"), F.col("n").alias("long_n"), F.col("w").alias("o_w"))
    on = (F.col("w") == F.col("o_w")) & (F.col("short") != F.col("long")) & (F.col("short_n") <= F.col("long_n"))
    for x in g:
        on = on & F.col(x).eqNullSafe(F.col(f"o_{x}"))
    met = head.join(other, on).select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
    side = lambda x: own.select(F.col("k").alias(x), F.col("ws").alias(f"w_{x}"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    return both.filter(F.size(F.array_intersect("w_a", "w_b")) > above * F.least(F.size("w_a"), F.size("w_b"))).select("a", "b")


def resolved(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN-04: the one match of each path: the equal one, else the first by name."""
    return path_matches(left, right).groupBy("project", "path").agg(F.min_by("match", F.struct(~F.col("exact"), "match")).alias("match"), F.max("exact").alias("exact"))


def unique_basenames(names: DataFrame, files: DataFrame) -> DataFrame:
    """JN-27: paths without a directory resolved to the one file of the project with that name; others stay."""
    index = files.groupBy(F.col("project").alias("__p"), base_name(F.col("path")).alias("__b")).agg(F.count("*").alias("n"), F.min("path").alias("only"))
    bare = ~F.col("path").contains("/")
    return names.join(index, F.col("project").eqNullSafe(F.col("__p")) & (F.col("path") == F.col("__b")), "left").select("project", "path", F.when(bare & (F.col("n") == 1), F.col("only")).otherwise(F.col("path")).alias("resolved"))


def by_prefix(items: DataFrame, prefixes: DataFrame) -> DataFrame:
    """JN-14: the one prefix under which all of an item's matching files lie, null if there are none or several.

    ``items(project, item, file)`` and ``prefixes(project, prefix)``: the file's
    ancestors are hashed against the prefixes.
    """
    up = items.select("project", "item", F.explode_outer(ancestors(F.col("file"))).alias("above"))
    p = prefixes.select(F.col("project").alias("__p"), "prefix")
    hit = up.join(p, F.col("project").eqNullSafe(F.col("__p")) & (F.col("above") == F.col("prefix")), "left")
    return hit.groupBy("project", "item").agg(F.count_distinct("prefix").alias("n"), F.min("prefix").alias("one")).select("project", "item", F.when(F.col("n") == 1, F.col("one")).alias("prefix"))


def all_hold(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """JN-19: (project, rule) where every trigger of the rule is a fact of the project (relational division).

    ``facts(project, fact)``, ``rules(rule, trigger)``; the rules are a small dictionary.
    """
    need = rules.groupBy("rule").agg(F.count_distinct("trigger").alias("need"))
    hit = facts.distinct().join(F.broadcast(rules.distinct()), F.col("fact") == F.col("trigger")).groupBy("project", "rule").agg(F.count("*").alias("have"))
    return hit.join(F.broadcast(need), "rule").filter(F.col("have") == F.col("need")).select("project", "rule")


def near_lines(rows: DataFrame, within: int = 20) -> DataFrame:
    """JN-21: how many rows of the same file lie within so many lines, for each (project, file, line) with a row.

    Rows are counted per line first, so a file's window holds its lines, not its rows.
    """
    lines = rows.filter(F.col("file").isNotNull() & F.col("line").isNotNull()).groupBy("project", "file", "line").agg(F.count("*").alias("here"))
    w = Window.partitionBy("project", "file").orderBy("line").rangeBetween(-within, within)
    return lines.withColumn("near", F.sum("here").over(w))


def above_within(marks: DataFrame, rows: DataFrame, reach: int = 5) -> DataFrame:
    """JN-22: (project, file, line, marks): marks 1 to ``reach`` lines above a row, by hashing each mark's lines below it."""
    m = marks.groupBy("project", "file", "line").agg(F.count("*").alias("n"))
    below = m.select(F.col("project").alias("m_p"), F.col("file").alias("m_f"), F.explode(F.sequence(F.col("line") + 1, F.col("line") + reach)).alias("m_l"), "n")
    at = rows.select("project", "file", "line").distinct()
    hit = at.join(below, F.col("project").eqNullSafe(F.col("m_p")) & (F.col("file") == F.col("m_f")) & (F.col("line") == F.col("m_l")))
    return hit.groupBy("project", "file", "line").agg(F.sum("n").alias("marks"))


def zipped(a: DataFrame, b: DataFrame, key: list[str], nth: str = "nth") -> DataFrame:
    """JN-23: the i-th row of ``a`` with the i-th of ``b`` per key; rows without a partner drop out."""
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    on = F.col(nth) == F.col(f"b_{nth}")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return a.join(right, on).drop(*[f"b_{k}" for k in [*key, nth]])


def coverage(scope: DataFrame, links: DataFrame, waivers: DataFrame, weak: tuple[str, ...] = ("exists", "contains", "truthy")) -> DataFrame:
    """JN-11: every criterion of a scope as pinned by an assertion, waived by judgment or as retired, or uncovered; a link beats a waiver.

    ``scope(item, ac)``, ``links(item, ac, matcher)``, ``waivers(item, ac, way)``,
    one way each. ``weak_only``: all its links have a weak matcher.
    """
    by_ac = links.groupBy(F.col("item").alias("l_i"), F.col("ac").alias("l_ac")).agg(F.count("*").alias("links"), F.bool_and(F.coalesce(F.col("matcher"), F.lit("")).isin(*weak)).alias("weak_only"))
    waived = waivers.groupBy(F.col("item").alias("w_i"), F.col("ac").alias("w_ac")).agg(F.max("way").alias("way"))
    joined = scope.join(by_ac, (F.col("item") == F.col("l_i")) & (F.col("ac") == F.col("l_ac")), "left").join(waived, (F.col("item") == F.col("w_i")) & (F.col("ac") == F.col("w_ac")), "left")
    state = F.when(F.col("links") > 0, "pinned").when(F.col("way").isNotNull(), F.col("way")).otherwise("uncovered")
    return joined.select("item", "ac", state.alias("state"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("weak_only", F.lit(False)).alias("weak_only"))


def merged(existing: DataFrame, fresh: DataFrame, key: list[str], machine: list[str], user: list[str]) -> DataFrame:
    """JN-29: a full outer merge by key: machine fields from the fresh row, user fields from the existing one, each with the other as fallback; rows of either side stay."""
    e = existing.select(*[F.col(c).alias(f"e_{c}") for c in existing.columns])
    f = fresh.select(*[F.col(c).alias(f"f_{c}") for c in fresh.columns])
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"e_{k}").eqNullSafe(F.col(f"f_{k}"))
    both = e.withColumn("__e", F.lit(1)).join(f.withColumn("__f", F.lit(1)), on, "full")
    pick = lambda c, first, second: F.coalesce(F.col(f"{first}_{c}"), F.col(f"{second}_{c}")).alias(c)
    state = F.when(F.col("__e").isNull(), "added").when(F.col("__f").isNull(), "kept").otherwise("refreshed")
    return both.select(*[pick(c, "e", "f") for c in key], *[pick(c, "f", "e") for c in machine], *[pick(c, "e", "f") for c in user], state.alias("state"))


def collision_names(names: DataFrame) -> DataFrame:
    """JN-26: (project, path, name): the last segment, with its parent's before it where several paths of a project end alike.

    Paths are counted by project and last segment with partial sums, and the
    counts joined, so a segment that very many paths end in is no task's window.
    """
    last = names.withColumn("__last", base_name(F.col("path")))
    count = last.groupBy(F.col("project").alias("__p"), F.col("__last").alias("__l")).agg(F.count("*").alias("__n"))
    parent = F.try_element_at(F.split("path", "/"), F.lit(-2))
    name = F.when((F.col("__n") > 1) & parent.isNotNull(), F.concat_ws("-", parent, "__last")).otherwise(F.col("__last"))
    return last.join(count, F.col("project").eqNullSafe(F.col("__p")) & (F.col("__last") == F.col("__l"))).select("project", "path", name.alias("name"))


def tests_of(files: DataFrame) -> DataFrame:
    """Files of a project and whether they are tests."""
    return files.select("project", "path", is_test_path(F.col("path")).alias("is_test"))
