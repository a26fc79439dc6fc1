"""Analytics over the ledger: findings and entries of many projects.

Every operator takes ``findings`` (project, entry_idx, f_idx, id, category,
summary, file, severity, suggested_action, status, promoted_to, resolves) or
``entries`` (project, entry_idx, slug, ...), each row once, and answers for every
project. The order of a project's entries is that of ``entry_idx``, never that
of a date.

A null or empty status means active. Severities and actions that are null or
unknown count as unclassified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numeric import half_up
from tallyforge.operators.rows import running_total

SEVERITIES = ("risk", "debt", "observation")
ACTIONS = ("promote", "scope", "monitor", "acknowledge")
#: Entries of a project whose positions are counted in one task.
CHAIN_BUCKET = 20_000


def given(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def is_active(status: Column) -> Column:
    return F.coalesce(given(status), F.lit("active")) == "active"


def classified(c: Column, known: tuple[str, ...]) -> Column:
    return F.when(c.isin(*known), c).otherwise("unclassified")


def positions(entries: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 1, in the order of the project's chain) and ``runs``, the chain's length.

    Positions are counted in two levels, so no task holds a project.
    """
    one = entries.withColumn("__one", F.lit(1).cast("bigint"))
    placed = running_total(one, ["project"], ["entry_idx"], F.floor(F.col("entry_idx") / CHAIN_BUCKET), "__one", "pos").drop("__one")
    runs = entries.groupBy(F.col("project").alias("__p")).agg(F.count("*").alias("runs"))
    return placed.join(runs, F.col("project").eqNullSafe(F.col("__p"))).drop("__p")


def chain_health(findings: DataFrame) -> DataFrame:
    """AGG-01: per project the findings by status, and the active ones by severity and action, in one pass.

    An unknown status counts as active in the totals but not in the splits.
    """
    active = is_active(F.col("status"))
    sev, act = classified(F.col("severity"), SEVERITIES), classified(F.col("suggested_action"), ACTIONS)
    return findings.groupBy("project").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.col("status"), F.lit("")).isin("closed", "promoted") == F.lit(False)).alias("active"),
        F.count_if(F.col("status") == "closed").alias("closed"),
        F.count_if(F.col("status") == "promoted").alias("promoted"),
        *[F.count_if(active & (sev == s)).alias(f"severity_{s}") for s in (*SEVERITIES, "unclassified")],
        *[F.count_if(active & (act == a)).alias(f"action_{a}") for a in (*ACTIONS, "unclassified")],
    )


def risk_counts(findings: DataFrame) -> DataFrame:
    """(project, entry_idx, risks) of entries with at least one finding that has a severity."""
    return findings.filter(given(F.col("severity")).isNotNull()).groupBy("project", "entry_idx").agg(F.count_if(F.col("severity") == "risk").alias("risks"))


def trajectory(findings: DataFrame, window: int = 5, least: int = 10) -> DataFrame:
    """AGG-02, AGG-03, WIN-01, WIN-02: risks per classified entry, overall and over the last ``window``, and the trend.

    The trend compares the means of the two halves (the first half is the
    shorter) and needs ``least`` classified entries.
    """
    risks = positions(risk_counts(findings))
    half = F.floor(F.col("runs") / 2)
    means = risks.groupBy("project").agg(
        F.count("*").alias("classified"),
        half_up(F.avg("risks"), 1).alias("risks_all"),
        half_up(F.avg(F.when(F.col("pos") > F.col("runs") - window, F.col("risks"))), 1).alias("risks_recent"),
        F.avg(F.when(F.col("pos") <= half, F.col("risks"))).alias("__first"),
        F.avg(F.when(F.col("pos") > half, F.col("risks"))).alias("__second"),
    )
    trend = F.when(F.col("classified") < least, "insufficient_data").when(F.col("__second") < F.col("__first"), "improving").when(F.col("__second") > F.col("__first"), "worsening").otherwise("stable")
    open_ = findings.groupBy(F.col("project").alias("__p")).agg(F.count_if(given(F.col("severity")).isNull()).alias("unclassified"))
    return (
        open_.join(means, F.col("project").eqNullSafe(F.col("__p")), "left")
        .select(
            F.col("__p").alias("project"),
            "unclassified",
            F.coalesce("classified", F.lit(0)).alias("classified"),
            "risks_all",
            "risks_recent",
            F.when(F.col("classified").isNull(), "no_classified_data").otherwise(trend).alias("trend"),
        )
    )


def hot_modules(findings: DataFrame, top: int | None = 5, least_findings: int = 3, least_entries: int = 2) -> DataFrame:
    """AGG-04: files with active findings from several entries, most findings first, ``top`` per project.

    Equals go by the file's first finding. Grouping is by project and file, so
    the top list ranks groups, not rows.
    """
    active = findings.filter(is_active(F.col("status")) & given(F.col("file")).isNotNull())
    sev = classified(F.col("severity"), SEVERITIES)
    grouped = active.groupBy("project", "file").agg(
        F.count("*").alias("findings"),
        F.count_distinct("entry_idx").alias("entries"),
        *[F.count_if(sev == s).alias(s) for s in (*SEVERITIES, "unclassified")],
        F.min(F.struct("entry_idx", "f_idx")).alias("__first"),
    )
    hot = grouped.filter((F.col("findings") >= least_findings) & (F.col("entries") >= least_entries))
    order = Window.partitionBy("project").orderBy(F.desc("findings"), "__first", "file")
    ranked = hot.withColumn("rank", F.row_number().over(order))
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).drop("__first")


def promotion_candidates(findings: DataFrame, least: int = 2) -> DataFrame:
    """AGG-05: active findings to promote, and recurring ones to scope by severity, category and file (latest shown).

    Recurrence counts findings, also of one entry.
    """
    active = findings.filter(is_active(F.col("status")))
    direct = active.filter(F.col("suggested_action") == "promote").select("project", "suggested_action", F.col("id"), F.coalesce(given(F.col("severity")), F.lit("unclassified")).alias("severity"), "file", "entry_idx", F.lit(None).cast("bigint").alias("recurrence"))
    scope = active.filter(F.col("suggested_action") == "scope")
    keys = [F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in ("severity", "category", "file")]
    grouped = scope.groupBy("project", *keys).agg(F.count("*").alias("recurrence"), F.max_by(F.struct("id", "severity", "file", "entry_idx"), F.struct("entry_idx", "f_idx")).alias("last"))
    recurring = grouped.filter(F.col("recurrence") >= least).select("project", F.lit("scope").alias("suggested_action"), "last.id", F.coalesce(given(F.col("last.severity")), F.lit("unclassified")).alias("severity"), "last.file", "last.entry_idx", "recurrence")
    return direct.unionByName(recurring)


def promotion_effect(findings: DataFrame, entries: DataFrame, least: int = 5) -> DataFrame:
    """AGG-06, JN-09: matches of each promoted finding in later entries of its project.

    A match has the same severity, category and file (null files match). Matches
    are counted per entry and kind first, then summed over what comes after by a
    running total, so no promoted finding is joined with every later row.
    """
    kind = ["project", "severity", "category", "file"]
    per = findings.filter(F.col("severity").isNotNull() & F.col("category").isNotNull()).groupBy(*kind, "entry_idx").agg(F.count("*").alias("__n"))
    upto = running_total(per, kind, ["entry_idx"], F.floor(F.col("entry_idx") / CHAIN_BUCKET), "__n", "__upto")
    whole = per.groupBy(*kind).agg(F.sum("__n").alias("__all"))
    promoted = findings.filter(F.col("status") == "promoted").withColumns({"severity": F.coalesce("severity", F.lit("")), "category": F.coalesce("category", F.lit(""))})
    # a promoted finding is one of its own kind, so its own entry is in the running total where it has both texts
    a, b = upto.select(*[F.col(c).alias(f"u_{c}") for c in [*kind, "entry_idx"]], "__upto"), whole.select(*[F.col(c).alias(f"w_{c}") for c in kind], "__all")
    on_a = [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in [*kind, "entry_idx"]]
    on_b = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in kind]
    place = positions(entries.select("project", "entry_idx")).select(F.col("entry_idx").alias("e_idx"), (F.col("runs") - F.col("pos")).alias("later"))
    later = promoted.join(a, on_a, "left").join(b, on_b, "left").join(place, F.col("entry_idx") == F.col("e_idx"))
    matches = F.coalesce(F.col("__all"), F.lit(0)) - F.coalesce(F.col("__upto"), F.lit(0))
    pct = F.when(F.col("later") >= least, half_up((1 - matches / F.col("later")) * 100))
    return later.select("project", "entry_idx", "f_idx", "id", "later", matches.alias("matches"), pct.alias("reduction_pct")).withColumn("effect", F.when(F.col("later") < least, "tracking").when(F.col("reduction_pct") > 0, "effective").otherwise("ineffective"))


def first_pass(entries: DataFrame) -> DataFrame:
    """AGG-07: share of entries without a rejection, in whole percent, and failures caught."""
    return entries.groupBy("project").agg(
        F.count("*").alias("runs"),
        F.count_if(F.coalesce("rejection_cycles", F.lit(0)) == 0).alias("first_pass"),
        half_up(F.avg(F.when(F.coalesce("rejection_cycles", F.lit(0)) == 0, 100.0).otherwise(0.0))).alias("first_pass_pct"),
        F.sum(F.when(F.col("previous_failures").isNotNull(), F.size("previous_failures")).otherwise(0)).alias("caught"),
    )


def stage_medians(entries: DataFrame, least: int = 3) -> DataFrame:
    """AGG-08: lower medians of minutes per stage over entries with a total above zero, from ``least`` entries on."""
    timed = entries.filter(F.col("timing.total_minutes") > 0).select("project", F.col("timing.total_minutes").alias("total"), "timing.think", "timing.plan", "timing.build", "timing.verify")
    median = [F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"median_{c}") for c in ("total", "think", "plan", "build", "verify")]
    return timed.groupBy("project").agg(F.count("*").alias("timed"), *median).filter(F.col("timed") >= least)


def rounded_medians(entries: DataFrame) -> DataFrame:
    """AGG-09: medians of minutes above zero, the mean of two middles rounded half up."""
    stages = ("total_minutes", "think", "plan", "build", "verify")
    picked = entries.select("project", *[F.when(F.col(f"timing.{s}") > 0, F.col(f"timing.{s}")).alias(s) for s in stages])
    return picked.groupBy("project").agg(*[half_up(F.percentile(s, F.lit(0.5))).alias(f"median_{s}") for s in stages])


def corpus_totals(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG-10: entries, assertions, findings and entries with rejections over all projects."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    left = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size("assertions")), F.lit(0)).alias("assertions"), F.count_if(F.col("rejection_cycles") > 0).alias("rejected"))
    return left.crossJoin(findings.agg(F.count("*").alias("findings")))  # one row each


def staleness(findings: DataFrame, touched: DataFrame, entries: DataFrame, small: int = 5) -> DataFrame:
    """AGG-11, JN-08, WIN-03: active findings whose file was touched by later entries, with a confidence.

    ``touched`` holds (project, entry_idx, file) once each. Later touches come
    from a running count per file, and the touch rate from its total, so a file
    that every entry touches costs no join of findings with entries.
    With fewer than ``small`` later entries 3 touches are high, else medium.
    From then on the expected number is max(3, ceil(later * rate)): reaching it
    is high, half of it medium, less is left out.
    """
    whole = touched.groupBy("project", "file").agg(F.count("*").alias("__all"))
    place = positions(entries.select("project", "entry_idx")).select(F.col("entry_idx").alias("e_idx"), "pos", "runs")
    active = findings.filter(is_active(F.col("status")) & given(F.col("file")).isNotNull()).select("project", "entry_idx", "f_idx", "id", "severity", "file")
    # touches up to a finding's entry: a running count over touches with the findings' places among them, in two levels
    places = active.select("project", "file", "entry_idx", F.lit(0).cast("bigint").alias("__v"), F.lit(1).alias("__m")).distinct()
    marks = touched.select("project", "file", "entry_idx", F.lit(1).cast("bigint").alias("__v"), F.lit(0).alias("__m")).unionByName(places)
    upto = running_total(marks, ["project", "file"], ["entry_idx", "__m"], F.floor(F.col("entry_idx") / CHAIN_BUCKET), "__v", "__before")
    at = upto.filter(F.col("__m") == 1).select(F.col("project").alias("m_p"), F.col("file").alias("m_f"), F.col("entry_idx").alias("m_e"), "__before")
    w = whole.select(F.col("project").alias("w_p"), F.col("file").alias("w_f"), "__all")
    joined = (
        active.join(at, F.col("project").eqNullSafe(F.col("m_p")) & (F.col("file") == F.col("m_f")) & (F.col("entry_idx") == F.col("m_e")))
        .join(w, F.col("project").eqNullSafe(F.col("w_p")) & (F.col("file") == F.col("w_f")))
        .join(place, F.col("entry_idx") == F.col("e_idx"))
    )
    joined = joined.withColumns({"touches": F.col("__all") - F.col("__before"), "later": F.col("runs") - F.col("pos")}).filter(F.col("touches") > 0)
    expected = F.greatest(F.lit(3), F.ceil(F.col("later") * (F.col("__all") / F.col("runs"))))
    level = F.when(F.col("later") < small, F.when(F.col("touches") >= 3, "high").otherwise("medium")).when(F.col("touches") >= expected, "high").when(F.col("touches") >= F.ceil(expected * 0.5), "medium")
    return joined.withColumn("confidence", level).filter(F.col("confidence").isNotNull()).select("project", "entry_idx", "f_idx", "id", "severity", "file", "touches", "later", "confidence")


def resolution_claims(findings: DataFrame) -> DataFrame:
    """JN-10, WIN-04: ids that an upstream finding says it resolves and that are still active; the last claim of each counts.

    The payload of an id is that of its last finding. A status other than
    active, also an empty one, is not active here.
    """
    last = findings.filter(given(F.col("id")).isNotNull()).groupBy("project", "id").agg(F.max_by(F.struct(F.coalesce("status", F.lit("active")).alias("status"), "file", "severity"), F.struct("entry_idx", "f_idx")).alias("o"))
    open_ = last.filter(F.col("o.status") == "active").select(F.col("project").alias("o_p"), F.col("id").alias("o_id"), "o")
    claims = findings.filter(F.col("category") == "upstream").select("project", "entry_idx", "f_idx", F.coalesce("id", F.lit("unknown")).alias("upstream_id"), F.posexplode("resolves").alias("at", "referenced_id"))
    joined = claims.join(open_, F.col("project").eqNullSafe(F.col("o_p")) & (F.col("referenced_id") == F.col("o_id")))
    kept = joined.groupBy("project", "referenced_id").agg(F.max_by("upstream_id", F.struct("entry_idx", "f_idx", "at")).alias("upstream_id"), F.max("entry_idx").alias("entry_idx"), F.max("o").alias("o"))
    return kept.select("project", "referenced_id", "upstream_id", "entry_idx", F.col("o.file").alias("file"), F.coalesce("o.severity", F.lit("unclassified")).alias("severity"))


def audit_by_file(findings: DataFrame, per_file: int = 3, files: int = 8) -> DataFrame:
    """AGG-13, WIN-05: per project the ``files`` with most active findings, ``per_file`` findings of each, and how many more there are."""
    active = findings.filter(is_active(F.col("status"))).withColumn("file", F.coalesce(given(F.col("file")), F.lit("(no file)")))
    rank = F.expr("CASE severity WHEN 'risk' THEN 0 WHEN 'debt' THEN 1 WHEN 'observation' THEN 2 ELSE 3 END")
    counts = active.groupBy("project", "file").agg(F.count("*").alias("in_file"))
    top = counts.withColumn("file_rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("in_file"), "file"))).filter(F.col("file_rank") <= files)
    top = top.select(F.col("project").alias("t_p"), F.col("file").alias("t_f"), "in_file", "file_rank")
    joined = active.join(top, F.col("project").eqNullSafe(F.col("t_p")) & (F.col("file") == F.col("t_f"))).withColumn("__rank", rank)
    order = Window.partitionBy("project", "file").orderBy("__rank", F.desc("entry_idx"), "f_idx")
    shown = joined.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_file)
    return shown.select("project", "file_rank", "file", "in_file", F.greatest(F.col("in_file") - per_file, F.lit(0)).alias("more"), "place", "id", "severity", "entry_idx")


def severity_by_action(findings: DataFrame) -> DataFrame:
    """AGG-14: active findings by severity and action with the sums of each (``all``) and of both."""
    active = findings.filter(is_active(F.col("status"))).select(classified(F.col("severity"), SEVERITIES).alias("severity"), classified(F.col("suggested_action"), ACTIONS).alias("action"))
    return active.cube("severity", "action").agg(F.count("*").alias("findings"), F.grouping_id().alias("g")).select(F.when(F.col("g") >= 2, "all").otherwise(F.col("severity")).alias("severity"), F.when(F.col("g") % 2 == 1, "all").otherwise(F.col("action")).alias("action"), "findings")


def by_surface(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG-16: runs, active findings and the last entry of each surface (``Unscoped`` where there is none)."""
    named = entries.select("project", "entry_idx", F.coalesce(given(F.col("surface")), F.lit("Unscoped")).alias("surface"))
    active = findings.filter(is_active(F.col("status"))).groupBy(F.col("entry_idx").alias("f_e")).agg(F.count("*").alias("n"))
    joined = named.join(active, F.col("entry_idx") == F.col("f_e"), "left")
    return joined.groupBy("project", "surface").agg(F.count("*").alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("active"), F.max("entry_idx").alias("latest"))


def dashboard_modules(findings: DataFrame, entries: DataFrame, least: int = 2) -> DataFrame:
    """AGG-17: files with active findings from ``least`` different work items."""
    slugs = entries.select(F.col("entry_idx").alias("e"), "slug")
    active = findings.filter(is_active(F.col("status")) & given(F.col("file")).isNotNull()).join(slugs, F.col("entry_idx") == F.col("e"))
    return active.groupBy("project", "file").agg(F.count("*").alias("findings"), F.count_distinct("slug").alias("items")).filter(F.col("items") >= least)


def risk_scores(findings: DataFrame) -> DataFrame:
    """AGG-18: active findings per file weighted 3 (risk), 2 (debt), 1 (observation), 0."""
    weight = F.expr("CASE severity WHEN 'risk' THEN 3 WHEN 'debt' THEN 2 WHEN 'observation' THEN 1 ELSE 0 END")
    active = findings.filter(is_active(F.col("status")) & given(F.col("file")).isNotNull())
    return active.groupBy("project", "file").agg(F.sum(weight).cast("bigint").alias("score"), F.count("*").alias("findings"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """AGG-19: counts by severity of each entry as text, gravest first (``2 risk, 1 debt``)."""
    counts = findings.groupBy("entry_idx").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count_if(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))).alias("unclassified"))
    parts = [F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in (*SEVERITIES, "unclassified")]
    return counts.select("entry_idx", F.concat_ws(", ", *parts).alias("rollup"))


def health_change(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """AGG-12, SET-02: hot modules that each project's last entry made so, and those it ended: the chain against the chain without it."""
    last = entries.groupBy("project").agg(F.max("entry_idx").alias("last"))
    marked = findings.join(last.withColumnRenamed("project", "l_p"), F.col("project").eqNullSafe(F.col("l_p")))
    now = hot_modules(findings, top=None).select("project", "file", F.lit(1).alias("now"))
    before = hot_modules(marked.filter(F.col("entry_idx") < F.col("last")).drop("l_p", "last"), top=None).select(F.col("project").alias("b_p"), F.col("file").alias("b_f"), F.lit(1).alias("before"))
    both = now.join(before, F.col("project").eqNullSafe(F.col("b_p")) & (F.col("file") == F.col("b_f")), "full")
    return both.filter(F.col("now").isNull() | F.col("before").isNull()).select(F.coalesce("project", "b_p").alias("project"), F.coalesce("file", "b_f").alias("file"), F.when(F.col("before").isNull(), "new").otherwise("gone").alias("change"))
