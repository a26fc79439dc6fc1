"""Statistics: calibration, small-sample cells, scaling, running sums, allocation, tempo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numeric import half_up

#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom, and of the normal distribution (fixed values).
T95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
Z95 = 1.959964
#: Confidence buckets of the calibration error, closed at both ends, with gaps between them (fixed values).
ECE_BUCKETS = ((0.90, 1.00), (0.70, 0.89), (0.50, 0.69), (0.00, 0.49))


def calibration_error(rows: DataFrame, group: str, confidence: Column, correct: Column) -> DataFrame:
    """AGG-27: per group the mean gap between confidence and accuracy over the buckets that have rows.

    The buckets do not touch: a confidence of 0.895 is in none.
    """
    bucket = F.lit(None).cast("int")
    for i, (low, high) in enumerate(ECE_BUCKETS):
        bucket = F.when(confidence.between(low, high), i).otherwise(bucket)
    per = rows.select(F.col(group), confidence.alias("c"), correct.cast("double").alias("ok"), bucket.alias("b")).filter(F.col("b").isNotNull()).groupBy(group, "b").agg(F.abs(F.avg("c") - F.avg("ok")).alias("gap"), F.count("*").alias("n"))
    return per.groupBy(group).agg(F.avg("gap").alias("ece"), F.sum("n").alias("rows"))


def cells(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-35, FLT-15: n, mean, sample variance, deviation, error of the mean and 95 % interval per cell.

    Values that are null or no finite number are left out. A cell of one value
    has a mean only.
    """
    v = F.col(value)
    finite = long.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    stats = finite.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"))
    df = F.col("n") - 1
    t = F.when(df.between(1, len(T95)), F.try_element_at(F.array(*[F.lit(x) for x in T95]), F.greatest(df, F.lit(1)).cast("int"))).when(df > len(T95), F.lit(Z95))
    sem = F.sqrt(F.col("variance") / F.col("n"))
    return stats.withColumns({"sd": F.sqrt("variance"), "sem": sem, "ci_low": F.col("mean") - t * sem, "ci_high": F.col("mean") + t * sem})


def levels(rows: DataFrame, part: list[str], value: str, steps: int = 8) -> DataFrame:
    """AGG-31, SNK-08: values scaled to 0 ... steps-1 between the least and greatest of their part; 0 where all are equal.

    The two ends come from a partial aggregate joined back, so a part of any size is spread over all tasks.
    """
    ends = rows.groupBy(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(part)]).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    on = F.lit(True)
    for i, c in enumerate(part):
        on = on & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    low, high = F.col("__low"), F.col("__high")
    level = F.when(high > low, half_up((F.col(value) - low) / (high - low) * (steps - 1))).otherwise(F.lit(0))
    return rows.join(ends, on).withColumn("level", level).select(*rows.columns, "level")


def running_until(rows: DataFrame, part: list[str], order: list[str], value: str, is_end: Column) -> DataFrame:
    """WIN-07: (part..., total, steps): the sum of ``value`` over the rows before each part's first end row; parts without one sum all.

    The first end row is a minimum per part, and the rows before it are summed
    against it: no window, whatever the size of a part. Parts without a row before their end have no row.
    """
    at = F.struct(*order)
    first = rows.filter(is_end).groupBy(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(part)]).agg(F.min(at).alias("__first"))
    on = F.lit(True)
    for i, c in enumerate(part):
        on = on & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    before = rows.join(first, on, "left").filter(F.col("__first").isNull() | (at < F.col("__first")))
    return before.groupBy(*part).agg(F.sum(value).alias("total"), F.count("*").alias("steps"))


def stage_seconds(rows: DataFrame, part: list[str], at: str, order: list[str], cap: int = 86_400) -> DataFrame:
    """AGG-42, WIN-09: seconds between a row and the one before it, added up per part where they lie between 0 and ``cap``."""
    w = Window.partitionBy(*part).orderBy(*order)
    gap = F.unix_timestamp(at) - F.lag(F.unix_timestamp(at)).over(w)
    return rows.withColumn("__d", gap).groupBy(*part).agg(F.sum(F.when(F.col("__d").between(0, cap), F.col("__d"))).alias("seconds"), F.count_if(F.col("__d") > cap).alias("capped"))


def allocate(groups: DataFrame, budget: int, part: list[str]) -> DataFrame:
    """WIN-12: a budget shared out in proportion to ``n`` with at least one each; what rounding leaves goes to the largest.

    The floor of one can overshoot the budget when there are more groups than
    places, which the sampler's final cut takes care of.
    """
    w = Window.partitionBy(*part)
    whole = F.sum("n").over(w)
    share = F.greatest(F.floor(F.lit(budget) * F.col("n") / whole), F.lit(1))
    first = F.row_number().over(w.orderBy(F.desc("n"), "grp"))
    shared = groups.withColumns({"__share": F.when(whole <= budget, F.col("n")).otherwise(share), "__first": first, "__whole": whole})
    left = F.greatest(F.least(F.lit(budget), F.col("__whole")) - F.sum("__share").over(w), F.lit(0))
    return shared.withColumn("places", F.least(F.col("n"), F.col("__share") + F.when(F.col("__first") == 1, left).otherwise(0))).drop("__share", "__first", "__whole")


def water_fill(sizes: Column, cap: int) -> Column:
    """WIN-13: a cap shared by an array of sizes, shortest first: each takes at most an equal part of what is left."""
    state = F.struct(F.lit(cap).cast("bigint").alias("left"), F.size(sizes).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("used"))
    step = lambda a, x: F.struct((a["left"] - F.least(x, F.floor(a["left"] / F.greatest(a["n"], F.lit(1))))).alias("left"), (a["n"] - 1).alias("n"), (a["used"] + F.least(x, F.floor(a["left"] / F.greatest(a["n"], F.lit(1))))).alias("used"))
    return F.aggregate(F.array_sort(F.transform(sizes, lambda x: x.cast("bigint"))), state, step, lambda a: a["used"])


def water_levels(sizes: Column, cap: int) -> Column:
    """WIN-13: what each of an array of sizes keeps of a shared cap, in the array's order; null for null.

    Shorter ones are served first, each with an equal part of what is left at most.
    """
    placed = F.array_sort(F.filter(F.transform(sizes, lambda x, i: F.struct(x.cast("bigint").alias("size"), i.alias("i"))), lambda s: s["size"].isNotNull()))
    start = F.struct(F.lit(cap).cast("bigint").alias("left"), F.size(placed).cast("bigint").alias("n"), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>")).alias("kept"))

    def step(a: Column, s: Column) -> Column:
        own = F.least(s["size"], F.floor(a["left"] / F.greatest(a["n"], F.lit(1))))
        return F.struct((a["left"] - own).alias("left"), (a["n"] - 1).alias("n"), F.map_concat(a["kept"], F.create_map(s["i"], own)).alias("kept"))

    kept = F.aggregate(placed, start, step, lambda a: a["kept"])
    return F.transform(sizes, lambda _x, i: F.try_element_at(kept, i))


def alternating_minutes(saves: DataFrame, cap: int = 86_400) -> DataFrame:
    """AGG-42, WIN-09: (item, build, verify) minutes of ``saves(item, kind, at)``, kinds contract, build and verify.

    The first build is timed from the contract, each later one from the verify
    before it, each verify from the build of its number; times below zero or
    above ``cap`` seconds do not count. Saves are numbered by item and kind and
    joined on the number, so the chain needs no window over both kinds.
    """
    nth = F.row_number().over(Window.partitionBy("item", "kind").orderBy("at"))
    s = saves.filter(F.col("at").isNotNull()).withColumn("n", nth).withColumn("t", F.unix_millis("at"))
    pick = lambda kind, name: s.filter(F.col("kind") == kind).select(F.col("item").alias(f"{name}_i"), F.col("n").alias(f"{name}_n"), F.col("t").alias(name))
    contract = pick("contract", "c").groupBy("c_i").agg(F.max("c").alias("c"))
    b, v, before = pick("build", "b"), pick("verify", "v"), pick("verify", "p")
    gap = lambda d: F.sum(F.when(d.between(0, cap * 1000), d))
    builds = b.join(before, (F.col("b_i") == F.col("p_i")) & (F.col("b_n") == F.col("p_n") + 1), "left").join(contract, F.col("b_i") == F.col("c_i"), "left")
    builds = builds.groupBy(F.col("b_i").alias("item")).agg(gap(F.col("b") - F.when(F.col("b_n") == 1, F.col("c")).otherwise(F.col("p"))).alias("build"))
    verifies = v.join(pick("build", "b"), (F.col("v_i") == F.col("b_i")) & (F.col("v_n") == F.col("b_n"))).groupBy(F.col("v_i").alias("item")).agg(gap(F.col("v") - F.col("b")).alias("verify"))
    minutes = lambda c: half_up(F.coalesce(F.col(c), F.lit(0)) / 60_000).cast("int").alias(c)
    return builds.join(verifies, "item", "full").select("item", minutes("build"), minutes("verify"))
