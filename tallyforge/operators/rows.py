"""Row-level building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[Column], tmp: str = "__rn") -> DataFrame:
    """One row per key: the first in ``order``.

    Spark plans a group limit before the shuffle, so a key with a third of all
    rows sends one row per task. Null keys form one group. Ties that ``order``
    leaves open go to any one of the equal rows.
    """
    return df.withColumn(tmp, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(tmp) == 1).drop(tmp)


def running_total(df: DataFrame, part: list[str], order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` within ``part``, for parts of any size.

    ``bucket`` must be a non-decreasing function of ``order`` with bounded rows
    per value: sums per bucket are added up first (a small table), then rows are
    ordered within their bucket only, so no task holds a whole part.
    """
    b = "__bucket"
    df = df.withColumn(b, bucket)
    sums = df.groupBy(*part, b).agg(F.sum(value).alias("__s"))
    w = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(part)], F.col(b).alias("__b"), F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__before"))
    on = F.col(b) == F.col("__b")
    for i, c in enumerate(part):
        on = on & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    inner = Window.partitionBy(*part, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = (F.col("__before") + F.sum(value).over(inner)).alias(out)
    return df.join(before, on).select(*[c for c in df.columns if c != b], total)


def versions(saves: DataFrame, key: list[str], order: list[str], content: Column) -> DataFrame:
    """SNK-06: the saves that changed something: (key..., order..., hash, version), the first of a key with version 1.

    A save whose content has the hash of the one before it is skipped; one that
    returns to an older content is a version again. A null content counts as a
    content of its own. ``order`` must tell the saves of a key apart.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    hashed = saves.select(*key, *order, F.sha2(content, 256).alias("hash"))
    marked = hashed.withColumn("__n", F.row_number().over(w)).withColumn("__before", F.lag("hash").over(w))
    kept = marked.filter((F.col("__n") == 1) | ~F.col("hash").eqNullSafe(F.col("__before")))
    return kept.select(*key, *order, "hash", F.row_number().over(w).alias("version"))
