"""Items that appear together, by basket collapsing.

Identical baskets (sorted arrays of distinct items) are grouped into one row
with a weight first, then the pairs of each distinct basket are enumerated once
and their weights added, so a basket that recurs a million times costs its
pairs once.

Scale: groups and items are replaced by 64-bit ids before anything is shuffled,
and come back as text by one join with their dictionary at the end, so what
moves is numbers. The distinct items of a basket are collected once, with
partial sets per task; the counts of items and groups come from these arrays,
not from the rows again. Pair weights are summed map-side, so a pair that is
everywhere sends one row per task. A basket is cut into blocks of ``BLOCK``
items and every pair of blocks is a row of its own, dealt out over the tasks, so
a large basket is no single task's work and none has to be left out. A basket's
array is 8 bytes an item; its pairs, which are asked for, are half its square.

Ids are hashes. Two items of one group with the same id (about one chance in
10^7 for a million items) are seen by the dictionary, which fails rather than
count them as one; another ``seed`` then gives other ids.

Defined cases: null items are left out, null baskets too (a basket without a
name is none); repeated items and rows count once; an item alone has no pair;
an empty table gives no rows; extra columns are not read. A null group is a
group of its own. Ties need no order, since all pairs are returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a block; two blocks give at most its square of pairs in one row.
BLOCK = 64


def _one(c: Column, what: str) -> Column:
    """The only value of a dictionary entry; fails where an id stands for two."""
    same = F.min(c).eqNullSafe(F.max(c))
    return F.when(same, F.min(c)).otherwise(F.raise_error(F.lit(f"two {what} have one id: give another seed")))


def cooccurrence(
    rows: DataFrame,
    group: Column,
    basket: Column,
    item: Column,
    min_together: int = 1,
    max_items: int | None = None,
    having: Callable[[Column, Column, Column, Column], Column] | None = None,
    seed: int = 0,
) -> DataFrame:
    """(grp, item_a, item_b, n_a, n_b, n_ab, n): item_a < item_b.

    ``n_ab`` baskets hold both, ``n_a`` and ``n_b`` each, ``n`` counts the
    baskets of the group. With ``max_items`` (a rule of the question asked, not
    of the operator) only baskets of at most so many different items count.
    ``having(n_a, n_b, n_ab, n)`` picks pairs before their names are looked up.
    """
    named = rows.select(group.alias("grp"), basket.alias("bsk"), item.alias("item")).filter(F.col("bsk").isNotNull() & F.col("item").isNotNull())
    # a null group hashes to the seed alone, like no text does but by chance, which the dictionary would see
    coded = named.select(F.xxhash64(F.lit(seed), "grp").alias("g"), "bsk", F.xxhash64(F.lit(seed), "item").alias("i"))
    baskets = coded.groupBy("g", "bsk").agg(F.collect_set("i").alias("items"))
    if max_items is not None:
        baskets = baskets.filter(F.size("items") <= max_items)
    total = baskets.groupBy("g").agg(F.count("*").alias("n"))
    counts = baskets.select("g", F.explode("items").alias("i")).groupBy("g", "i").agg(F.count("*").alias("c"))
    collapsed = baskets.filter(F.size("items") > 1).groupBy("g", F.array_sort("items").alias("items")).agg(F.count("*").alias("weight"))
    starts = F.sequence(F.lit(1), F.size("items"), F.lit(BLOCK))
    blocks = collapsed.select("g", "weight", F.transform(starts, lambda i: F.slice("items", i, BLOCK)).alias("blocks"))
    left = blocks.select("g", "weight", "blocks", F.posexplode("blocks").alias("at", "xs"))
    dealt = left.select("g", "weight", "xs", F.explode(F.slice("blocks", F.col("at") + 1, F.size("blocks"))).alias("ys"))
    # a fixed number of tasks: blocks are few bytes, their pairs are not
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = dealt.select("g", "weight", "ys", F.explode("xs").alias("x"))
    both = first.select("g", "x", F.explode(F.filter("ys", lambda y: y > F.col("x"))).alias("y"), "weight")
    counted = both.groupBy("g", "x", "y").agg(F.sum("weight").alias("n_ab"))
    if min_together > 1:
        counted = counted.filter(F.col("n_ab") >= min_together)
    cx, cy = (counts.select(F.col("g").alias(f"g_{k}"), F.col("i").alias(f"i_{k}"), F.col("c").alias(f"n_{k}")) for k in "xy")
    scored = (
        counted.join(cx, (F.col("g") == F.col("g_x")) & (F.col("x") == F.col("i_x")))
        .join(cy, (F.col("g") == F.col("g_y")) & (F.col("y") == F.col("i_y")))
        .join(total.select(F.col("g").alias("g_t"), "n"), F.col("g") == F.col("g_t"))
        .select("g", "x", "y", "n_x", "n_y", "n_ab", "n")
    )
    if having is not None:
        scored = scored.filter(having(F.col("n_x"), F.col("n_y"), F.col("n_ab"), F.col("n")))
    words = named.select(F.xxhash64(F.lit(seed), "grp").alias("g"), F.xxhash64(F.lit(seed), "item").alias("i"), "grp", "item")
    words = words.groupBy("g", "i").agg(_one(F.struct("grp", "item"), "items").alias("w"))
    wx, wy = (words.select(F.col("g").alias(f"g_{k}"), F.col("i").alias(f"i_{k}"), F.col("w.grp").alias(f"grp_{k}"), F.col("w.item").alias(f"item_{k}")) for k in "xy")
    out = scored.join(wx, (F.col("g") == F.col("g_x")) & (F.col("x") == F.col("i_x"))).join(wy, (F.col("g") == F.col("g_y")) & (F.col("y") == F.col("i_y")))
    up = F.col("item_x") < F.col("item_y")  # ids come in another order than names
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return out.select(
        F.col("grp_x").alias("grp"),
        F.least("item_x", "item_y").alias("item_a"),
        F.greatest("item_x", "item_y").alias("item_b"),
        pick("n_x", "n_y").alias("n_a"),
        pick("n_y", "n_x").alias("n_b"),
        "n_ab",
        "n",
    )


def scored(pairs: DataFrame) -> DataFrame:
    """Adds ``lift`` (times as often as by chance) and ``conviction`` of a -> b.

    Conviction is null where b follows a without exception (it is unbounded there).
    """
    n, a, b, ab = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "n_ab"))
    return pairs.withColumn("lift", ab * n / (a * b)).withColumn("conviction", F.when(F.col("n_ab") < F.col("n_a"), (1 - b / n) / (1 - ab / a)))
