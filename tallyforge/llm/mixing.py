"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a hash of their key. A copy of a
document has the virtual finish time (tokens of its source up to it, all earlier
rounds included) / (target share of the source). All copies of a mix are ranged
by finish time and cut off where their tokens reach the budget, so at every
point each source has had its share to within one document.

The default budget is the largest at which every source can give its share:
the least of (tokens * max_repeats / share) over the sources of the mix that
have any. With a larger budget, sources that run out fall short and the others
go on; the shares reached are reported.

Scale: both running sums (tokens in a source, tokens by finish time in a mix)
are taken in two levels, over buckets first and then within them, so no task
holds a source or a mix. Only the totals of the sources named by a mix reach the
driver, at most one row per row of the targets.

Defined cases: documents without tokens or source are not drawn; sources a mix
names but that have no tokens, a weight that is null or not above zero, or
fewer than one repeat, give nothing and their weight is left out of the sum;
several rows of a mix for one source are one (weights added, most repeats); a
null number of repeats is one; equal finish times go by source, round and key;
a mix without a usable source, or without documents, draws nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.rows import running_total

#: Rows meant to share a bucket of a running sum.
BUCKET_ROWS = 20_000


def source_name(c: Column) -> Column:
    """One spelling per source: lower case, ``_`` between words, no blanks around; null for none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s_-]+", "_"), F.lit(""))


def wanted_sources(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, raw_weight, weight, repeats, total, docs, share): one row per mix and source it names.

    ``weight`` is the part of ``raw_weight`` that counts (rows with a weight
    above zero and a repeat or more), ``share`` its share of the weights of the
    sources that there are; null for a source that gives nothing.
    """
    w = F.when(F.isnan("target_weight"), None).otherwise(F.col("target_weight"))
    repeats = F.coalesce("max_repeats", F.lit(1))
    named = targets.select("mix", source_name(F.col("source")).alias("source"), w.alias("w"), repeats.alias("r"), ((w > 0) & (repeats > 0)).alias("counts"))
    named = named.groupBy("mix", "source").agg(F.sum("w").alias("raw_weight"), F.sum(F.when(F.col("counts"), F.col("w"))).alias("weight"), F.max(F.when(F.col("counts"), F.col("r"))).alias("repeats"))
    there = docs.groupBy(F.col("source").alias("__s")).agg(F.sum("tokens").alias("total"), F.count("*").alias("docs"), F.max("tokens").alias("largest"))
    joined = named.join(there, F.col("source") == F.col("__s"), "left").drop("__s")
    usable = F.col("weight").isNotNull() & (F.col("total") > 0)
    # a mix is a few rows of a configuration
    sums = joined.filter(usable).groupBy(F.col("mix").alias("__m")).agg(F.aggregate(F.array_sort(F.collect_list("weight")), F.lit(0.0), lambda x, y: x + y).alias("__all"))
    return joined.join(sums, F.col("mix").eqNullSafe(F.col("__m")), "left").withColumn("share", F.when(usable, F.col("weight") / F.col("__all"))).drop("__m", "__all")


def usable_docs(docs: DataFrame) -> DataFrame:
    """(doc, source, tokens) of the documents that can be drawn, sources in one spelling."""
    return docs.select("doc", source_name(F.col("source")).alias("source"), "tokens").filter((F.col("tokens") > 0) & F.col("source").isNotNull())


def shares(docs: DataFrame, targets: DataFrame, budget: int | None = None) -> list[dict]:
    """Per mix and usable source: share, tokens and documents there are, repeats, budget."""
    rows = [r.asDict() for r in wanted_sources(docs, targets).filter(F.col("share").isNotNull()).collect()]
    for mix in {r["mix"] for r in rows}:
        own = [r for r in rows if r["mix"] == mix]
        most = int(min(r["total"] * r["repeats"] / r["share"] for r in own))
        for r in own:
            r["budget"] = most if budget is None else budget
    return sorted(rows, key=lambda r: (str(r["mix"]), r["source"]))


def draw(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> DataFrame:
    """(mix, source, doc, tokens, round): the copies drawn, of ``docs(doc, source, tokens)``.

    ``docs`` is read several times; give a stored table.
    """
    docs = usable_docs(docs)
    plan = shares(docs, targets, budget)
    spark = docs.sparkSession
    fields = "mix string, source string, share double, total bigint, repeats int, budget bigint, queues array<struct<end:double,copies:double>>"
    rows = []
    for r in plan:
        # when each source of the mix runs out, and the copies it has had by then
        queues = [(x["total"] * x["repeats"] / x["share"], float(x["docs"] * x["repeats"])) for x in plan if x["mix"] == r["mix"]]
        rows.append((r["mix"], r["source"], r["share"], r["total"], r["repeats"], r["budget"], queues))
    # one row per row of the targets, which is a configuration: its size does not follow the data
    queue = F.broadcast(spark.createDataFrame(rows, fields))
    largest = max((r["docs"] for r in plan), default=0)
    bits = max(0, (largest // BUCKET_ROWS)).bit_length()
    shuffled = docs.withColumn("h", F.xxhash64("doc", F.lit(seed)))
    bucket = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    placed = running_total(shuffled, ["source"], ["h", "doc"], bucket, "tokens", "upto")
    copies = placed.join(queue, "source").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    copies = copies.withColumn("finish", (F.col("round") * F.col("total") + F.col("upto")) / F.col("share"))
    # the copies to be expected up to a finish time rise with it, and buckets of them are of one size even where sources run out early
    expected = F.aggregate("queues", F.lit(0.0), lambda n, q: n + F.least(F.col("finish") / q["end"], F.lit(1.0)) * q["copies"])
    copies = running_total(copies, ["mix"], ["finish", "source", "round", "doc"], F.floor(expected / BUCKET_ROWS), "tokens", "spent")
    return copies.filter(F.col("spent") <= F.col("budget")).select("mix", "source", "doc", "tokens", "round")
