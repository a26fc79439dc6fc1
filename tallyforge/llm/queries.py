"""Queries on near-duplicates (p2), percentiles (p3), co-occurrence (p4), packing (p6), mixing (p7) and wrong encodings (p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.paths import base_name, canonical_path
from tallyforge.llm import cooccurrence, mixing, mojibake, neardup, packing, quantile, tokens
from tallyforge.llm.sql import SQL
from tallyforge.operators.rows import latest
from tallyforge.registry import Registry, table
from tallyforge.session import materialise

R = Registry()


@R.query("p2_found", SQL["p2_found"])
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about one file name that share 0.6 of their words."""
    pairs = neardup.near_duplicates(table(spark, sf_dir, "findings"), "finding_id", F.col("summary"), base_name(F.col("file")), F.col("ingested_at"), t=0.6)
    return pairs.select(F.col("id_a").alias("finding_a"), F.col("id_b").alias("finding_b"))


@R.query("p2_classes", SQL["p2_classes"])
def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal findings that each finding is in, and how many other classes are similar to it."""
    rows = neardup.classes(table(spark, sf_dir, "findings"), "finding_id", F.col("summary"), base_name(F.col("file")), F.col("ingested_at"), t=0.6)
    return rows.withColumnRenamed("id", "finding_id")


STAGES = ("think", "plan", "build", "verify")
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def _timings(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Runs, each once as loaded last."""
    return latest(table(spark, sf_dir, "timings").select("timing_id", "loaded_at", *more, *STAGES), ["timing_id"], [F.desc_nulls_last("loaded_at")])


def _minutes() -> dict:
    """Minutes by stage as recorded: all values count, also negative and sentinel ones, since no rule tells which are wrong."""
    return {s: F.col(s) for s in STAGES}


@R.query("p3_percentiles")
def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and other percentiles of minutes per project, surface and stage, with the error of each."""
    out = quantile.percentiles(_timings(spark, sf_dir, "project", "surface"), ["project", "surface"], _minutes(), QUANTILES, name="stage")
    return out.withColumn("value_error", F.lit(2.0**-quantile.FRACTION))


@R.query("p3_verified", SQL["p3_verified"])
def p3_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile's exact rank is within its stated error, by counting the values below and up to it."""
    a = F.abs("value") * 2.0 ** (1 - quantile.FRACTION)
    wide = lambda v: F.when(F.abs("value") == float("inf"), F.col("value")).otherwise(v)
    told = p3_percentiles(spark, sf_dir).select(F.col("project").alias("p"), F.col("surface").alias("s"), F.col("stage").alias("g"), "quantile", "n", "rank_error", wide(F.col("value") - a).alias("low"), wide(F.col("value") + a).alias("high"))
    asked = told.groupBy("p", "s", "g").agg(F.collect_list(F.struct("quantile", "n", "rank_error", "low", "high")).alias("answers"))
    runs = _timings(spark, sf_dir, "project", "surface").unpivot(["project", "surface"], list(STAGES), "stage", "v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    met = runs.join(asked, F.col("project").eqNullSafe(F.col("p")) & F.col("surface").eqNullSafe(F.col("s")) & (F.col("stage") == F.col("g"))).select("project", "surface", "stage", "v", F.explode("answers").alias("x"))
    ranks = met.groupBy("project", "surface", "stage", "x").agg(F.count("*").alias("seen"), F.count_if(F.col("v") < F.col("x.low")).alias("below"), F.count_if(F.col("v") <= F.col("x.high")).alias("upto"))
    rank, slack = F.greatest(F.ceil(F.col("x.quantile") * F.col("seen") - 1e-9), F.lit(1)), F.col("x.rank_error") * F.col("seen")
    return ranks.select("project", "surface", "stage", F.col("x.quantile").alias("quantile"), F.col("x.n").alias("n"), ((rank > F.col("below") - slack) & (rank <= F.col("upto") + slack)).alias("within"))


@R.query("p3_merged")
def p3_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per surface and stage put together from the stored states of single load days."""
    runs = _timings(spark, sf_dir, "surface").withColumn("day", F.to_date("loaded_at"))
    states = materialise(quantile.sketches(runs, ["surface", "day"], _minutes(), name="stage"), "states")
    return quantile.ask(quantile.merge(states, ["surface", "stage"]), ["surface", "stage"], QUANTILES)


@R.query("p3_merged_agree", SQL["p3_merged_agree"])
def p3_merged_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles put together from days are those of all runs at once, bit for bit."""
    whole = quantile.percentiles(_timings(spark, sf_dir, "surface"), ["surface"], _minutes(), QUANTILES, name="stage")
    days = p3_merged(spark, sf_dir)
    both = whole.select("surface", "stage", "quantile", "n", F.struct("value", "rank_error").alias("a")).join(days.select(F.col("surface").alias("s"), F.col("stage").alias("g"), F.col("quantile").alias("q"), F.col("n").alias("m"), F.struct("value", "rank_error").alias("b")), F.col("surface").eqNullSafe(F.col("s")) & (F.col("stage") == F.col("g")) & (F.col("quantile") == F.col("q")), "left")
    return both.select("surface", "stage", "quantile", "n", ((F.col("n") == F.col("m")) & (F.col("a") == F.col("b"))).alias("same"))


@R.query("p3_without_repeats")
def p3_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per stage of all rows as loaded, with the repeated loads of a run taken out again by their own state."""
    rows = table(spark, sf_dir, "timings").select("timing_id", "loaded_at", *STAGES)
    again = rows.withColumn("nth", F.row_number().over(Window.partitionBy("timing_id").orderBy(F.desc_nulls_last("loaded_at")))).filter("nth > 1")
    whole = quantile.sketches(rows, [], _minutes(), name="stage").withColumn("sign", F.lit(1))
    out = quantile.sketches(again, [], _minutes(), name="stage").withColumn("sign", F.lit(-1))
    return quantile.ask(quantile.merge(whole.unionByName(out), ["stage"], F.col("sign")), ["stage"], QUANTILES)


def _module_pairs(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    touched = table(spark, sf_dir, "entries").filter(F.col("slug").isNotNull()).select("project", "slug", F.explode("modules_touched").alias("module"))
    return cooccurrence.cooccurrence(touched, F.col("project"), F.col("slug"), canonical_path(F.col("module")), **how)


@R.query("p4_found", SQL["p4_found"])
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files changed together by 5 work items or more, three times as often as by chance."""
    often = _module_pairs(spark, sf_dir, min_together=5, max_items=40, having=lambda a, b, ab, n: ab * n >= 3 * a * b)
    return often.select(F.col("grp").alias("project"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


@R.query("p4_cooccurrence", SQL["p4_cooccurrence"])
def p4_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of files changed together by any work item, whatever its size, with lift and conviction."""
    pairs = cooccurrence.scored(_module_pairs(spark, sf_dir))
    rounded = [F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").alias(f"{c}_ppm") for c in ("lift", "conviction")]
    return pairs.select(F.col("grp").alias("project"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), "n_a", "n_b", F.col("n_ab").cast("bigint").alias("n_ab"), "n", *rounded)


def _tokens(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, ..., tokens) of all documents, stored, since counting is what costs."""
    return materialise(tokens.with_tokens(table(spark, sf_dir, "documents"), {c: F.col(c) for c in ("doc_id", *more)}, "text"), "tokens")


@R.query("p6_packs")
def p6_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack of every text for each capacity alone, and (packing ``joint``) with all capacities permitted together."""
    return _packed(spark, sf_dir)[1]


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes: dict[str, list[int]] = {}
    for r in table(spark, sf_dir, "pack_sizes").collect():  # a configuration of a few rows
        sizes.setdefault(r["pack"], []).append(r["capacity_tokens"])
    joint = "joint"
    while joint in sizes:
        joint += "_"
    packings = {**sizes, joint: [c for caps in sizes.values() for c in caps]}
    counted = _tokens(spark, sf_dir)
    packed = packing.pack(counted, "doc_id", "tokens", packings)
    return counted, packed.withColumnRenamed("item", "doc_id").withColumn("fill", F.col("pack_tokens") / F.col("capacity"))


@R.query("p6_fill")
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the packs of each packing are."""
    return packing.fill(p6_packs(spark, sf_dir).withColumnRenamed("doc_id", "item"))


@R.query("p6_checked", SQL["p6_checked"])
def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing: each text once with all its tokens, no pack too full or larger than it need be, no text split that fits."""
    counted, packed = _packed(spark, sf_dir)
    sizes = table(spark, sf_dir, "pack_sizes").select("pack", "capacity_tokens").filter(F.col("capacity_tokens") > 0)
    largest = sizes.groupBy("pack").agg(F.max("capacity_tokens").alias("cap")).unionByName(sizes.agg(F.lit("joint").alias("pack"), F.max("capacity_tokens").alias("cap")))
    parts = packed.groupBy("packing", "doc_id").agg(F.sum("tokens").alias("held"), F.count("*").alias("parts"))
    per = parts.join(counted, "doc_id", "full").join(F.broadcast(largest), F.col("packing") == F.col("pack"), "left")
    texts = per.groupBy("packing").agg(F.count("*").alias("texts"), F.count_if(~F.coalesce(F.col("held") == F.coalesce("tokens", F.lit(0)), F.lit(False))).alias("lost"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("cap"))).alias("split"))
    bins = packed.filter(F.col("pack_id").isNotNull()).groupBy("packing", "pack_id").agg(F.max("capacity").alias("capacity"), F.sum("tokens").alias("held"))
    full = bins.groupBy("packing").agg(F.count_if(F.col("held") > F.col("capacity")).alias("too_full"))
    return texts.join(full, "packing").select("packing", "texts", "lost", "split", "too_full")


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _tokens(spark, sf_dir, "source").withColumnRenamed("doc_id", "doc")
    targets = table(spark, sf_dir, "mix_targets")
    return docs, targets, mixing.draw(docs, targets)


@R.query("p7_drawn")
def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each mix and how often each is used."""
    _, _, drawn = _drawn(spark, sf_dir)
    return drawn.groupBy("mix", "source", F.col("doc").alias("doc_id"), "tokens").agg(F.count("*").alias("times"))


@R.query("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source that a mix names, also of those that give nothing.

    ``target_share`` is that of the sources there are, which the draw aims at;
    ``raw_weight`` is the weight as the targets have it.
    """
    docs, targets, drawn = _drawn(spark, sf_dir)
    own = drawn.groupBy(F.col("mix").alias("m"), F.col("source").alias("s")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), F.max("round").alias("last_round"))
    whole = own.groupBy(F.col("m").alias("w_m")).agg(F.sum("tokens").alias("all_tokens"))
    wanted = mixing.wanted_sources(mixing.usable_docs(docs), targets)
    joined = wanted.join(own, F.col("mix").eqNullSafe(F.col("m")) & (F.col("source") == F.col("s")), "left").join(whole, F.col("mix").eqNullSafe(F.col("w_m")), "left")
    return joined.select(
        "mix",
        "source",
        "raw_weight",
        F.coalesce("share", F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce(F.col("last_round") + 1, F.lit(0)).alias("most_times"),
        F.col("repeats").alias("max_repeats"),
        F.coalesce("largest", F.lit(0)).alias("largest_text"),
        F.coalesce("all_tokens", F.lit(0)).alias("mix_tokens"),
    )


@R.query("p7_checked", SQL["p7_checked"])
def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every usable source of a mix: its tokens within one text of each source of its share, no text used too often."""
    s = p7_shares(spark, sf_dir).filter(F.col("target_share") > 0)
    room = s.groupBy(F.col("mix").alias("m")).agg(F.sum("largest_text").alias("room"))
    off = F.col("tokens") - F.col("target_share") * F.col("mix_tokens")
    # at the cut a source lacks its next text at most, and all the others' next texts make its share look larger
    within = (off > -F.col("largest_text") - 1) & (off < F.col("target_share") * F.col("room") + 1)
    return s.join(room, F.col("mix") == F.col("m")).select("mix", "source", within.alias("within"), (F.col("most_times") <= F.col("max_repeats")).alias("not_too_often"))


@R.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text read in another encoding than it was written in."""
    return mojibake.garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


@R.query("p8_restored")
def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with the chain of encodings and the text as it was, as far as that can be told."""
    return mojibake.garbled(table(spark, sf_dir, "documents"), "doc_id", "text")


#: (id, text as it was, chain of (written, read)); without a chain it is sound.
PLANTED = (
    (1, "Die Prüfung läuft über größere Lücken", (("utf_8", "cp1252"),)),
    (2, "Le contrôle a été décalé, voilà où l’accès dérive", (("utf_8", "mac_roman"),)),
    (3, "Die Prüfung läuft über größere Lücken", (("utf_8", "cp1252"), ("utf_8", "cp1252"))),
    (4, "Критерий проверки слабого отчёта изменился", (("cp1251", "cp1252"),)),
    (5, "Критерий проверки слабого отчёта изменился", (("koi8_r", "cp1251"),)),
    (6, "Następny przegląd usunął słabą regułę", (("utf_8", "cp1250"),)),
    (7, "Die Prüfung läuft über größere Lücken", ()),
    (8, "Критерий проверки слабого отчёта изменился", ()),
    (9, "cut off here\ufffd", ()),
    (10, "plain words only", ()),
)


@R.query("p8_planted", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t, chain in PLANTED if chain) + ") v(doc_id, restored)")
def p8_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts garbled in a known way, found and put right by the model that the documents give; sound ones are not found."""
    rows = []
    for i, text, chain in PLANTED:
        for written, read in chain:
            text = text.encode(written).decode(read, "replace") if read != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode(written))
        rows.append((i, text))
    planted = spark.createDataFrame(rows, "doc_id int, text string")
    return mojibake.garbled(planted, "doc_id", "text", table(spark, sf_dir, "documents")).select("doc_id", "restored")
