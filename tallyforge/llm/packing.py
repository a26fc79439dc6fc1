"""Filling fixed-capacity containers with texts: variable-capacity best fit.

Items go in by falling size. An item takes the open bin that it fills best; if
none has room, a bin is opened whose size has the least cost per token that it
will hold, counting the item and what the smaller items still to come can fill
of the rest. At the end each bin is cut down to the least permitted size that
holds its contents. With one permitted size this is best-fit decreasing.

An item larger than the largest size is split into full bins of that size, and
its rest is an item; no other item is split.

Scale: items are dealt into blocks by a hash of their key, some 50,000 to a
block, and each block is packed on its own, in parallel; a block leaves at most
a few bins partly empty, so what the blocks cost falls below 0.1 % of the bins.
No source, language or size is kept together, so no value of a column can make
a block large.

Defined cases: null and zero sizes take no room: they have one row without a
pack. Ties in size go by key. Repeated keys are packed as often as they come.
An empty table gives no rows. Capacities that are null or below 1 are left out;
names are the caller's.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 50_000
#: What a bin costs beside its size, in tokens: fewer, larger bins win between equals.
OVERHEAD = 1.0

PACK_SCHEMA = "packing string, pack_id bigint, capacity int, item bigint, part int, tokens bigint, pack_tokens bigint"


def best_fit(sizes: np.ndarray, capacities: Sequence[int], overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, size of each bin); sizes fall and none exceeds the largest capacity."""
    caps = sorted(capacities)
    rest = np.concatenate((np.cumsum(sizes[::-1])[::-1], [0]))  # tokens of an item and those after it
    rising = -sizes
    where = np.empty(len(sizes), np.int64)
    room: list[int] = []  # distinct free sizes of open bins
    free: dict[int, list[int]] = {}
    used: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        k = bisect_left(room, s)
        if k < len(room):
            r = room[k]
            stack = free[r]
            b = stack.pop()
            if not stack:
                del free[r], room[k]
            left = r - s
        else:
            best = None
            for c in caps[bisect_left(caps, s) :]:
                gap = c - s
                fill = min(gap, int(rest[max(i + 1, int(np.searchsorted(rising, -gap)))])) if gap and len(caps) > 1 else 0
                cost = (c + overhead) / (s + fill)
                if best is None or cost < best[0]:
                    best = (cost, c)
            b, left = len(used), best[1] - s
            used.append(0)
        used[b] += s
        where[i] = b
        if left:
            if left in free:
                free[left].append(b)
            else:
                free[left] = [b]
                insort(room, left)
    held = np.array(used, np.int64)
    return where, np.array(caps, np.int64)[np.searchsorted(caps, held)]


def _pack_block(name: str, block: int, item: np.ndarray, size: np.ndarray, capacities: Sequence[int]) -> pd.DataFrame:
    top = max(capacities)
    full, rest = size // top, size % top
    whole = full + (rest > 0)
    who = np.repeat(np.arange(len(size)), whole)
    part = np.arange(len(who)) - np.repeat(np.cumsum(whole) - whole, whole)
    tokens = np.where(part < full[who], top, rest[who])
    order = np.lexsort((part, item[who], -tokens))
    who, part, tokens = who[order], part[order], tokens[order]
    where, capacity = best_fit(tokens, capacities)
    held = np.bincount(where, tokens).astype(np.int64)
    return pd.DataFrame({"packing": name, "pack_id": (block << 32) + where, "capacity": capacity[where], "item": item[who], "part": part, "tokens": tokens, "pack_tokens": held[where]})


def pack(items: DataFrame, item: str, size: str, packings: dict[str, list[int]], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(packing, pack_id, capacity, item, part, tokens, pack_tokens) of every item in every packing.

    ``packings`` names the permitted bin sizes of each. ``items`` is counted
    once for the number of blocks.
    """
    packings = {n: sorted({c for c in caps if c and c > 0}) for n, caps in packings.items()}
    packings = {n: caps for n, caps in packings.items() if caps}
    names = F.array(*[F.lit(n) for n in packings]) if packings else F.array().cast("array<string>")
    picked = items.select(F.col(item).cast("bigint").alias("item"), F.col(size).cast("bigint").alias("size"), F.explode(names).alias("packing"))
    blocks = max(1, -(-items.count() // block_items))
    dealt = picked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_block(key[0], int(key[1]), rows["item"].to_numpy(), rows["size"].to_numpy(), packings[key[0]])

    packed = dealt.filter(F.col("size") > 0).groupBy("packing", "block").applyInPandas(run, PACK_SCHEMA)
    nothing = F.lit(None).cast("bigint")
    none = picked.filter(F.coalesce("size", F.lit(0)) <= 0).select("packing", nothing.alias("pack_id"), nothing.cast("int").alias("capacity"), "item", F.lit(0).alias("part"), F.coalesce("size", F.lit(0)).alias("tokens"), nothing.alias("pack_tokens"))
    return packed.unionByName(none)


def fill(packed: DataFrame) -> DataFrame:
    """(packing, packs, items, tokens, room, fill) of a packing; ``fill`` is the share of the room that is used."""
    bins = packed.filter(F.col("pack_id").isNotNull()).groupBy("packing", "pack_id").agg(F.first("capacity").alias("capacity"), F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return bins.groupBy("packing").agg(F.count("*").alias("packs"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum("capacity").alias("room"), (F.sum("tokens") / F.sum("capacity")).alias("fill"))
