"""Percentiles of very large numeric columns with dyadic count-sketches.

A value is encoded, order kept, in 23 bits: sign, the 11 bits of a double's
exponent, 11 bits of fraction. For each binary resolution of the codes (2**23
cells down to one) the state holds how many values lie in each cell: exactly
from 2**16 cells up the tree (of which only those with values are kept), in a
signed count-sketch of 5 rows by 512 counters below. A percentile is found by
descending the levels: a cell's left half is estimated, and the rank still to be
found tells whether to go left or right.

The state is linear in the data. States of partitions, days or loads are merged
by adding their counters, a negative weight takes values out again, and either
order of merging gives the same counters, so the same answers, bit for bit. A
stored state of few different codes holds the codes with their counts, from
which the same counters come when it is merged or asked.

Error. The value given is the edge (towards zero) of a cell that is at most
2**-11 of the value wide, over the whole range of a double. The rank is off by
the errors of at most 7 sketched estimates: three standard deviations of their
sum, taken from the sketch's own second moments, come with every answer as
``rank_error`` (a share of n). It is no bound that always holds, but one that
under one answer in some hundred passes.

Scale: values are counted per group and code in each task before the shuffle,
so a group that fills a third of the table moves at most its different codes
from a task. Where many tasks may hold parts of one group, the parts are added
up in two rounds, also when stored states are merged.

Defined cases: null and NaN values count for nothing; infinities have a cell of
their own at either end; numbers nearer to zero than 2**-1022 count as zero;
values below zero count like all others; a group without values has no state
and no row; null keys form groups of their own; repeated rows count as often as
they come (removing them is the caller's task, or done later with weight -1);
columns called like the operator's own are not touched, since only the keys and
values are read. An empty table gives no rows. Ties share a code, which makes
them exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTION = 11
LEAST = 1022  # numbers below 2**-LEAST count as zero
BITS = 1 + 11 + FRACTION
EXACT_LEVEL = 7  # cells of this level and above are counted exactly
ROWS, WIDTH = 5, 512
SIZE = EXACT_LEVEL * ROWS * WIDTH
#: Parts of a group from which on they are added up in two rounds.
FAN_IN = 512
#: Values held in a task before they are counted, and counters of sketches built at once.
HELD, BUILT = 2_000_000, 4_000_000
#: Different codes up to which a stored state is a list of them.
SPARSE = 2_000


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of doubles (no NaN), in the order of the values."""
    m, e = np.frexp(np.where(np.isinf(x), 1.0, np.abs(x)))
    size = ((e.astype(np.int64) + LEAST) << FRACTION) + np.floor((m - 0.5) * (2 << FRACTION)).astype(np.int64)
    top = (1 << (BITS - 1)) - 1
    size = np.where(np.isinf(x), top, np.where((m == 0) | (e < 1 - LEAST), 0, size))
    return np.where(x < 0, top - size, top + 1 + size)


def decode(code: np.ndarray) -> np.ndarray:
    """The edge nearer to zero of each code's cell."""
    top = (1 << (BITS - 1)) - 1
    negative = code <= top
    size = np.where(negative, top - code, code - top - 1)
    with np.errstate(over="ignore"):
        x = np.ldexp(0.5 + (size & ((1 << FRACTION) - 1)) / (2 << FRACTION), (size >> FRACTION) - LEAST)
    x = np.where(size == top, np.inf, np.where(size == 0, 0.0, x))
    return np.where(negative & (size > 0), -x, x)


def _hash(cells: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of cells in one row of one level."""
    with np.errstate(over="ignore"):
        h = (cells.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * ROWS + row + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)


@dataclass
class States:
    """The states of a number of groups: exact cells (sorted by group and cell) and sketches (a row each)."""

    group: np.ndarray
    cell: np.ndarray
    count: np.ndarray
    sketch: np.ndarray

    def added(self, group: np.ndarray, cell: np.ndarray, count: np.ndarray) -> None:
        """Add exact counts."""
        at, back = np.unique(np.concatenate((self.group << BITS | self.cell, group << BITS | cell)), return_inverse=True)
        total = np.bincount(back, np.concatenate((self.count, count)), len(at))
        at, self.count = at[total != 0], total[total != 0]
        self.group, self.cell = at >> BITS, at & ((1 << BITS) - 1)

    def n(self) -> np.ndarray:
        return np.bincount(self.group, self.count, len(self.sketch))


def build(group: np.ndarray, code: np.ndarray, weight: np.ndarray, groups: int) -> States:
    """States of weighted codes."""
    weight = weight.astype(np.float64)
    none = np.empty(0, np.int64)
    out = States(none, none, np.empty(0), np.empty((groups, SIZE)))
    out.added(group, code >> EXACT_LEVEL, weight)
    at = 0
    for level in range(EXACT_LEVEL):
        cells, back = np.unique(code >> level, return_inverse=True)  # each cell is hashed once
        for row in range(ROWS):
            h, sign = _hash(cells, level, row)
            out.sketch[:, at : at + WIDTH] = np.bincount(group * WIDTH + h[back], weight * sign[back], groups * WIDTH).reshape(groups, WIDTH)
            at += WIDTH
    return out


def answer(states: States, quantiles: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, values by group and quantile, rank error) of states.

    The q-quantile is the least value with at least ``ceil(q * n)`` values up to
    it. A state without values (all taken out) has n = 0 and NaN values.
    """
    n = states.n()
    g, q = len(n), len(quantiles)
    if not len(states.cell):
        return n, np.full((g, q), np.nan), np.full(g, np.nan)
    rank = np.maximum(np.ceil(n[:, None] * np.asarray(quantiles)[None, :] - 1e-9), 1.0)
    total = np.cumsum(np.maximum(states.count, 0))
    first, end = np.searchsorted(states.group, np.arange(g), "left"), np.searchsorted(states.group, np.arange(g), "right")
    base = np.where(first > 0, total[np.maximum(first, 1) - 1], 0.0)
    at = np.searchsorted(total, (base[:, None] + rank).ravel(), "left").reshape(g, q)
    at = np.clip(at, np.minimum(first, len(total) - 1)[:, None], np.maximum(end - 1, 0)[:, None])
    cell, inside = states.cell[at], np.maximum(states.count[at], 0)
    rank = rank - (total[at] - inside - base[:, None])
    who = np.repeat(np.arange(g), q).reshape(g, q)
    noise = np.zeros(g)
    for level in range(EXACT_LEVEL - 1, -1, -1):
        rows = states.sketch[:, level * ROWS * WIDTH : (level + 1) * ROWS * WIDTH].reshape(g, ROWS, WIDTH)
        noise += np.median((rows**2).sum(axis=2), axis=1) / WIDTH
        left = cell * 2
        seen = []
        for row in range(ROWS):
            h, sign = _hash(left, level, row)
            seen.append(rows[who, row, h] * sign)
        here = np.clip(np.median(np.stack(seen), axis=0), 0.0, inside)
        right = rank > here
        cell = left + right
        rank = np.where(right, rank - here, rank)
        inside = np.where(right, inside - here, here)
    # the median of five such estimates has 0.287 of their variance
    error = np.where(n > 0, 3.0 * np.sqrt(0.287 * noise) / np.maximum(n, 1.0), np.nan)
    return n, np.where(n[:, None] > 0, decode(cell), np.nan), np.minimum(error, 1.0)


#: What a part of a group holds: counts per code in numbers of 4 or 8 bytes, a state,
#: or one of these as stored, with its form in front, to be added or taken out.
SHORT, LONG, STATE, STORED, TAKEN = 4, 8, 0, 50, 51


def _numbers(*columns: np.ndarray) -> bytes:
    """Whole numbers of several columns of one length, the first as differences, compressed."""
    first, *rest = (c.astype(np.int64) for c in columns)
    return zlib.compress(np.concatenate((np.diff(first, prepend=0), *rest)).tobytes(), 1)


def _back(data: bytes, columns: int) -> list[np.ndarray]:
    x = np.frombuffer(zlib.decompress(data), np.int64).reshape(columns, -1)
    return [np.cumsum(x[0]), *x[1:]]


def pack(states: States, g: int) -> bytes:
    """One state as bytes: its exact cells, and the counters of its sketch that are not zero."""
    a, b = np.searchsorted(states.group, [g, g + 1])
    at = np.flatnonzero(states.sketch[g])
    exact = _numbers(states.cell[a:b], states.count[a:b])
    return len(exact).to_bytes(4, "little") + exact + _numbers(at, states.sketch[g, at])


def _codes(code: np.ndarray, weight: np.ndarray) -> tuple[int, bytes]:
    form = LONG if len(weight) and np.abs(weight).max() > 2**31 - 1 else SHORT
    return form, np.concatenate((code, weight)).astype(f"i{form}").tobytes()


class Parts:
    """Parts of some groups in any form, to be added up."""

    def __init__(self) -> None:
        self.codes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.states: list[tuple[int, int, bytes]] = []
        self.held = 0

    def add(self, g: int, form: int, data: bytes, sign: int = 1) -> None:
        if form in (STORED, TAKEN):
            self.add(g, data[0], data[1:], 1 if form == STORED else -1)
        elif form == STATE:
            self.states.append((g, sign, data))
        else:
            x = np.frombuffer(data, f"i{form}").astype(np.int64)
            half = len(x) // 2
            self.codes.append((np.full(half, g), x[:half], x[half:] * sign))
            self.held += half

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, code, weight) of the parts that are codes, each once, sorted."""
        if not self.codes:
            return (np.empty(0, np.int64),) * 3
        at = np.concatenate([c[0] for c in self.codes]) << BITS | np.concatenate([c[1] for c in self.codes])
        at, back = np.unique(at, return_inverse=True)
        # whole numbers beyond 2**53 are added as such
        w = np.zeros(len(at), np.int64)
        np.add.at(w, back, np.concatenate([c[2] for c in self.codes]))
        self.codes = [(at >> BITS, at & ((1 << BITS) - 1), w)]
        self.held = len(at)
        return at[w != 0] >> BITS, at[w != 0] & ((1 << BITS) - 1), w[w != 0]

    def total(self, groups: int) -> States:
        out = build(*self.counted(), groups)
        for g, sign, data in self.states:
            cut = 4 + int.from_bytes(data[:4], "little")
            cell, count = _back(data[4:cut], 2)
            out.added(np.full(len(cell), g), cell, sign * count.astype(np.float64))
            at, value = _back(data[cut:], 2)
            out.sketch[g, at] += sign * value
        return out

    def stored(self, groups: int) -> tuple[np.ndarray, list[bytes]]:
        """(n, state as stored) of every group."""
        group, code, weight = self.counted()
        few = np.bincount(group, minlength=groups) <= SPARSE
        few[[g for g, _, _ in self.states]] = False
        n, data = np.zeros(groups, np.int64), [b""] * groups
        np.add.at(n, group, weight)
        for g in np.flatnonzero(few).tolist():
            a, b = np.searchsorted(group, [g, g + 1])
            form, codes = _codes(code[a:b], weight[a:b])
            data[g] = bytes([form]) + codes
        many = np.flatnonzero(~few)
        if len(many):
            whole = self.total(groups)
            n[many] = whole.n()[many].astype(np.int64)
            for g in many.tolist():
                data[g] = bytes([STATE]) + pack(whole, g)
        return n, data


def _counted(df: DataFrame, keys: list[str], values: dict[str, Column], weight: Column | None) -> DataFrame:
    """(k0, ..., name, form, codes): the counts per code of every group in each task."""
    k = len(keys)
    names = list(values)
    picked = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], (F.lit(1) if weight is None else weight).cast("bigint").alias("w"), *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])
    out = T.StructType([*picked.schema.fields[:k], T.StructField("name", T.StringType()), T.StructField("form", T.IntegerType()), T.StructField("codes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size:
                at = np.concatenate([x[0] for x in held]) << BITS | np.concatenate([x[1] for x in held])
                cells, back = np.unique(at, return_inverse=True)
                w = np.bincount(back, np.concatenate([x[2] for x in held])).astype(np.int64)
                cells, w = cells[w != 0], w[w != 0]
                group = cells >> BITS
                heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
                label = list(known)
                rows = [(*label[group[a] // len(names)], names[group[a] % len(names)], *_codes(cells[a:b] & ((1 << BITS) - 1), w[a:b])) for a, b in zip(heads, [*heads[1:], len(group)], strict=True)]
                columns = [pa.array([r[i] for r in rows], types[i]) for i in range(k)]
                codes = pa.array([r[-1] for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[k] for r in rows], pa.string()), pa.array([r[k + 1] for r in rows], pa.int32()), codes], names=[f.name for f in out.fields])
            known.clear()
            held, size = [], 0

        types: list = []
        for b in batches:
            types = [b.schema.field(i).type for i in range(k)]
            # number the groups: each key column as a dictionary, combined, then looked up once per batch
            code = np.zeros(b.num_rows, np.int64)
            parts = []
            for i in range(k):
                d = b.column(i).dictionary_encode("encode")
                parts.append(d.dictionary.to_pylist())
                code = code * (len(parts[-1]) + 1) + d.indices.to_numpy(zero_copy_only=False)
            distinct, back = np.unique(code, return_inverse=True)
            ids = []
            for c in distinct.tolist():
                label = []
                for p in reversed(parts):
                    c, r = divmod(c, len(p) + 1)
                    label.append(p[r])
                ids.append(known.setdefault(tuple(reversed(label)), len(known)))
            group = np.array(ids, np.int64)[back] if k else np.full(b.num_rows, known.setdefault((), 0), np.int64)
            w = b.column(k).to_numpy(zero_copy_only=False)
            for i in range(len(names)):
                v = b.column(k + 1 + i).to_numpy(zero_copy_only=False)  # nulls are NaN
                ok = ~np.isnan(v) & ~np.isnan(w.astype(np.float64))
                held.append((group[ok] * len(names) + i, encode(v[ok]), w[ok]))
                size += int(ok.sum())
            if size > HELD:
                yield from flush()
        yield from flush()

    return picked.mapInArrow(run, out)


def _grouped(df: DataFrame, k: int, out: T.StructType, finish: Callable[[list[tuple], Parts, list], pa.RecordBatch]) -> DataFrame:
    """Rows of ``df`` (k0.., name, form, codes) by group; ``finish(labels, parts, types)`` gives batches."""
    names = [*[f"k{i}" for i in range(k)], "name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[tuple] = []
        parts = Parts()
        room = max(1, BUILT // SIZE)
        types: list = []
        for b in batches:
            types = [b.schema.field(i).type for i in range(k + 1)]
            for *label, form, data in zip(*[b.column(i).to_pylist() for i in range(k + 3)], strict=True):
                label = tuple(label)
                if not labels or labels[-1] != label:
                    if len(labels) >= room:
                        yield finish(labels, parts, types)
                        labels, parts = [], Parts()
                    labels.append(label)
                parts.add(len(labels) - 1, form, data)
                if parts.held > HELD:  # many parts of a few groups: add up equal codes
                    parts.counted()
        if labels:
            yield finish(labels, parts, types)

    return df.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, out)


def _label_columns(labels: list[tuple], types: list, keep: Sequence[int]) -> list[pa.Array]:
    return [pa.array([x[i] for x in labels], types[i]) for i in keep]


def _many_parts(df: DataFrame) -> bool:
    """Whether a group may have parts in very many tasks, from the size of the input and the number of shuffle partitions."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    scan = size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(scan, int(spark.conf.get("spark.sql.shuffle.partitions"))) > FAN_IN


def _in_two_rounds(parts: DataFrame, k: int, many: bool) -> DataFrame:
    """With very many tasks, first add up the parts of a group in several tasks of their own."""
    if not many:
        return parts
    salted = parts.withColumn(f"k{k}", F.pmod(F.spark_partition_id(), F.lit(int(FAN_IN**0.5) + 1))).select(*[f"k{i}" for i in range(k + 1)], "name", "form", "codes")
    out = T.StructType([*parts.schema.fields[: k + 1], T.StructField("form", T.IntegerType()), T.StructField("codes", T.BinaryType())])

    def finish(labels: list[tuple], held: Parts, types: list) -> pa.RecordBatch:
        columns = _label_columns(labels, types, [i for i in range(k + 2) if i != k])
        return pa.RecordBatch.from_arrays([*columns, pa.array([STORED] * len(labels), pa.int32()), pa.array(held.stored(len(labels))[1], pa.binary())], names=[f.name for f in out.fields])

    return _grouped(salted, k + 1, out, finish)


def _stored(parts: DataFrame, k: int, many: bool) -> DataFrame:
    """(k0.., name, n, sketch) of parts."""
    out = T.StructType([*parts.schema.fields[: k + 1], T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def finish(labels: list[tuple], held: Parts, types: list) -> pa.RecordBatch:
        n, data = held.stored(len(labels))
        return pa.RecordBatch.from_arrays([*_label_columns(labels, types, range(k + 1)), pa.array(n), pa.array(data, pa.binary())], names=[f.name for f in out.fields])

    return _grouped(_in_two_rounds(parts, k, many), k, out, finish)


def sketches(df: DataFrame, keys: list[str], values: dict[str, Column], weight: Column | None = None, name: str = "name") -> DataFrame:
    """(keys..., name, n, sketch): the state of every value column per group, to be stored, merged and asked."""
    done = _stored(_counted(df, keys, values, weight), len(keys), _many_parts(df))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.col("name").alias(name), "n", "sketch")


def merge(states: DataFrame, keys: list[str], sign: Column | None = None) -> DataFrame:
    """(keys..., n, sketch): the sum of the states of each group; a ``sign`` below zero takes a state out."""
    form = F.lit(STORED) if sign is None else F.when(sign < 0, TAKEN).otherwise(STORED)
    parts = states.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.lit("").alias("name"), form.cast("int").alias("form"), F.col("sketch").alias("codes"))
    done = _stored(parts, len(keys), _many_parts(states))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], "n", "sketch")


def _answer_fields(df: DataFrame, labels: int) -> T.StructType:
    more = [T.StructField("quantile", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("rank_error", T.DoubleType())]
    return T.StructType([*df.schema.fields[:labels], *more])


def _answers(labels: list[pa.Array], out: T.StructType, parts: Parts, groups: int, quantiles: Sequence[float]) -> pa.RecordBatch:
    n, values, error = answer(parts.total(groups), quantiles)
    q = len(quantiles)
    at = pa.array(np.repeat(np.arange(groups), q))
    columns = [x.take(at) for x in labels]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.asarray(quantiles, float), groups)), pa.array(values.ravel()), pa.array(np.repeat(n, q).astype(np.int64)), pa.array(np.repeat(error, q))], names=[f.name for f in out.fields])


def ask(states: DataFrame, keys: list[str], quantiles: Sequence[float]) -> DataFrame:
    """(keys..., quantile, value, n, rank_error) of stored states."""
    picked = states.select(*keys, "sketch")
    k = len(keys)
    out = _answer_fields(picked, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = max(1, BUILT // SIZE)
        for b in batches:
            for at in range(0, b.num_rows, room):
                part = b.slice(at, room)
                held = Parts()
                for g, data in enumerate(part.column(k).to_pylist()):
                    held.add(g, STORED, data)
                yield _answers([part.column(i) for i in range(k)], out, held, part.num_rows, quantiles)

    return picked.mapInArrow(run, out)


def percentiles(df: DataFrame, keys: list[str], values: dict[str, Column], quantiles: Sequence[float], name: str = "name") -> DataFrame:
    """(keys..., name, quantile, value, n, rank_error) per group and value column, without storing the states."""
    k = len(keys)
    counted = _counted(df, keys, values, None)
    out = _answer_fields(counted, k + 1)

    def finish(labels: list[tuple], held: Parts, types: list) -> pa.RecordBatch:
        return _answers(_label_columns(labels, types, range(k + 1)), out, held, len(labels), quantiles)

    done = _grouped(_in_two_rounds(counted, k, _many_parts(df)), k, out, finish)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.col("name").alias(name), "quantile", "value", "n", "rank_error")
