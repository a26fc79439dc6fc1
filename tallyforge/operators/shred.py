"""Columnar shredding of nested records, and flat tables rebuilt from the levels.

Each leaf path of a batch of records becomes one column of (repetition level,
definition level, value) triples: the repetition level tells at which repeated
step of the path a value starts a new element, the definition level how many
steps of the path are present. Values therefore need no keys of their own:
counting the entries whose repetition level does not exceed an ancestor's gives
the row of that ancestor, so child tables with links to their parents come from
the level sequences alone.

A path is a tuple of steps: a key, ``[]`` for the elements of an array, ``{}``
for the entries of an object that is used as a map (``key`` and ``value`` below).

Defined cases
-------------
- null and absent values have a lower definition level; a null element of an
  array is an element without a value, an empty array has no element.
- A path may be scalar in one record and array or object in another: each form
  has its own path, and the others are null there.
- Records that are null or of another kind than object or array give one null
  entry per path, so record numbers stay aligned.
- Repeated records are shredded again: removing them is up to the caller.
- An empty batch gives no columns, a path that occurs nowhere an empty table.

Both ways in work column by column, without a call per value: parsed JSON is
split node by node into the lists of its children (so nesting of any depth needs
no recursion), Arrow columns give their levels straight from list offsets and
validity bits, without a Python object for any value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

Path = tuple[str, ...]
MapRule = Callable[[Path, dict], bool]
REPEATED = ("[]", "{}")


@dataclass
class Column:
    """The (repetition level, definition level, value) triples of a leaf path."""

    rep: np.ndarray
    defn: np.ndarray
    value: np.ndarray | pa.Array


@dataclass
class Slots:
    """The places of one node in record order: levels, and the number of the value there (-1 for none)."""

    rep: np.ndarray
    defn: np.ndarray
    at: np.ndarray

    def one(self, child: np.ndarray) -> Slots:
        """Places of a field; ``child`` is the number of the field's value by number of the value here."""
        at = np.where(self.at >= 0, child[self.at], -1) if len(child) else np.full(len(self.at), -1)
        return Slots(self.rep, self.defn + (at >= 0), at)

    def many(self, starts: np.ndarray, counts: np.ndarray, level: int) -> Slots:
        """Places of repeated elements: those of value i are ``starts[i]`` to ``starts[i] + counts[i]``."""
        there = self.at >= 0
        n = np.where(there, counts[self.at], 0) if len(counts) else np.zeros(len(self.at), np.int64)
        wide = np.maximum(n, 1)
        back = np.repeat(np.arange(len(n)), wide)
        nth = np.arange(len(back)) - np.repeat(np.cumsum(wide) - wide, wide)
        some = n[back] > 0
        first = starts[np.maximum(self.at[back], 0)] if len(starts) else np.zeros(len(back), np.int64)
        return Slots(np.where(nth == 0, self.rep[back], level), self.defn[back] + some, np.where(some, first + nth, -1))


@dataclass
class Node:
    """The values at one path of a batch: ``owner`` is the number of the value above that each belongs to."""

    values: list[object] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)


def split(path: Path, node: Node, is_map: MapRule) -> dict[str, Node]:
    """The nodes below; null fields are left out, null elements are elements."""
    below: dict[str, Node] = {}
    for i, v in enumerate(node.values):
        if v.__class__ is dict:
            if is_map(path, v):
                child = below.setdefault("{}", Node())
                child.values += [{"key": k, "value": x} for k, x in v.items()]
                child.owner += [i] * len(v)
                continue
            for k, x in v.items():
                if x is not None:
                    child = below.get(k)
                    if child is None:
                        child = below[k] = Node()
                    child.values.append(x)
                    child.owner.append(i)
        elif v.__class__ is list:
            child = below.setdefault("[]", Node())
            child.values += v
            child.owner += [i] * len(v)
    return below


def shred(records: list[object], is_map: MapRule = lambda _p, _v: False) -> dict[Path, Column]:
    """One column of levels and values per leaf path of parsed records."""
    out: dict[Path, Column] = {}
    n = len(records)
    todo = [((), Node(records), 0, Slots(np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)))]
    while todo:
        path, node, level, slots = todo.pop()
        scalar = np.fromiter((v is not None and v.__class__ is not dict and v.__class__ is not list for v in node.values), bool, len(node.values))
        if path and scalar.any():
            here = (slots.at >= 0) & scalar[slots.at]
            value = np.full(len(here), None, object)
            held = np.empty(len(node.values), object)
            held[:] = node.values
            value[here] = held[slots.at[here]]
            out[path] = Column(slots.rep, slots.defn + here, value)
        for step, child in split(path, node, is_map).items():
            owner = np.asarray(child.owner, np.int64)
            if step in REPEATED:
                counts = np.bincount(owner, minlength=len(node.values))
                todo.append(((*path, step), child, level + 1, slots.many(np.cumsum(counts) - counts, counts, level + 1)))
            else:
                number = np.full(len(node.values), -1)
                number[owner] = np.arange(len(owner))
                todo.append(((*path, step), child, level, slots.one(number)))
    return out


def shred_arrow(array: pa.StructArray) -> dict[Path, Column]:
    """One column of levels and values per leaf path of an Arrow array of structs."""
    out: dict[Path, Column] = {}
    n = len(array)
    todo = [((), array, 0, Slots(np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)))]
    while todo:
        path, arr, level, slots = todo.pop()
        if pa.types.is_struct(arr.type):
            for i in range(arr.type.num_fields):
                child = arr.field(i)
                valid = np.asarray(child.is_valid()) & np.asarray(arr.is_valid())
                todo.append(((*path, arr.type.field(i).name), child, level, slots.one(np.where(valid, np.arange(len(arr)), -1))))
        elif pa.types.is_list(arr.type) or pa.types.is_large_list(arr.type):
            offsets = np.asarray(arr.offsets).astype(np.int64)
            counts = np.where(np.asarray(arr.is_valid()), np.diff(offsets), 0)
            todo.append(((*path, "[]"), arr.values, level + 1, slots.many(offsets[:-1], counts, level + 1)))
        else:
            here = (slots.at >= 0) & (np.asarray(arr.is_valid())[slots.at] if len(arr) else False)
            out[path] = Column(slots.rep, slots.defn + here, arr.take(pa.array(slots.at, mask=~here)))
    return out


@dataclass
class Rows:
    """The table of one repeated ancestor: a row per element.

    ``record`` is the record's number, ``parent`` the row in the table of the
    next repeated ancestor above (the record itself at the top), ``pos`` the
    place among its siblings from 0, ``columns`` the scalar leaves below by the
    steps after the ancestor.
    """

    record: np.ndarray
    parent: np.ndarray
    pos: np.ndarray
    columns: dict[Path, np.ndarray | pa.Array]


def repeated_of(path: Path) -> int:
    return sum(s in REPEATED for s in path)


def ancestors_of(columns: dict[Path, Column]) -> list[Path]:
    """Every repeated ancestor of the leaf paths, outer before inner."""
    found = {p[: i + 1] for p in columns for i, s in enumerate(p) if s in REPEATED}
    return sorted(found, key=lambda p: (len(p), p))


def above(path: Path) -> Path:
    """The next repeated ancestor above one; ``()`` for the records."""
    return path[: max((i + 1 for i, s in enumerate(path[:-1]) if s in REPEATED), default=0)]


def table(columns: dict[Path, Column], ancestor: Path) -> Rows:
    """Rebuild the rows of a repeated ancestor (or of the records, for ``()``) from the level sequences.

    Definition levels count the present steps, so an element of the ancestor is
    present where the level reaches the number of its steps.
    """
    depth, level, n = len(ancestor), repeated_of(ancestor), 0
    record = parent = pos = np.empty(0, np.int64)
    values: dict[Path, np.ndarray | pa.Array] = {}
    for path, col in columns.items():
        if path[:depth] != ancestor:
            continue
        starts = np.flatnonzero(col.rep <= level)
        here = starts[col.defn[starts] >= depth]
        if not values and not n:
            record = np.cumsum(col.rep == 0)[here] - 1
            # rows of the next repeated ancestor above: those of its starts that are present
            up = above(ancestor)
            up_start = (col.rep <= repeated_of(up)) & ((col.defn >= len(up)) if up else True)
            parent = np.cumsum(up_start)[here] - 1
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(here) else np.empty(0, np.int64)
            run = np.diff(np.r_[first, len(here)])
            pos = np.arange(len(here)) - np.repeat(first, run)
            n = len(here)
        if repeated_of(path) == level:
            values[path[depth:]] = col.value.take(pa.array(here)) if isinstance(col.value, pa.Array) else col.value[here]
    return Rows(record, parent, pos, values)


def places(columns: dict[Path, Column], ancestor: Path) -> list[np.ndarray]:
    """For each row of an ancestor's table its place in every repeated step of the path, outermost first.

    With the record's key these are the same however records are dealt into
    batches, so they link children to parents.
    """
    out: list[np.ndarray] = []
    row = None
    while ancestor:
        t = table(columns, ancestor)
        out.append(t.pos if row is None else t.pos[row])
        row = t.parent if row is None else t.parent[row]
        ancestor = above(ancestor)
    return out[::-1]
