"""Schemas that drift between files: per-file schemas, their differences, one union table.

The schema of every file is read in parallel (one pass over the records, one
row per file with its set of paths), the file schemas are folded through a
type-promotion lattice into one schema, each record is cast to it, and the
ordered differences between a file and its predecessor are listed.

The lattice: integer < decimal < string and boolean < string for scalars; a
scalar joined with an array is lifted to an element of it; an object joined with
other forms stays a struct, with the arrays in a field ``_items`` and the scalars
in a field ``_value`` beside its own fields; an object with keys that are no
identifiers is a map. So no form turns another one into text.

Fields that were renamed share a column, at every depth: names declared by the
caller, names that differ in ``camelCase`` and ``snake_case`` only, and names
that a file shows as renamed. Two names that one file ever holds side by side
are two fields, whatever a rename between other files looks like.

Defined cases
-------------
- A body that is null, empty or not valid JSON (``NaN`` and ``Infinity`` are not
  JSON, nor is nesting deeper than the parser's some thousand levels) counts for
  nothing, but its file exists: a file of broken bodies only has no path at all.
- A top-level value that is no object has no key and so no path.
- Null values give no path; an empty array gives its own path and no ``[]`` path.
- Repeated lines and records change nothing (schemas are sets).
- Without file ``n - 1`` of the same series, file ``n`` has no differences.
- Several paths gone and several new under one parent with the same types are
  ``removed`` and ``added``: which became which cannot be told.
- A table without rows gives no rows. Only the named columns are read, so extra
  columns of any name do no harm.
- In the union table a broken body is a row of nulls. What a column cannot hold
  (an integer beyond 64 bits, a second name of a field in the same record) is
  kept in ``misfits`` with its path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Joins of the scalar part of the lattice below its top; every other pair of scalars meets in string.
JOINS = {frozenset(("integer", "decimal")): "decimal"}
SCALARS = ("boolean", "decimal", "integer", "string")


class _Decimal(float):
    """A JSON number written with a point, and how it was written."""

    text: str


class _Long(int):
    """A JSON integer of 19 digits or more; only its text is exact."""

    text: str


def _number(text: str) -> int | _Decimal:
    value = _Decimal(text)
    value.text = text
    # an exponent without a point, as in 1e3, writes an integer
    return int(value) if "." not in text and value.is_integer() and abs(value) < 1e18 else value


def _integer(text: str) -> int:
    if len(text) < 19:
        return int(text)
    value = _Long(int(text) if len(text) < 4000 else 0)
    value.text = text
    return value


def _refuse(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def json_reader() -> Callable[[str | None], object]:
    """A function giving the value of a JSON text; ``None`` also where the text is not valid JSON."""
    decode = json.JSONDecoder(parse_float=_number, parse_constant=_refuse, parse_int=_integer).decode

    def parse(text: str | None) -> object:
        if not text:
            return None
        try:
            return decode(text)
        except (ValueError, RecursionError):
            return None

    return parse


def json_type(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, _Decimal):
        return "decimal"
    if isinstance(v, int):
        return "integer"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def paths_of(record: object) -> set[tuple[tuple[str, ...], str]]:
    """(steps, type) of every value that is not null; a step is ``.key`` or ``[]``, the outermost first."""
    found: set[tuple[tuple[str, ...], str]] = set()
    if not isinstance(record, dict):
        return found
    todo: list[tuple[tuple[str, ...], object]] = [((f".{k}",), v) for k, v in record.items()]
    while todo:
        at, v = todo.pop()
        if v is None:
            continue
        found.add((at, json_type(v)))
        if isinstance(v, dict):
            todo.extend(((*at, f".{k}"), x) for k, x in v.items())
        elif isinstance(v, list):
            below = (*at, "[]")
            todo.extend((below, x) for x in v)
    return found


def path_text(steps: Iterable[str]) -> str:
    """``a[].b`` of the steps ``.a``, ``[]``, ``.b``."""
    return "".join(steps)[1:]


_PATH = T.StructType([T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("type", T.StringType())])


def file_schemas(df: DataFrame, series: list[str], file_no: str, body: str) -> DataFrame:
    """(series..., file_no, paths): one row per file with its set of (steps, type).

    Records are reduced to the distinct paths of each batch, and these to one
    set per file and task, before they are shuffled: what moves is bounded by
    files x paths, not by records, and a file of any size is spread over as many
    tasks as its splits. A file without a valid record has an empty set.
    """
    keys = [*series, file_no]
    types = {f.name: f.dataType for f in df.schema.fields}
    out = T.StructType([T.StructField(f"__k{i}", types[k]) for i, k in enumerate(keys)] + [T.StructField("__paths", T.ArrayType(_PATH))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse_json = json_reader()
        for b in batches:
            seen: dict[tuple, set] = {}
            columns = [b.column(i).to_pylist() for i in range(len(keys))]
            for *key, text in zip(*columns, b.column(len(keys)).to_pylist(), strict=True):
                seen.setdefault(tuple(key), set()).update(paths_of(parse_json(text)))
            arrays = [pa.array([k[i] for k in seen], type=b.schema.field(i).type) for i in range(len(keys))]
            paths = pa.array([[{"steps": list(p), "type": t} for p, t in s] for s in seen.values()], to_arrow_type(T.ArrayType(_PATH)))
            yield pa.RecordBatch.from_arrays([*arrays, paths], names=[f.name for f in out.fields])

    raw = df.select(*[F.col(k) for k in keys], F.col(body)).mapInArrow(read, out)
    names = [f"__k{i}" for i in range(len(keys))]
    per = raw.select(*names, F.explode_outer("__paths").alias("__p")).groupBy(*names).agg(F.collect_set("__p").alias("paths"))
    return per.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "paths")


def _by_path(paths: list[dict]) -> tuple[dict[str, str], dict[str, set[str]], dict[str, str]]:
    """types, ancestors and parent of every path in text form."""
    types: dict[str, set[str]] = {}
    above: dict[str, set[str]] = {}
    parent: dict[str, str] = {}
    for p in paths:
        steps = p["steps"]
        text = path_text(steps)
        types.setdefault(text, set()).add(p["type"])
        above.setdefault(text, set()).update(path_text(steps[:i]) for i in range(1, len(steps)))
        parent[text] = path_text(steps[:-1])
    return {p: "|".join(sorted(t)) for p, t in types.items()}, above, parent


def differences(old: list[dict], new: list[dict]) -> list[tuple[str, str, str]]:
    """(change_kind, old_path, new_path) between the paths of two files; nothing below a path that itself changed."""
    (was, above_old, parent_old), (now, above_new, parent_new) = _by_path(old), _by_path(new)
    changed = {p for p in was.keys() | now.keys() if was.get(p) != now.get(p)}
    top = {p for p in changed if not (above_old.get(p, set()) | above_new.get(p, set())) & changed}
    moved: dict[tuple[str, str], tuple[list[str], list[str]]] = {}
    for p in top:
        if p not in now:
            moved.setdefault((parent_old[p], was[p]), ([], []))[0].append(p)
        elif p not in was:
            moved.setdefault((parent_new[p], now[p]), ([], []))[1].append(p)
    renamed = [("renamed", gone[0], came[0]) for gone, came in moved.values() if len(gone) == len(came) == 1]
    used = {p for _, a, b in renamed for p in (a, b)}
    return renamed + [("added" if p not in was else "removed" if p not in now else "retyped", p, p) for p in top - used]


def schema_changes(schemas: DataFrame, series: list[str], file_no: str) -> DataFrame:
    """(series..., file_no, change_kind, old_path, new_path): each file against the one before it.

    Every file schema goes to its own number and to the next, one shuffle; the
    two that meet there are compared.
    """
    keys = [*series, file_no]
    number = schemas.schema[file_no].dataType
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col(file_no).alias("at")), F.struct(F.lit(0).alias("side"), (F.col(file_no) + 1).cast(number).alias("at")))
    both = schemas.select(*series, F.explode(sides).alias("__s"), "paths").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(series)], F.col("__s.at").alias(f"__k{len(series)}"), F.struct("__s.side", "paths").alias("__file"))
    names = [f"__k{i}" for i in range(len(keys))]
    met = both.groupBy(*names).agg(F.collect_list("__file").alias("__files")).filter(F.size("__files") == 2)
    out = T.StructType([*[T.StructField(n, met.schema[n].dataType) for n in names], *[T.StructField(n, T.StringType()) for n in ("change_kind", "old_path", "new_path")]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *key, files in zip(*[b.column(i).to_pylist() for i in range(len(names) + 1)], strict=True):
                side = {f["side"]: f["paths"] for f in files}
                rows += [(*key, *d) for d in differences(side[0], side[1])]
            columns = [pa.array([r[i] for r in rows], b.schema.field(i).type) for i in range(len(names))]
            columns += [pa.array([r[len(names) + i] for r in rows], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    return met.mapInArrow(compare, out).select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "change_kind", "old_path", "new_path")


def promote(types: Iterable[str]) -> str:
    """The least scalar type that holds all of ``types``: integer < decimal < string, boolean < string."""
    met = ""
    for t in types:
        met = t if met in ("", t) else JOINS.get(frozenset((met, t)), "string")
    return met or "string"


def snake_case(name: str) -> str:
    """``verdictContradictions`` and ``verdict_contradictions`` both give the latter."""
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


@dataclass
class Known:
    """What is known beforehand of a column: its types, and other names that the field has had."""

    types: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()


@dataclass
class Node:
    """One column or nested field of the union schema."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Node] = field(default_factory=dict)  # by folded name
    names: dict[str, str] = field(default_factory=dict)  # key in a record -> folded name
    items: Node | None = None
    is_map: bool = False
    files: dict[str, int] = field(default_factory=dict)  # key in a record -> files that have it


def _identifier(key: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,63}", key) is not None


def _groups(keys: dict[str, int], renames: dict[tuple[str, str], int], apart: set[frozenset[str]], known: dict[str, Known]) -> dict[str, str]:
    """The folded name of each key under one parent.

    Declared names come first, then spelling, then renames by how many files show
    them; names met side by side in a file are never joined by the last two. A
    group goes by its declared name, else by the name that most files have.
    """
    group = {k: {k} for k in keys}

    def join(a: str, b: str, *, sure: bool) -> None:
        ga, gb = group[a], group[b]
        if ga is gb or (not sure and any(frozenset((x, y)) in apart for x in ga for y in gb)):
            return
        if not sure and len((ga | gb) & known.keys()) > 1:
            return
        ga |= gb
        for x in gb:
            group[x] = ga

    for name, k in known.items():
        for alias in k.aliases:
            if alias in group and name in group:
                join(name, alias, sure=True)
    by_spelling: dict[str, str] = {}
    for k in sorted(keys):
        join(by_spelling.setdefault(snake_case(k), k), k, sure=False)
    for (a, b), _ in sorted(renames.items(), key=lambda x: (-x[1], x[0])):
        if a in group and b in group:
            join(a, b, sure=False)
    out, taken = {}, set()
    for members in sorted({id(g): g for g in group.values()}.values(), key=min):
        declared = sorted(members & known.keys())
        name = declared[0] if declared else min(members, key=lambda k: (-keys[k], k))
        if not declared and snake_case(name) not in taken | keys.keys() | known.keys():
            name = snake_case(name)
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out |= dict.fromkeys(members, name)
    return out


def _siblings(schemas: DataFrame, names: set[str]) -> set[tuple[tuple[str, ...], str, str]]:
    """(steps of the parent, key, key) of ``names`` that stand side by side in some file: bounded by the schema, not by files."""
    keep = sorted(names)
    out = "parent array<string>, a string, b string"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(keep)
        found: set[tuple[tuple[str, ...], str, str]] = set()
        for b in batches:
            for paths in b.column(0).to_pylist():
                under: dict[tuple[str, ...], set[str]] = {}
                for p in paths:
                    if p["steps"][-1] != "[]" and p["steps"][-1][1:] in wanted:
                        under.setdefault(tuple(p["steps"][:-1]), set()).add(p["steps"][-1][1:])
                found |= {(at, x, y) for at, ks in under.items() for x in ks for y in ks if x < y}
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([list(r[0]) for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["parent", "a", "b"])

    return {(tuple(r.parent), r.a, r.b) for r in schemas.select("paths").mapInArrow(pairs, out).distinct().collect()}


def union_schema(schemas: DataFrame, changes: DataFrame, known: dict[str, Known] | None = None) -> Node:
    """The union of all file schemas; ``known`` describes columns by path, as an existing table's schema would.

    What reaches the driver is one row per distinct path (names of fields, no
    data), per distinct rename, and per pair of candidate names met in one file.
    Keys that are no identifiers count as one path, so objects used as maps with
    data as keys do not grow it.
    """
    known = known or {}
    fold = lambda s: F.when((s == "[]") | s.rlike(r"^\.[A-Za-z_][A-Za-z0-9_]{0,63}$"), s).otherwise("{}")
    rows = schemas.select(F.explode("paths").alias("p")).groupBy(F.transform("p.steps", fold).alias("steps"), "p.type").agg(F.count("*").alias("n")).collect()
    paths: dict[tuple[str, ...], dict[str, int]] = {}
    for r in rows:
        paths.setdefault(tuple(r["steps"]), {})[r["type"]] = r["n"]
    renames: dict[tuple[str, str, str], int] = {}
    for r in changes.filter(F.col("change_kind") == "renamed").groupBy("old_path", "new_path").count().collect():
        parent = max((path_text(s) for s in {(), *paths} if r["old_path"].startswith(path_text(s)) and r["new_path"].startswith(path_text(s)) and path_text(s) not in (r["old_path"], r["new_path"])), key=len)
        cut = len(parent) + 1 if parent else 0
        renames[parent, r["old_path"][cut:], r["new_path"][cut:]] = r["count"]
    names = {s[-1][1:] for s in paths if s[-1].startswith(".")}
    spelled: dict[str, set[str]] = {}
    for n in names:
        spelled.setdefault(snake_case(n), set()).add(n)
    candidates = {n for _, a, b in renames for n in (a, b)} | {n for g in spelled.values() if len(g) > 1 for n in g}
    beside = _siblings(schemas, candidates) if candidates else set()
    kin: dict[str, list[str]] = {}
    for text in known:
        parent, _, name = text.rpartition(".")
        if not text.endswith("[]"):
            kin.setdefault(parent, []).append(name)

    def build(raw: list[tuple[str, ...]], text: str) -> Node:
        """``raw`` are all step sequences that lead to this place, ``text`` its folded path."""
        node = Node(set(known[text].types) if text in known else set())
        for s in raw:
            node.kinds |= paths.get(s, {}).keys()
        if not text:
            node.kinds.add("object")
        below = [s for s in paths for r in raw if len(s) == len(r) + 1 and s[: len(r)] == r]
        own = {n: known[f"{text}.{n}" if text else n] for n in kin.get(text, ())}
        for s in below:
            if s[-1].startswith("."):
                node.files[s[-1][1:]] = node.files.get(s[-1][1:], 0) + sum(paths[s].values())
        keys = {**dict.fromkeys(own, 0), **node.files}
        node.is_map = any(s[-1] == "{}" for s in below)
        items = [s for s in below if s[-1] == "[]"]
        if items or f"{text}[]" in known:
            node.items = build(items, f"{text}[]")
        if node.is_map:
            node.fields = {"{}": build([s for s in below if s[-1] != "[]"], f"{text}.*")}
        elif keys:
            texts = {path_text(r) for r in raw}
            moved: dict[tuple[str, str], int] = {}
            for (p, a, b), n in renames.items():
                if p in texts:
                    moved[a, b] = moved.get((a, b), 0) + n
            apart = {frozenset((a, b)) for p, a, b in beside if p in set(raw)}
            node.names = _groups(keys, moved, apart, own)
            for name in sorted(set(node.names.values())):
                node.fields[name] = build([s for s in below if s[-1].startswith(".") and node.names[s[-1][1:]] == name], f"{text}.{name}" if text else name)
        return node

    return build([()], "")


def column_map(node: Node, at: str = "", out: list | None = None) -> list[tuple[str, str, str, int]]:
    """(column, key in records, type, files) of every field of the union schema."""
    out = [] if out is None else out
    for name, child in node.fields.items():
        path = f"{at}.{name}" if at else name
        if name != "{}":
            kind, _ = _caster(child, path)
            out += [(path, k, kind.simpleString(), node.files.get(k, 0)) for k in sorted(k for k, v in node.names.items() if v == name)]
        column_map(child, path, out)
    if node.items:
        column_map(node.items, f"{at}[]", out)
    return out


def _text(v: object) -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, (_Decimal, _Long)):
        return v.text
    return json.dumps(v, ensure_ascii=False, default=str)


Misfits = list[dict[str, str]]
Cast = Callable[[object, Misfits], object]


def _scalar(kind: str, path: str) -> tuple[T.DataType, Cast]:
    def misfit(v: object, out: Misfits) -> None:
        out.append({"path": path, "value": _text(v)})

    def integer(v: object, out: Misfits) -> object:
        return misfit(v, out) if isinstance(v, _Long) and not -(2**63) <= int(v.text if len(v.text) < 40 else 2**64) < 2**63 else int(v)

    def decimal(v: object, out: Misfits) -> object:
        x = float(v.text) if isinstance(v, _Long) else float(v)
        return misfit(v, out) if x in (float("inf"), float("-inf")) else x

    casts = {"boolean": (T.BooleanType(), lambda v, _o: v), "integer": (T.LongType(), integer), "decimal": (T.DoubleType(), decimal), "string": (T.StringType(), lambda v, _o: _text(v))}
    return casts[kind]


def _caster(node: Node, path: str) -> tuple[T.DataType, Cast]:
    """The column type of a node, and the function that casts a JSON value to it."""
    plain = sorted(node.kinds & {*SCALARS})
    has_list, has_object = "array" in node.kinds or node.items is not None, bool(node.fields) or "object" in node.kinds
    if has_object and not node.fields:
        return T.StringType(), lambda v, _o: None if v is None else _text(v)  # objects without any key known
    if has_list:
        element = node.items or Node()
        if not has_object:
            element = Node(element.kinds | set(plain), element.fields, element.names, element.items, element.is_map, element.files)
        of, cast_item = _caster(element, f"{path}[]") if element.kinds or element.fields or element.items else _scalar("string", f"{path}[]")
        if not has_object:
            return T.ArrayType(of), lambda v, o: None if v is None else [None if x is None else cast_item(x, o) for x in (v if isinstance(v, list) else [v])]
    if not has_object:
        kind, cast = _scalar(promote(plain), path)
        return kind, lambda v, o: None if v is None else cast(v, o)
    if node.is_map:
        of_entry, cast_entry = _caster(node.fields["{}"], f"{path}.*")
        inner: T.DataType = T.MapType(T.StringType(), of_entry)
        mapped = lambda v, o: [(k, cast_entry(x, o)) for k, x in v.items()]
        parts: list[T.StructField] = [T.StructField("_entries", inner)]
        casts: dict[str, Cast] = {}
    else:
        kinds = {n: _caster(c, f"{path}.{n}" if path else n) for n, c in node.fields.items()}
        parts, casts = [T.StructField(n, k) for n, (k, _) in kinds.items()], {n: c for n, (_, c) in kinds.items()}
    taken = {p.name for p in parts}
    list_name, value_name = ("_items" if "_items" not in taken else "_items_"), ("_value" if "_value" not in taken else "_value_")
    if has_list:
        parts.append(T.StructField(list_name, T.ArrayType(of)))
    if plain:
        of_value, cast_value = _scalar(promote(plain), path)
        parts.append(T.StructField(value_name, of_value))
    if node.is_map and not has_list and not plain:
        return inner, lambda v, o: None if v is None else mapped(v, o)
    names = node.names

    def struct(v: object, o: Misfits) -> object:
        if v is None:
            return None
        if isinstance(v, list):
            return {list_name: [None if x is None else cast_item(x, o) for x in v]}
        if not isinstance(v, dict):
            return {value_name: cast_value(v, o)}
        if node.is_map:
            return {"_entries": mapped(v, o)}
        out: dict[str, object] = {}
        source: dict[str, str] = {}
        for k, x in v.items():
            name = names.get(k)
            if x is None or name is None:
                continue
            if name in source:  # two names of one field: the column's own, else the first by name
                lost = max(k, source[name], key=lambda c: (c != name, c))
                o.append({"path": f"{path}.{lost}" if path else lost, "value": _text(v[lost])})
                if lost == k:
                    continue
            source[name] = k
            out[name] = casts[name](x, o)
        return out

    return T.StructType(parts), struct


def unify(df: DataFrame, keep: list[str], body: str, root: Node) -> DataFrame:
    """``keep``, one typed column per field of the union schema, and ``misfits`` array<struct<path, value>>.

    A field called like a kept column gets ``_`` behind its name. No shuffle:
    every record is cast where it lies.
    """
    kind, cast = _caster(root, "") if root.fields else (T.StructType([]), lambda _v, _o: {})
    taken = {k.lower() for k in [*keep, "misfits"]}
    alias = {}
    for f in kind.fields:
        name = f.name
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        alias[f.name] = name
    misfits = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))
    fields = [T.StructField(f"__c{i}", f.dataType) for i, f in enumerate(kind.fields)]
    out = T.StructType([*[df.schema[k] for k in keep], *fields, T.StructField("misfits", misfits)])
    arrow = [to_arrow_type(f.dataType) for f in out.fields[len(keep) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = json_reader()
        for b in batches:
            rows, odd = [], []
            for text in b.column(len(keep)).to_pylist():
                v, notes = parse(text), []
                rows.append(cast(v, notes) if isinstance(v, dict) else {})
                odd.append(notes or None)
            columns = [pa.array([r.get(f.name) for r in rows], t) for f, t in zip(kind.fields, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *columns, pa.array(odd, arrow[-1])], names=[f.name for f in out.fields])

    done = df.select(*keep, F.col(body)).mapInArrow(run, out)
    return done.select(*keep, *[F.col(f"__c{i}").alias(alias[f.name]) for i, f in enumerate(kind.fields)], "misfits")
