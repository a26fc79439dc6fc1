"""Flat child tables of ledger entries and contract bodies, by columnar shredding.

Both inputs are shredded batch by batch (:mod:`shred`), without a shuffle: the
levels of a record never leave its batch. Entries are typed columns already and
are shredded from their Arrow lists; bodies are parsed first. Each child row
carries the key of its parent record, its own path with its place in every list
above it (``assertions[2].ac[0]``), and the path of the row it belongs to
(``assertions[2]``; null for a child of the record itself). The paths depend on
the record alone, so (parent_key, parent_path) of a child finds (parent_key,
path) of its parent however records are dealt into batches.

Contract bodies come in several forms, which differ in the steps of their paths
only:

- the contract is the body, its ``contract``, its ``data.contract``, or any of
  these again as a JSON text within a text (paths are given from the contract on);
- ``assertions`` is a list, a list of blocks that hold lists, or a map by id;
- the criteria of an assertion are a list or one text separated by ``,`` or ``;``;
- ``file_changes`` is a list of paths or of objects, a list of directories with
  their files, lists by action, a map from path to action, or a single object.

Defined cases: null, empty and broken bodies have no children; children without
an id or path, or with a blank one, have none either; ids that are numbers are
written as text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import shred as S
from tallyforge.operators.schema_drift import json_reader

CHILD_SCHEMA = "parent_key bigint, child_kind string, child_key string, parent_path string, path string, detail string"
#: Children of one kind at one place of the schema: record number, kind, key, path of the parent row, own path, detail.
Piece = tuple[np.ndarray, str, pa.Array, pa.Array, pa.Array, pa.Array]
Columns = dict[S.Path, S.Column]


def text_of(v: object) -> str | None:
    """An id or path as text; ``None`` for none, blanks, objects and booleans."""
    if isinstance(v, str):
        return v.strip() or None
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def contract_maps(path: S.Path, v: dict) -> bool:
    """Which objects of a contract body are maps."""
    if not path:
        return False
    if path[-1] == "assertions":
        return not isinstance(v.get("id"), str)
    return path[-1] == "file_changes" and not isinstance(v.get("path"), str) and not isinstance(v.get("dir"), str)


def path_texts(columns: Columns, at: S.Path, below: S.Path = ()) -> pa.Array:
    """The path of each row of the table at ``at``, from the contract on, with the keys ``below`` behind it."""
    places = iter(S.places(columns, at))
    while at[:1] in (("data",), ("contract",)) or below[:1] in (("data",), ("contract",)):
        at, below = (at[1:], below) if at else (at, below[1:])
    pieces: list = []
    text = ""
    for i, step in enumerate((*at, *below)):
        if step in S.REPEATED:
            pieces += [text + "[", pc.cast(pa.array(next(places)), pa.string())]
            text = "]"
        elif step != "value" or i == 0:
            text += f".{step}" if text or pieces else step
    if not pieces:
        return pa.array([text] * len(S.table(columns, at).record), pa.string())
    return pc.binary_join_element_wise(*pieces, text, "")


class _Rows:
    """Children found one by one, to be made a piece."""

    def __init__(self, kind: str, links: bool) -> None:
        self.kind, self.links = kind, links
        self.record: list[int] = []
        self.key: list[str] = []
        self.parent: list[str | None] = []
        self.path: list[str | None] = []
        self.detail: list[str | None] = []

    def add(self, record: int, key: str, path: str | None, parent: str | None = None, detail: object = None) -> None:
        self.record.append(record)
        self.key.append(key)
        if self.links:
            self.path.append(path)
            self.parent.append(parent)
            self.detail.append(detail if isinstance(detail, str) else None)

    def piece(self) -> Piece:
        n = len(self.record)
        more = [pa.array(c, pa.string()) if self.links else pa.nulls(n, pa.string()) for c in (self.parent, self.path, self.detail)]
        return (np.asarray(self.record, np.int64), self.kind, pa.array(self.key, pa.string()), *more)


def contract_children(columns: Columns, links: bool = True) -> Iterator[Piece]:
    """Assertions, their criteria and file changes of shredded contract bodies."""
    for at in [(), *S.ancestors_of(columns)]:
        keys = [s for s in at if s not in S.REPEATED]
        while keys[:1] in (["data"], ["contract"]):
            keys = keys[1:]
        if keys and all(k in ("assertions", "value") for k in keys) and at and at[-1] in S.REPEATED:
            yield from _assertions(columns, at, (), links)
        elif keys == ["file_changes"] or (keys[:1] == ["file_changes"] and at[-1] == "[]" and keys[1:] == ["value"]):
            yield from _changes(columns, at, (), links)
        elif not at:  # a single object in place of a list
            for prefix in ((), ("contract",), ("data", "contract")):
                yield from _changes(columns, (), (*prefix, "file_changes"), links)
                yield from _assertions(columns, (), (*prefix, "assertions"), links)


def _assertions(columns: Columns, at: S.Path, below: S.Path, links: bool) -> Iterator[Piece]:
    rows = S.table(columns, at)
    n = len(rows.record)
    none = np.full(n, None, object)
    mapped = at[-1:] == ("{}",)
    inner = (*below, "value") if mapped else below
    ids = rows.columns.get(("key",) if mapped else (*below, "id"))
    if ids is None:
        return
    if mapped:  # the entries of a map by id are objects; other values are no assertions
        within = np.zeros(n, bool)
        for p, v in rows.columns.items():
            if p[: len(inner)] == inner and len(p) > len(inner):
                within |= np.not_equal(v, None).astype(bool)
        ids = np.where(within, ids, None)
    names = [text_of(x) for x in ids]
    record = rows.record.tolist()
    path = path_texts(columns, at, below).to_pylist() if links else [None] * n
    out, own = _Rows("assertion", links), _Rows("assertion_ac", links)
    for i, (name, says) in enumerate(zip(names, rows.columns.get((*inner, "says"), none), strict=True)):
        if name:
            out.add(record[i], name, path[i], None, says)
    for i, v in enumerate(rows.columns.get((*inner, "ac"), ())):
        if v is not None and names[i]:
            for k, ac in enumerate(_criteria(v)):
                own.add(record[i], f"{names[i]}/{ac}", f"{path[i]}.ac[{k}]", path[i])
    listed = S.table(columns, (*at, *inner, "ac", "[]"))
    for i, pos, v in zip(listed.parent.tolist(), listed.pos.tolist(), listed.columns.get((), ()), strict=False):
        if names[i]:
            for k, ac in enumerate(_criteria(v)):
                own.add(record[i], f"{names[i]}/{ac}", f"{path[i]}.ac[{pos}]" + (f"[{k}]" if k else ""), path[i])
    yield out.piece()
    yield own.piece()


def _criteria(v: object) -> list[str]:
    if isinstance(v, str):
        if "," not in v and ";" not in v:
            return [t] if (t := v.strip()) else []
        return [x for x in (y.strip() for y in v.replace(";", ",").split(",")) if x]
    return [t] if (t := text_of(v)) else []


def _changes(columns: Columns, at: S.Path, below: S.Path, links: bool) -> Iterator[Piece]:
    """Paths at one ancestor; a directory's are joined with those of the files in it."""
    rows = S.table(columns, at)
    none = np.full(len(rows.record), None, object)
    get = lambda *p: rows.columns.get((*below, *p), none)
    direct, own, action, folder = get() if at else none, get("path"), get("action"), get("dir")
    if at[-1:] == ("{}",):
        # a map from path to action: the value is a text; lists by action are rows of their own
        own = [k if isinstance(v, str) else None for k, v in zip(get("key"), get("value"), strict=True)]
        action, direct = get("value"), none
    path = path_texts(columns, at, below).to_pylist() if links else [None] * len(none)
    out = _Rows("file_change", links)
    for r, p, x, y, z in zip(rows.record.tolist(), path, own, direct, action, strict=True):
        if name := text_of(x) or text_of(y):
            out.add(r, name, p, None, z)
    files = S.table(columns, (*at, *below, "files", "[]"))
    for tail in ((), ("name",), ("path",)):
        for r, i, pos, v in zip(files.record.tolist(), files.parent.tolist(), files.pos.tolist(), files.columns.get(tail, ()), strict=False):
            if name := text_of(v):
                top = text_of(folder[i])
                out.add(r, f"{top.rstrip('/')}/{name.lstrip('/')}" if top else name, f"{path[i]}.files[{pos}]")
    yield out.piece()


def entry_children(columns: Columns, links: bool = True) -> Iterator[Piece]:
    """Assertions, contract totals and timing segments of shredded ledger entries, whole columns at a time."""

    def piece(rows: S.Rows, at: S.Path, kind: str, key: pa.Array, keep: pa.Array, detail: S.Path) -> Piece:
        n = len(rows.record)
        path = path_texts(columns, at) if links else pa.nulls(n, pa.string())
        text = rows.columns[detail] if links and detail in rows.columns else pa.nulls(n, pa.string())
        return (rows.record[np.asarray(keep)], kind, key.filter(keep), pa.nulls(pc.sum(keep).as_py() or 0, pa.string()), path.filter(keep), text.filter(keep))

    at = ("assertions", "[]")
    rows = S.table(columns, at)
    ids = pc.utf8_trim_whitespace(rows.columns[("id",)])
    yield piece(rows, at, "entry_assertion", ids, pc.fill_null(pc.greater(pc.utf8_length(ids), 0), False), ("says",))
    top = S.table(columns, ())
    given = np.zeros(len(top.record), bool)
    for p, v in top.columns.items():
        if p[:1] == ("contract",):
            given |= np.asarray(v.is_valid())
    n = int(given.sum())
    yield top.record[given], "entry_contract", pa.array(["contract"] * n, pa.string()), pa.nulls(n, pa.string()), pa.array(["contract"] * n, pa.string()), pa.nulls(n, pa.string())
    at = ("segments", "[]")
    rows = S.table(columns, at)
    pos = pc.cast(pa.array(rows.pos), pa.string())
    yield piece(rows, at, "entry_segment", pos, pc.is_valid(rows.columns[("present",)]), ("stage",))


def _out(keys: pa.Array, pieces: Iterator[Piece]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CHILD_SCHEMA.split(", ")]
    for record, kind, key, parent, path, detail in pieces:
        if len(record):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(record)), pa.array([kind] * len(record), pa.string()), key, parent, path, detail], names=names)


#: Records shredded at once, which bounds the memory of the levels.
BATCH = 4_000


def body_reader() -> Callable[[str | None], object]:
    """As :func:`json_reader`, but numbers need not keep their form."""
    fast, exact = json.JSONDecoder(parse_constant=float).decode, json_reader()

    def parse(text: str | None) -> object:
        if not text or "NaN" in text or "Infinity" in text:
            return exact(text)
        try:
            return fast(text)
        except (ValueError, RecursionError):  # broken, or an integer of thousands of digits
            return exact(text)

    return parse


def contract_tables(contracts: DataFrame, links: bool = True) -> DataFrame:
    """Children of ``contracts(contract_id, body)``; without ``links`` paths and details are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = body_reader()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                records = [read(t) for t in part.column(1).to_pylist()]
                for i, v in enumerate(records):
                    while isinstance(v, str):  # a body written as a JSON text within a text
                        v = read(v)
                    records[i] = v
                yield from _out(part.column(0), contract_children(S.shred(records, contract_maps), links))

    return contracts.select(F.col("contract_id").cast("bigint").alias("k"), F.col("body").alias("b")).mapInArrow(run, CHILD_SCHEMA)


def _contract(v: object) -> dict | None:
    """The contract of a parsed body: itself, its ``contract``, its ``data.contract``."""
    for k in ("data", "contract"):
        if isinstance(v, dict) and isinstance(v.get(k), dict):
            v = v[k]
    return v if isinstance(v, dict) else None


def _each_assertion(v: object) -> Iterator[dict]:
    """Assertions of a list, of blocks that hold lists, of a map by id, or a single one."""
    if isinstance(v, dict):
        v = [v] if isinstance(v.get("id"), str) else list(v.values())
    for x in v if isinstance(v, list) else ():
        if isinstance(x, dict):
            if isinstance(x.get("assertions"), (list, dict)):
                yield from _each_assertion(x["assertions"])
            else:
                yield x


def _named(v: object) -> list[str]:
    return [c for x in (v if isinstance(v, list) else [v]) for c in _criteria(x)]


def contract_criteria(contracts: DataFrame) -> DataFrame:
    """(item, kind, ac, matcher) of ``contracts(contract_id, body)`` in every form of body.

    ``kind`` is ``contract`` (one row each, without a criterion), ``link`` (an
    assertion and a criterion it names) or ``waiver``, whose matcher is the way
    it is waived (judgment or retired). A waiver without a reason or of another
    kind is none; of several for one criterion the last counts. Criteria are in
    upper case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = body_reader()
        for batch in batches:
            rows: list[tuple[int, str, str | None, str | None]] = []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = read(v)
                while isinstance(v, str):
                    v = read(v)
                c = _contract(v)
                if c is None:
                    continue
                rows.append((key, "contract", None, None))
                for x in _each_assertion(c.get("assertions")):
                    m = x.get("matcher")
                    rows += [(key, "link", ac.upper(), m if isinstance(m, str) else None) for ac in _named(x.get("ac"))]
                waivers, waived = c.get("coverage_waivers"), {}
                for w in waivers if isinstance(waivers, list) else [waivers]:
                    if isinstance(w, dict) and w.get("kind") in ("judgment", "retired") and text_of(w.get("reason")):
                        waived |= dict.fromkeys((ac.upper() for ac in _named(w.get("ac"))), w["kind"])
                rows += [(key, "waiver", ac, way) for ac, way in waived.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], names=["item", "kind", "ac", "matcher"])

    return contracts.select(F.col("contract_id").cast("bigint"), "body").mapInArrow(run, "item bigint, kind string, ac string, matcher string")


def contract_fields(contracts: DataFrame) -> DataFrame:
    """(contract_id, missing, valid, version, sealed_by, assertions, file_changes) of ``contracts(contract_id, body)`` in every form of body.

    ``valid`` are bodies whose contract is an object; lists and maps are counted, null where there are none.
    """
    out = "contract_id bigint, missing boolean, valid boolean, version string, sealed_by string, assertions bigint, file_changes bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = json_reader()
        size = lambda v: len(v) if isinstance(v, (list, dict)) else None
        text = lambda v: None if v is None else getattr(v, "text", None) or (v if isinstance(v, str) else json.dumps(v))
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = read(body)
                while isinstance(v, str):
                    v = read(v)
                c = _contract(v)
                d = c or {}
                rows.append((key, body is None, c is not None, text(d.get("version")), text(d.get("sealed_by")), size(d.get("assertions")), size(d.get("file_changes"))))
            types = [pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in out.split(", ")])

    return contracts.select(F.col("contract_id").cast("bigint"), "body").mapInArrow(run, out)


def entry_tables(entries: DataFrame, links: bool = True) -> DataFrame:
    """Children of ``entries(entry_idx, assertions, contract, timing)``; without ``links`` paths and details are null.

    Segments get a mark so that one whose fields are all null still differs from
    a null element.
    """
    segment = lambda s: F.when(s.isNotNull(), F.struct(*([s.stage.alias("stage")] if links else []), F.lit(1).alias("present")))
    said = lambda a: F.when(a.isNotNull(), F.struct(a.id.alias("id"), *([a.says.alias("says")] if links else [])))
    body = F.struct(F.transform("assertions", said).alias("assertions"), "contract", F.transform("timing.segments", segment).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _out(batch.column(0), entry_children(S.shred_arrow(batch.column(1)), links))

    return entries.select(F.col("entry_idx").cast("bigint").alias("k"), body.alias("b")).mapInArrow(run, CHILD_SCHEMA)
