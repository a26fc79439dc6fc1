"""Run a query and its SQL over the same tables and compare rows as sets of tuples."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


#: Spark's type names by the other engine's.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def duck_types(sql: str, sf_dir: str) -> dict[str, str]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return {r[0]: TYPES.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}


def differences(spark: SparkSession, query: object, sql: str, sf_dir: str) -> str:
    """Empty where both agree."""
    df = query(spark, sf_dir)
    if (t1 := dict(df.dtypes)) != (t2 := duck_types(sql, sf_dir)):
        return f"types {sorted(t1.items() - t2.items())} and {sorted(t2.items() - t1.items())}"
    n1, a = spark_rows(df)
    n2, b = duck_rows(sql, sf_dir)
    if n1 != n2:
        return f"columns {n1} and {n2}"
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only spark {list((a - b).items())[:4]}; only sql {list((b - a).items())[:4]}"
