"""Rules as data: a registry of named conditions applied to every row in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[DataFrame], Column]


def usable(df: DataFrame, rules: Mapping[str, Rule]) -> tuple[dict[str, Column], list[str]]:
    """The rules that can be planned on ``df``, and the names of those that cannot (a column that is not there, a wrong type)."""
    good: dict[str, Column] = {}
    bad: list[str] = []
    for name, rule in rules.items():
        try:
            cond = rule(df)
            df.select(cond.cast("boolean")).schema  # noqa: B018 - plans the rule
            good[name] = cond
        except Exception:  # noqa: BLE001 - whatever is wrong with a rule, the others go on
            bad.append(name)
    return good, bad


def rule_violations(df: DataFrame, key: str, rules: Mapping[str, Rule]) -> DataFrame:
    """(key, violation): one row for each rule that a row breaks; one pass, no shuffle.

    A rule that cannot be planned is skipped: it gives a single row with a null
    key and ``skipped: <name>``, the others are not touched. A condition that is
    null is no violation.
    """
    good, bad = usable(df, rules)
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in good.items()])) if good else F.array().cast("array<string>")
    out = df.select(key, F.explode(broken).alias("violation"))
    if bad:
        kind = df.schema[key].dataType.simpleString()
        out = out.unionByName(df.sparkSession.createDataFrame([(None, f"skipped: {name}") for name in bad], f"{key} {kind}, violation string"))
    return out
