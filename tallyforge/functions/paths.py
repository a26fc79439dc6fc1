"""File-path expressions: one spelling per file, base names, suffix matches, test mirrors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(p: Column) -> Column:
    """``dir/name.ext``: no blanks around, ``/`` as separator, once, no ``./`` in front.

    Null stays null; a text of blanks, dots and slashes only gives null. Most
    paths are in this form already, so patterns run only on those that may not be.
    """
    odd = p.contains("\\") | p.contains("//") | p.startswith("./") | p.isin("", ".") | (F.length(F.btrim(p, F.lit(" \t\n\x0b\f\r"))) != F.length(p))
    q = F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), r"[\\/]+", "/")
    return F.when(~odd, p).otherwise(F.nullif(F.regexp_replace(q, r"^(\./)+|^\.$", ""), F.lit("")))


def base_name(p: Column) -> Column:
    """What follows the last ``/`` or ``\\``; the whole text where there is none."""
    return F.regexp_extract(p, r"([^/\\]*)$", 1)


def same_file(a: Column, b: Column) -> Column:
    """Equal, or one ends in the other at a ``/`` boundary (``src/a.ts`` and ``a.ts``).

    Use beside an equality on :func:`base_name`, which makes the join a hash join.
    """
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def stem(p: Column) -> Column:
    """The base name without its extensions for tests and for the language."""
    return F.regexp_replace(F.regexp_replace(base_name(p), r"\.[A-Za-z0-9]+$", ""), r"(?i)([._-](test|spec))$|^test_", "")


def is_test_path(p: Column) -> Column:
    return p.rlike(r"(?i)(^|/)(tests?|__tests__|spec)/") | p.rlike(r"(?i)[._-](test|spec)\.[a-z0-9]+$") | p.rlike(r"(^|/)test_[^/]*\.py$")


def ancestors(p: Column) -> Column:
    """All directories above a path, outermost first (``a/b/c.ts`` gives a, a/b)."""
    parts = F.split(p, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i))),
    ).otherwise(F.array().cast("array<string>"))


def endings(p: Column) -> Column:
    """A path and all that follows one of its ``/`` (``a/b/c.ts`` gives a/b/c.ts, b/c.ts, c.ts); no empty ones."""
    parts = F.split(p, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")), lambda x: x != "")
