"""Dependency names out of manifest texts, as expressions over a column that holds the file.

Each function gives an array of distinct names, sorted; a text that is not in
the format gives an empty array, a null text null. All are JVM-side: one pass
over a table of files reads any number of projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def _names(a: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))))


def _keys(text: Column, path: str) -> Column:
    """The keys of the object at a JSON path; values of any type."""
    return F.coalesce(F.json_object_keys(F.get_json_object(text, path)), F.array().cast("array<string>"))


def _when_given(text: Column, a: Column) -> Column:
    return F.when(text.isNotNull(), _names(F.coalesce(a, F.array().cast("array<string>"))))


def package_json(text: Column) -> Column:
    """SRC-06: names of all dependency kinds."""
    return _when_given(text, F.flatten(F.array(*[_keys(text, f"$.{k}") for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")])))


def package_lock(text: Column) -> Column:
    """SRC-07: names of lock files of versions 1 (``dependencies``) and 2, 3 (``packages``, by their last ``node_modules/``)."""
    modern = F.transform(F.filter(_keys(text, "$.packages"), lambda k: k.contains("node_modules/")), lambda k: F.regexp_replace(k, "^.*node_modules/", ""))
    return _when_given(text, F.concat(modern, _keys(text, "$.dependencies")))


def requirements_txt(text: Column) -> Column:
    """SRC-08: names in lower case, without versions, extras, markers, comments and options."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.lower(F.regexp_extract(F.trim(x), r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)))
    return _when_given(text, lines)


def _section(text: Column, header: str) -> Column:
    """The lines of a TOML table, up to the next header."""
    return F.regexp_extract(text, rf"(?s)(?:^|\n)\[{header}\][ \t]*\r?\n(.*?)(?:\n\[|\z)", 1)


def _toml_keys(text: Column, header: str) -> Column:
    return F.regexp_extract_all(_section(text, header), F.lit(r'(?m)^[ \t]*"?([A-Za-z0-9_.@/-]+)"?[ \t]*='), F.lit(1))


def pyproject(text: Column) -> Column:
    """SRC-09: PEP 621 lists (also optional ones) and poetry tables, without python itself."""
    listed = F.regexp_extract_all(F.concat_ws("\n", F.regexp_extract(text, r"(?s)(?:^|\n)dependencies[ \t]*=[ \t]*\[(.*?)\n?\]", 1), _section(text, r"project\.optional-dependencies")), F.lit(r"""["']([A-Za-z0-9][A-Za-z0-9._-]*)"""), F.lit(1))
    poetry = F.concat(_toml_keys(text, r"tool\.poetry\.dependencies"), _toml_keys(text, r"tool\.poetry\.dev-dependencies"), _toml_keys(text, r"tool\.poetry\.group\.dev\.dependencies"))
    return _when_given(text, F.filter(F.transform(F.concat(listed, poetry), F.lower), lambda x: x != "python"))


def pipfile(text: Column) -> Column:
    """SRC-10: the packages and dev-packages tables."""
    return _when_given(text, F.transform(F.concat(_toml_keys(text, "packages"), _toml_keys(text, "dev-packages")), F.lower))


def go_mod(text: Column) -> Column:
    """SRC-12: required modules in lower case, in blocks and single lines."""
    block = F.regexp_extract_all(F.concat_ws("\n", F.regexp_extract_all(text, F.lit(r"(?s)require[ \t]*\((.*?)\)"), F.lit(1))), F.lit(r"(?m)^[ \t]*([^\s/][^\s]*)[ \t]+v"), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(r"(?m)^require[ \t]+([^\s(]+)[ \t]+v"), F.lit(1))
    return _when_given(text, F.transform(F.concat(block, single), F.lower))


def cargo_toml(text: Column) -> Column:
    """SRC-13: dependencies and dev-dependencies."""
    return _when_given(text, F.concat(_toml_keys(text, "dependencies"), _toml_keys(text, "dev-dependencies")))


def gemfile(text: Column) -> Column:
    """SRC-14: gems."""
    return _when_given(text, F.regexp_extract_all(text, F.lit(r"""(?m)^[ \t]*gem[ \t]+["']([^"']+)["']"""), F.lit(1)))


def composer_json(text: Column) -> Column:
    """SRC-15: require and require-dev, without the platform (php, ext-*)."""
    found = F.concat(_keys(text, "$.require"), _keys(text, "$.require-dev"))
    return _when_given(text, F.filter(found, lambda x: (x != "php") & ~x.startswith("ext-")))


#: Base names and their readers; several files of one project are merged.
READERS = {
    "package.json": package_json,
    "package-lock.json": package_lock,
    "requirements.txt": requirements_txt,
    "pyproject.toml": pyproject,
    "Pipfile": pipfile,
    "go.mod": go_mod,
    "Cargo.toml": cargo_toml,
    "Gemfile": gemfile,
    "composer.json": composer_json,
}


def dependencies(files: DataFrame, project: str = "project", path: str = "path", text: str = "text") -> DataFrame:
    """SRC-11, SET-01: (project, manifest, name) of a table of files, each name once per project and kind of manifest."""
    base = F.regexp_extract(F.col(path), r"([^/\\]*)$", 1)
    names = F.lit(None).cast("array<string>")
    for name, reader in READERS.items():
        names = F.when(base == name, reader(F.col(text))).otherwise(names)
    return files.filter(base.isin(*READERS)).select(F.col(project), base.alias("manifest"), F.explode(names).alias("name")).distinct()
