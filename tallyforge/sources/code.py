"""Source files read for their functions, classes, imports and exports.

Files are parsed where they lie, partition by partition (``mapInPandas``):
Python by the standard library's own parser, TypeScript, JavaScript and Go by
line patterns. A file that cannot be parsed gives one row with ``errors`` 1 and
empty lists; a language that is not known gives no row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSED = (
    "path string, language string, functions array<struct<name:string,line:int,async:boolean>>, classes array<struct<name:string,line:int,bases:array<string>>>, "
    "imports array<struct<module:string,names:array<string>,line:int>>, exports array<struct<name:string,kind:string,line:int>>, decorators array<struct<name:string,line:int>>, errors int"
)

#: Extensions by language (fixed values).
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go"}


def language_of(path: Column) -> Column:
    """FN-S21: the language of a path by its extension; null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


def parse_python(text: str) -> dict:
    out: dict = {"functions": [], "classes": [], "imports": [], "exports": [], "decorators": []}
    tree = ast.parse(text)
    listed = None
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append({"name": node.name, "line": node.lineno, "async": isinstance(node, ast.AsyncFunctionDef)})
        elif isinstance(node, ast.ClassDef):
            out["classes"].append({"name": node.name, "line": node.lineno, "bases": [b for b in map(_dotted, node.bases) if b]})
        elif isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "names": [], "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"module": "." * node.level + (node.module or ""), "names": [a.name for a in node.names], "line": node.lineno})
        for d in getattr(node, "decorator_list", []):
            out["decorators"].append({"name": _dotted(d), "line": d.lineno})
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            listed = {e.value for e in node.value.elts if isinstance(e, ast.Constant)}
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and (node.name in listed if listed is not None else not node.name.startswith("_")):
            out["exports"].append({"name": node.name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "line": node.lineno})
    return out


def _blanked(text: str) -> str:
    """The text with comments as blanks, its lines and the places in them kept."""
    keep = lambda m: m[0] if m[0][0] in "'\"`" else re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/", keep, text, flags=re.S)


def script_imports(text: str) -> list[dict]:
    """Imports of a script over any number of lines: statements, re-exports, ``import()`` and ``require()``."""
    found = []
    statement = r"(?:^|[;\n])[ \t]*(?:import|export)\b(?P<what>[^'\"`;]*?)\bfrom\s*['\"](?P<m>[^'\"\n]+)['\"]"
    plain = r"(?:^|[;\n])[ \t]*import\s*['\"](?P<m>[^'\"\n]+)['\"]|\b(?:require|import)\s*\(\s*['\"](?P<n>[^'\"\n]+)['\"]\s*\)"
    for m in re.finditer(statement, text):
        inner = re.search(r"\{([^}]*)\}", m["what"])
        names = [re.split(r"\s+as\s+", n.strip())[0].removeprefix("type ").strip() for n in inner[1].split(",")] if inner else []
        at = m.start() + len(m[0]) - len(m[0].lstrip(";\n \t"))
        found.append({"module": m["m"], "names": [n for n in names if n], "line": text.count("\n", 0, at) + 1})
    for m in re.finditer(plain, text):
        at = m.start() + len(m[0]) - len(m[0].lstrip(";\n \t"))
        found.append({"module": m["m"] or m["n"], "names": [], "line": text.count("\n", 0, at) + 1})
    return sorted(found, key=lambda x: x["line"])


def parse_script(text: str) -> dict:
    """TypeScript and JavaScript: declarations by lines, imports as statements; comments hold neither."""
    text = _blanked(text)
    out: dict = {"functions": [], "classes": [], "imports": script_imports(text), "exports": [], "decorators": []}
    for i, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*(export\s+)?(default\s+)?(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", line):
            out["functions"].append({"name": m[4], "line": i, "async": bool(m[3])})
            if m[1]:
                out["exports"].append({"name": m[4], "kind": "function", "line": i})
        elif m := re.match(r"\s*(export\s+)?(?:default\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>", line):
            out["functions"].append({"name": m[2], "line": i, "async": bool(m[3])})
            if m[1]:
                out["exports"].append({"name": m[2], "kind": "function", "line": i})
        elif m := re.match(r"\s*(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?", line):
            out["classes"].append({"name": m[2], "line": i, "bases": [m[3]] if m[3] else []})
            if m[1]:
                out["exports"].append({"name": m[2], "kind": "class", "line": i})
        elif m := re.match(r"\s*export\s+(?:declare\s+)?(interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)", line):
            out["exports"].append({"name": m[2], "kind": m[1], "line": i})
        if m := re.match(r"\s*@([A-Za-z_$][\w$.]*)", line):
            out["decorators"].append({"name": m[1], "line": i})
    return out


def parse_go(text: str) -> dict:
    """Go, by lines; an upper-case name is exported."""
    out: dict = {"functions": [], "classes": [], "imports": [], "exports": [], "decorators": []}
    block = False
    for i, line in enumerate(text.split("\n"), 1):
        if re.match(r"import\s*\(", line):
            block = True
        elif block and line.strip() == ")":
            block = False
        elif m := (re.match(r"\s*(?:[\w.]+\s+)?\"([^\"]+)\"", line) if block else re.match(r"import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", line)):
            out["imports"].append({"module": m[1], "names": [], "line": i})
        elif m := re.match(r"func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", line):
            out["functions"].append({"name": m[1], "line": i, "async": False})
            if m[1][0].isupper():
                out["exports"].append({"name": m[1], "kind": "function", "line": i})
        elif m := re.match(r"type\s+([A-Za-z_]\w*)\s+(struct|interface)", line):
            out["classes"].append({"name": m[1], "line": i, "bases": []})
            if m[1][0].isupper():
                out["exports"].append({"name": m[1], "kind": m[2], "line": i})
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """SRC-16 to SRC-18: one row per file of ``files(path, text)`` in a known language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"python": parse_python, "go": parse_go, "typescript": parse_script, "javascript": parse_script}
        for frame in frames:
            rows = []
            for path, text, language in zip(frame["path"], frame["text"], frame["language"], strict=True):
                try:
                    found = {**readers[language](text or ""), "errors": 0}
                except (SyntaxError, ValueError, RecursionError):
                    found = {"functions": [], "classes": [], "imports": [], "exports": [], "decorators": [], "errors": 1}
                rows.append({"path": path, "language": language, **found})
            yield pd.DataFrame(rows, columns=["path", "language", "functions", "classes", "imports", "exports", "decorators", "errors"])

    known = files.select("path", "text", language_of(F.col("path")).alias("language")).filter(F.col("language").isNotNull())
    return known.mapInPandas(run, PARSED)


def symbols(parsed: DataFrame) -> DataFrame:
    """SRC-20: (name, kind, path, line, exported) of functions and classes."""
    exported = F.transform("exports", lambda e: e["name"])
    one = lambda column, kind: parsed.select(F.explode(column).alias("s"), F.lit(kind).alias("kind"), "path", exported.alias("x")).select("s.name", "kind", "path", "s.line", F.array_contains("x", F.col("s.name")).alias("exported"))
    return one("functions", "function").unionByName(one("classes", "class"))


def changed_only(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files to parse again: those without a parsed row of the same path and time."""
    return files.join(parsed.select("path", "modified_at").distinct(), ["path", "modified_at"], "left_anti")
