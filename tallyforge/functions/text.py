"""Text expressions: naming styles, references, markdown, tables, dates. All JVM-side, null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def naming_style(c: Column) -> Column:
    """FN-S01: SCREAMING_SNAKE_CASE, snake_case, kebab-case, PascalCase, camelCase, lowercase or unknown.

    A name is cut into words at its separators, then separator and case decide.
    Underscores around it do not count; names of one character, with both
    separators, an empty word or other characters are unknown.
    """
    core = F.btrim(c, F.lit("_"))
    words, letters = F.split(core, "[-_]"), F.regexp_replace(core, "[^A-Za-z]", "")
    known = (F.length(c) > 1) & core.rlike("^[A-Za-z][A-Za-z0-9_-]*$") & ~F.exists(words, lambda w: w == "") & ~(core.contains("-") & core.contains("_"))
    big = core.rlike("^[A-Z]")
    upper, lower = letters == F.upper(letters), letters == F.lower(letters)
    return (
        F.when(c.isNull(), None)
        .when(~known, "unknown")
        .when(big & upper & ~core.contains("-"), "SCREAMING_SNAKE_CASE")
        .when(F.size(words) == 1, F.when(big, "PascalCase").when(lower, "lowercase").otherwise("camelCase"))
        .when(lower, F.when(core.contains("-"), "kebab-case").otherwise("snake_case"))
        .otherwise("unknown")
    )


#: Styles that a vote counts, in the order that decides between equals (fixed values); single lower-case words fit several and count for none.
VOTED = ("snake_case", "camelCase", "PascalCase", "kebab-case", "SCREAMING_SNAKE_CASE")
#: Words of languages, and names that a runtime demands, which nobody chose.
KEYWORDS = {
    "python": ("False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield"),
    "typescript": ("break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "function", "if", "import", "in", "instanceof", "interface", "let", "new", "null", "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with", "yield", "async", "await", "type", "namespace"),
    "go": ("break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var"),
}
DEMANDED = ("constructor", "toString", "valueOf", "hasOwnProperty", "toJSON")


def import_kind(c: Column, prefix: str = "") -> Column:
    """FN-S02: how an import names its module: relative, alias (``@/``, ``~/``, ``#``), builtin (``node:``), scoped, own package, external."""
    own = F.lit(False) if not prefix else (c == prefix) | c.startswith(f"{prefix}/") | c.startswith(f"{prefix}.")
    return (
        F.when(c.startswith("."), "relative")
        .when(c.startswith("@/") | c.startswith("~/") | c.startswith("#"), "alias")
        .when(c.startswith("node:"), "builtin")
        .when(own, "own")
        .when(c.startswith("@"), "scoped")
        .when(c.isNotNull(), "external")
    )


def truncate_words(c: Column, most: int, mark: str = "...") -> Column:
    """FN-S04: cut at the last blank among the first ``most + 1`` characters, else after ``most``, with ``mark`` behind what was cut."""
    whole_words = F.regexp_extract(F.substring(c, 1, most + 1), "^(?s)(.+) ", 1)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.when(whole_words != "", whole_words).otherwise(F.substring(c, 1, most)), F.lit(mark)))


#: Fixed value: how a text names a file, with or without a directory, by its extension.
FILE_REFERENCE = r"((?:[\w./-]+/)?[\w.-]+\.(?:tsx|ts|jsx|json|js|yaml|yml|md))"


def file_references(c: Column) -> Column:
    """FN-S05: distinct files that a text names, in order, line numbers left out; what follows a URL's ``//`` is none."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(FILE_REFERENCE), F.lit(1)), lambda x: ~x.startswith("//")))


#: Where a line declares a criterion: as a heading, a list item, a label at its start, or in bold.
CRITERION_FORMS = (r"(?im)^[ \t]*#{1,6}[ \t]+\*{0,2}[ \t]*(AC\d+)\b", r"(?im)^[ \t]*[-*][ \t]+\*{0,2}[ \t]*(AC\d+)\b", r"(?im)^[ \t]*(AC\d+)[ \t]*[:.)\]]", r"(?i)\*\*[ \t]*(AC\d+)\b")
#: What makes a text without a declared criterion look as if it had some.
CRITERION_SIGNS = r"(?im)^[ \t]*#{1,6}[ \t]+Acceptance[ \t]+Criteria|\bAC\d+\b"


def criterion_ids(c: Column) -> Column:
    """FN-S16: distinct acceptance criteria that a text declares in one of four forms, in upper case, sorted as text."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(f), F.lit(1)) for f in CRITERION_FORMS])
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def criteria_unclear(c: Column) -> Column:
    """FN-S16: whether a text mentions criteria but declares none."""
    return (F.size(criterion_ids(c)) == 0) & c.rlike(CRITERION_SIGNS)


def clean_markdown(c: Column) -> Column:
    """FN-S14: images and HTML tags taken out, several blank lines made one; links, code and emphasis stay."""
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"<[^>]+>", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        c = F.regexp_replace(c, pattern, by)
    return c


#: Which headings of a README say what (SRC-30).
README_HEADINGS = {
    "description": ("about", "about this project", "overview", "introduction", "what is this", "description"),
    "architecture": ("architecture", "design", "how it works", "project structure", "structure", "technical overview"),
    "setup": ("installation", "install", "getting started", "setup", "quick start", "usage"),
}


def readme_sections(c: Column) -> Column:
    """SRC-30: map from description, architecture and setup to the cleaned text below the first heading of that kind.

    Sections end at the next heading of one or two marks. Without a described
    section the first paragraph below the title is the description.
    """
    split = F.split(F.concat(F.lit("\n"), c), r"\n(?=#{1,2}[ \t]+\S)")
    parts = F.slice(split, F.lit(2), F.size(split))
    cut = F.transform(parts, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^#{1,2}[ \t]+([^\n]*?)[ \t]*(?:\n|$)", 1)).alias("head"), clean_markdown(F.regexp_replace(x, r"^[^\n]*\n?", "")).alias("body")))
    entries = []

    def first_of(names: tuple[str, ...]) -> Column:
        return F.try_element_at(F.filter(cut, lambda x: x["head"].isin(*names) & (x["body"] != "")), F.lit(1))["body"]

    for kind, names in README_HEADINGS.items():
        text = first_of(names)
        if kind == "description":
            opening = clean_markdown(first_paragraph(c))
            text = F.coalesce(text, F.when(opening != "", opening))
        entries.append(F.struct(F.lit(kind).alias("k"), text.alias("v")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def first_paragraph(c: Column) -> Column:
    """FN-S14: the lines below the title up to the next blank line or heading; empty where there are none."""
    body = F.regexp_replace(c, r"^(?:[ \t]*\n)*(?:#[ \t]+[^\n]*\n?)?(?:[ \t]*\n)*", "")
    return F.regexp_replace(F.regexp_extract(body, r"^(?!#{1,2}[ \t])((?s).*?)(?:\n[ \t]*(?:\n|$)|\n#{1,2}[ \t]|\s*$)", 1), r"^\s+|\s+$", "")


def version_at_least(c: Column, major: int, minor: int) -> Column:
    """FN-S17: whether a version's major.minor reaches a bound; parts that are no numbers count as 0, no version reaches none."""
    a, b = F.regexp_extract(c, r"^v?([0-9]+)", 1), F.regexp_extract(c, r"^v?[0-9]*\.([0-9]+)", 1)
    a, b = (F.coalesce(F.nullif(x, F.lit("")).try_cast("int"), F.lit(0)) for x in (a, b))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", False).otherwise((a > major) | ((a == major) & (b >= minor)))


def relative_age(seconds: Column) -> Column:
    """FN-D01: an age in whole hours below a day (``<1h`` in the first), days below thirty, else weeks; ages below zero count as zero."""
    hours = F.floor(F.greatest(seconds, F.lit(0)) / 3_600)
    days = F.floor(hours / 24)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(seconds.isNull(), None).when(hours < 1, "<1h").when(hours < 24, text(hours, "h")).when(days < 30, text(days, "d")).otherwise(text(F.floor(days / 7), "w"))


def confidence_band(c: Column) -> Column:
    """FN-S12: high from 0.9, moderate from 0.7, low from 0.5, else uncertain."""
    return F.when(c >= 0.9, "high").when(c >= 0.7, "moderate").when(c >= 0.5, "low").when(c.isNotNull(), "uncertain")


#: The programs and sub-commands by which a command's runner is known.
RUNNERS = (("vitest", r"\bvitest\b"), ("jest", r"\bjest\b"), ("pytest", r"\bpytest\b"), ("go", r"\bgo test\b"), ("cargo", r"\bcargo (?:test|nextest)\b"), ("rspec", r"\brspec\b"), ("dotnet", r"\bdotnet test\b"), ("junit", r"\b(?:mvn|gradlew?)\b"))


def test_runner(c: Column) -> Column:
    """FN-S26: the test runner that a command starts; null for none known."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(RUNNERS):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def _figure(c: Column, pattern: str) -> Column:
    """The first number a pattern catches, 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("int"), F.lit(0))


def _total(c: Column, pattern: str) -> Column:
    """All numbers a pattern catches, added up."""
    return F.aggregate(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(0), lambda n, x: n + F.coalesce(x.try_cast("int"), F.lit(0)))


def _counts(known: Column, passed: Column, failed: Column, skipped: Column) -> Column:
    return F.when(known, F.struct(F.greatest(passed, F.lit(0)).alias("passed"), failed.alias("failed"), F.greatest(skipped, F.lit(0)).alias("skipped")))


#: The summary that each runner prints, and the figures in it.
SUMMARY_LINES = {"vitest": r"(?m)^\s*Tests\s+\d.*$", "jest": r"(?m)^Tests:\s+.*$", "pytest": r"(?m)^=+ .*\b\d+ (?:passed|failed|error|skipped).* in [\d.]+s.*=+$"}
GO_EVENT = r'"Action":"{0}"[^}}]*"Test":|"Test":[^}}]*"Action":"{0}"'
CARGO_RESULT = r"test result:[^\n]*?\d+ passed;\s*\d+ failed;[^\n]*?\d+ ignored"
RSPEC_SUMMARY = r"(?m)^\s*(\d+) examples?, (\d+) failures?(?:, (\d+) pending)?"
DOTNET_SUMMARY, DOTNET_COUNTERS = r"Failed:\s*(\d+),\s*Passed:\s*(\d+),\s*Skipped:\s*(\d+)", r"<Counters\b[^>]*>"
JUNIT_SUITE = r"<testsuite\s[^>]*>"


def test_counts(c: Column, runner: Column) -> Column:
    """AGG-52, UDX-03: (passed, failed, skipped) from the output of a known runner, in that runner's format only.

    Null without a runner, or where its summary is not in the output: no count is guessed.
    """
    lines = {k: F.regexp_extract(c, p, 0) for k, p in SUMMARY_LINES.items()}
    words = lambda x, more=F.lit(0): _counts(x != "", _figure(x, r"(\d+) passed"), _figure(x, r"(\d+) failed") + more, _figure(x, r"(\d+) skipped"))
    field = lambda k: _figure(c, rf'"{k}":\s*(\d+)')
    report = _counts(c.contains('"numTotalTests":') & c.contains('"testResults":'), field("numPassedTests"), field("numFailedTests"), field("numPendingTests") + field("numTodoTests"))
    events = lambda a: F.regexp_count(c, F.lit(GO_EVENT.format(a)))
    results = F.array_join(F.regexp_extract_all(c, F.lit(f"({CARGO_RESULT})"), F.lit(1)), "\n")
    of = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, RSPEC_SUMMARY, i), F.lit("")).try_cast("int"), F.lit(0))
    suites = F.array_join(F.filter(F.regexp_extract_all(c, F.lit(JUNIT_SUITE), F.lit(0)), lambda t: t.rlike(r"\btests=")), "\n")
    xml = lambda k: _total(suites, rf'\b{k}="(\d+)"')
    got = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, DOTNET_SUMMARY, i), F.lit("")).try_cast("int"), F.lit(0))
    tag = F.regexp_extract(c, DOTNET_COUNTERS, 0)
    attr = lambda k: _figure(tag, rf'\b{k}="(\d+)"')
    parsers = {
        "vitest": F.coalesce(report, words(lines["vitest"])),
        "jest": words(lines["jest"]),
        "pytest": words(lines["pytest"], _figure(lines["pytest"], r"(\d+) errors?")),
        "go": _counts(c.contains('"Action":') & c.contains('"Test":'), events("pass"), events("fail"), events("skip")),
        "cargo": _counts(results != "", *[_total(results, rf"(\d+) {w}") for w in ("passed", "failed", "ignored")]),
        "rspec": _counts(c.rlike(RSPEC_SUMMARY), of(1) - of(2) - of(3), of(2), of(3)),
        "junit": _counts(suites != "", xml("tests") - xml("failures") - xml("errors") - xml("skipped"), xml("failures") + xml("errors"), xml("skipped")),
        "dotnet": F.coalesce(_counts(c.rlike(DOTNET_SUMMARY), got(2), got(1), got(3)), _counts(tag != "", attr("passed"), attr("failed"), attr("total") - attr("passed") - attr("failed"))),
    }
    out = F.lit(None)
    for name, counts in parsers.items():
        out = F.when(runner == name, counts).otherwise(out)
    return out


def capture_verdict(exit_code: Column, counts: Column) -> Column:
    """FN-S11: FAIL with a failure or without a clean exit (killed runs have none), PASS with a passed test, else ABSTAIN."""
    failed = F.coalesce(counts.getField("failed") > 0, F.lit(False)) | ~F.coalesce(exit_code == 0, F.lit(False))
    return F.when(failed, "FAIL").when(F.coalesce(counts.getField("passed") > 0, F.lit(False)), "PASS").otherwise("ABSTAIN")


def seal(*parts: Column) -> Column:
    """FN-S18: SHA-256 over the parts with a separator that none of them holds; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def seal_state(now: Column, stored: Column) -> Column:
    """FN-S19: INTACT, TAMPERED, or UNVERIFIABLE without a stored seal."""
    return F.when(stored.isNull() | (stored == ""), "UNVERIFIABLE").when(now == stored, "INTACT").otherwise("TAMPERED")


def valid_slug(c: Column) -> Column:
    """FN-S23: lower case words and numbers joined by single hyphens, 64 characters at most."""
    return c.rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & (F.length(c) <= 64)


_QUOTED = r"'[^']*(?:'|$)|\"[^\"]*(?:\"|$)"


def shell_refused(c: Column) -> Column:
    """FN-S22: the first construct outside of quotes that needs a shell (``|``, ``&``, ``;``, ``<``, ``>``, a back quote, ``$(``, ``*``, ``?``, ``(`` or ``)``); null for none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, _QUOTED, "''"), r"([|&;<>`*?()]|\$\()", 1), F.lit(""))


def shell_tokens(c: Column) -> Column:
    """FN-S22: the words of a command with quotes and escapes undone: nothing is special in single quotes, a backslash
    escapes itself and the quote in double ones and any character outside."""
    piece = r"'[^']*(?:'|$)|\"(?:\\[\"\\]|[^\"])*(?:\"|$)|\\.|[^\s'\"\\]+|\\"
    words = F.regexp_extract_all(c, F.lit(rf"((?:{piece})+)"), F.lit(1))

    def plain(x: Column) -> Column:
        single = F.regexp_extract(x, "^'([^']*)", 1)
        double = F.regexp_replace(F.regexp_extract(x, '(?s)^"(.*?)"?$', 1), r"\\([\"\\])", "$1")
        return F.when(x.startswith("'"), single).when(x.startswith('"'), double).otherwise(F.regexp_replace(x, r"(?s)\\(.)", "$1"))

    return F.transform(words, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(f"({piece})"), F.lit(1)), plain), ""))


def branch_of_merge(c: Column) -> Column:
    """FN-S15: the branch that a merge subject names; null for other subjects."""
    hub = F.regexp_extract(c, r"^Merge pull request #[0-9]+ from [^/\s]+/(\S+)", 1)
    plain = F.regexp_extract(c, r"^Merge (?:remote-tracking )?branch '([^']+)'", 1)
    return F.nullif(F.when(hub != "", hub).otherwise(F.regexp_replace(plain, "^origin/", "")), F.lit(""))


def package_parts(c: Column) -> Column:
    """FN-S20: struct of a package's scope (null without one) and bare name."""
    return F.struct(F.nullif(F.regexp_extract(c, "^@([^/]+)/", 1), F.lit("")).alias("scope"), F.regexp_replace(c, "^@[^/]+/", "").alias("name"))


def finding_anchor(c: Column) -> Column:
    """FN-S06: the first code span of six characters or more with a letter that is no ``file.ext:line``; null without one."""
    spans = F.regexp_extract_all(c, F.lit("`([^`]+)`"), F.lit(1))
    return F.try_element_at(F.filter(spans, lambda b: (F.length(b) > 5) & b.rlike("[A-Za-z]") & ~b.rlike(r"^\S+\.\w+:\d+")), F.lit(1))


def section(c: Column, heading: str) -> Column:
    """The lines below ``## heading`` up to the next heading of two marks; null without such a section."""
    found = F.concat(F.lit("\n"), c)
    return F.when(found.contains(f"\n## {heading}\n"), F.regexp_extract(found, rf"(?s)\n## {heading}\n(.*?)(?:\n## |$)", 1))