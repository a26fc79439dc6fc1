"""Facts out of report texts: findings, open issues, tables, deviations, verdicts.

All are expressions over a column that holds the whole text, so a table of
reports of any size is read in one pass where it lies, without Python. A text
is cut into lines once and the lines are folded with a small state.

Defined cases: a null text gives null; a text without the section asked for
gives an empty list; lines of any length are read whole; summaries are cut at
1,000 characters, as the ledger stores them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import file_references, finding_anchor, section

#: A bold word with a dash or colon opens a finding of that category; bold text alone opens one of the category before.
CATEGORY = r"\*\*(\w+)\s*(?:[—–:-]|\*\*\s*[—–:-])"
_STATE = "struct<category:string,open:string,done:array<struct<category:string,text:string>>>"


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _without(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return F.trim(c)


def _closed(state: Column) -> Column:
    """The finished items with the open one added, if it says anything."""
    one = F.array(F.struct(state["category"].alias("category"), F.trim(F.substring(F.trim(state["open"]), 1, 1000)).alias("text")))
    return F.when(F.trim(state["open"]) != "", F.concat(state["done"], one)).otherwise(state["done"])


def _fold(lines: Column, opens: Column | None, step) -> Column:  # noqa: ANN001
    start = F.struct(F.lit(None).cast("string").alias("category"), F.lit("").alias("open"), F.array().cast("array<struct<category:string,text:string>>").alias("done")).cast(_STATE)
    return F.aggregate(lines, start, step, _closed)


def _first_file(summary: Column) -> Column:
    return F.try_element_at(file_references(summary), F.lit(1))


def findings(c: Column) -> Column:
    """FN-S06: array of (category, summary, file, anchor) of the section ``Findings``.

    Three kinds of line change the state: one with a bold category ends the open
    finding and starts one, an item that starts in bold does so within the
    category, a blank line ends it. All others go on with the open finding.
    """

    def step(state: Column, line: Column) -> Column:
        word = F.lower(F.regexp_extract(line, CATEGORY, 1))
        item = _without(line, r"^\s*[-*](?!\*)\s*")
        head, blank, bold = word != "", F.trim(line) == "", item.rlike(r"^\*\*[^*]+\*\*")
        inside = state["category"].isNotNull()
        said = _without(line, r"^[-*\d.]*\s*\*\*\w+\s*[—–:-]?\s*", r"\*\*", r"^\s*:?\s*")
        text = F.when(head, said).when(~inside | blank, "").when(bold, _without(item, r"\*\*", r"^\s*[-:]\s*")).otherwise(F.concat_ws(" ", F.nullif(state["open"], F.lit("")), item))
        ends = head | (inside & (blank | bold))
        return F.struct(F.when(head, word).otherwise(state["category"]).alias("category"), text.alias("open"), F.when(ends, _closed(state)).otherwise(state["done"]).alias("done")).cast(_STATE)

    found = _fold(_lines(F.coalesce(section(c, "Findings"), F.lit(""))), None, step)
    out = F.transform(found, lambda f: F.struct(f["category"].alias("category"), f["text"].alias("summary"), _first_file(f["text"]).alias("file"), finding_anchor(f["text"]).alias("anchor")))
    return F.when(c.isNotNull(), out)


def open_issues(c: Column) -> Column:
    """FN-S07: array of (summary, file) of the section ``Open Issues``: items with a bold title and the lines that go on with them; none where it begins with None."""
    own = F.trim(F.coalesce(section(c, "Open Issues"), F.lit("")))

    def step(state: Column, line: Column) -> Column:
        starts = line.rlike(r"^[-*\d.]+\s+\*\*")
        goes_on = (state["open"] != "") & (F.trim(line) != "") & ~line.startswith("#")
        text = F.when(starts, F.regexp_replace(line, r"^[-*\d.]+\s+", "")).when(goes_on, F.concat_ws(" ", state["open"], F.trim(line))).otherwise(state["open"])
        return F.struct(state["category"].alias("category"), text.alias("open"), F.when(starts, _closed(state)).otherwise(state["done"]).alias("done")).cast(_STATE)

    found = _fold(F.when(own.startswith("None"), F.array().cast("array<string>")).otherwise(_lines(own)), None, step)
    plain = F.transform(found, lambda f: F.trim(F.regexp_replace(f["text"], r"\*\*", "")))
    return F.when(c.isNotNull(), F.transform(F.filter(plain, lambda s: s != ""), lambda s: F.struct(s.alias("summary"), _first_file(s).alias("file"))))


def rejections(c: Column) -> Column:
    """FN-S07: array of (id, summary), the assertions that failed before: rows of the table of the section on earlier findings."""
    own = F.regexp_extract(F.regexp_extract(c, r"(?s)## Previous Findings Resolution(.*?)(?:\n## [^#]|$)", 1), r"(?s)### Previously UNSATISFIED Assertions\n(.*?)(?:\n### |$)", 1)
    rows = F.regexp_extract_all(own, F.lit(r"(\|\s*A\d+\s*\|[^|]+\|)"), F.lit(1))
    return F.transform(rows, lambda r: F.struct(F.trim(F.split(r, r"\|")[1]).alias("id"), F.trim(F.split(r, r"\|")[2]).alias("summary")))


#: The states of an assertion in a compliance table, longer words first.
STATES = "UNSATISFIED|SATISFIED|DEVIATED|UNCOVERED"


def compliance(c: Column) -> Column:
    """FN-S08: array of (id, says, status, evidence), the rows of the table below ``Contract Compliance``; heads and rules are no rows."""
    own = F.regexp_extract(c, r"(?s)## Contract Compliance(.*?)(?:\n##|\n---|\n\n\n|$)", 1)
    rows = F.filter(_lines(own), lambda x: x.startswith("|") & ~x.contains("----") & ~x.contains("Says") & ~x.contains("Status"))
    cells = F.filter(F.transform(rows, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda y: F.trim(y)), lambda y: y != "")), lambda x: F.size(x) >= 3)
    status = lambda x: F.upper(F.regexp_extract(x, f"(?i)({STATES})", 1))
    return F.transform(cells, lambda x: F.struct(x[0].alias("id"), x[1].alias("says"), F.when(status(x[2]) != "", status(x[2])).otherwise("UNKNOWN").alias("status"), F.coalesce(F.try_element_at(x, F.lit(4)), F.lit("")).alias("evidence")))


def deviations(c: Column) -> Column:
    """FN-S08: array of (id, says, instead, reason, outcome), one for each heading ``### A1: ...``."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), c), r"\n(?=##)"), lambda b: b.rlike(r"^### A\d+: "))
    field = lambda b, k: F.nullif(F.trim(F.regexp_extract(b, rf"\*\*{k}:\*\*[ \t]*([^\n]+)", 1)), F.lit(""))
    one = lambda b: F.struct(F.regexp_extract(b, r"^### (A\d+)", 1).alias("id"), F.trim(F.regexp_extract(b, r"^### A\d+: ([^\n]*)", 1)).alias("says"), *[field(b, k).alias(k.lower()) for k in ("Instead", "Reason", "Outcome")])
    return F.transform(blocks, one)


def criteria_results(c: Column) -> Column:
    """AGG-41: (total, met, partial): items of the section ``AC Walkthrough`` (of the whole text without one) by the word of their result."""
    own = F.when(c.contains("## AC Walkthrough"), F.regexp_extract(c, r"(?s)## AC Walkthrough(.*?)(?:\n## |$)", 1)).otherwise(c)
    n = lambda word: F.regexp_count(own, F.lit(rf"(?m)^[ \t]*-[ \t]+.*\b{word}\b"))
    return F.struct((n("PASS") + n("FAIL") + n("PARTIAL") + n("UNVERIFIABLE")).alias("total"), n("PASS").alias("met"), n("PARTIAL").alias("partial"))


def headline(c: Column) -> Column:
    """The result that a report states: PASS, FAIL, or UNKNOWN."""
    said = F.upper(F.regexp_extract(c, r"(?i)\*\*Result:\*\*\s*(PASS|FAIL)", 1))
    return F.when(c.isNotNull(), F.when(said != "", said).otherwise("UNKNOWN"))


def verdict(c: Column) -> Column:
    """FN-S09: (result, headline, contradicted): a PASS is a FAIL where the report's own table has unsatisfied rows, whose ids contradict it."""
    said = headline(c)
    against = F.when(said == "PASS", F.transform(F.filter(compliance(c), lambda r: r["status"] == "UNSATISFIED"), lambda r: r["id"])).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(F.size(against) > 0, "FAIL").otherwise(said).alias("result"), said.alias("headline"), against.alias("contradicted"))


#: The kinds of work that a scope may name.
KINDS = ("feature", "fix", "chore", "milestone")


def scope_summary(c: Column) -> Column:
    """FN-S07: the first paragraph below ``Intent``; null without one."""
    return F.nullif(F.trim(F.regexp_extract(c, r"(?s)## Intent\n(.*?)(?:\n## |\n\n|$)", 1)), F.lit(""))


def scope_kind(c: Column) -> Column:
    """FN-S07: the kind that a scope names; null for none and for others."""
    kind = F.lower(F.trim(F.regexp_extract(c, r"\*\*Kind:\*\*[ \t]*([^\n]+)", 1)))
    return F.when(kind.isin(*KINDS), kind)


def vetoed(records: Column, claim: str) -> Column:
    """FN-S10: whether a record of the role ``verify`` has ``claim`` violated and found so deterministically (all four must hold).

    ``records`` is array<struct<role, verdicts: array<struct<claim_id, status, source>>>>.
    """
    broken = lambda v: (v["claim_id"] == claim) & (v["status"] == "violated") & (v["source"] == "deterministic")
    return F.coalesce(F.exists(records, lambda r: (r["role"] == "verify") & F.exists(r["verdicts"], lambda v: F.coalesce(broken(v), F.lit(False)))), F.lit(False))
