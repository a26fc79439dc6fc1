"""Session transcripts: what an agent read, and what it took to reach the first right edit.

``lines(session, line_no, type, request, at, model, input_tokens, output_tokens,
cache_tokens, uses)`` are the lines of transcripts, ``uses`` an array of (name,
file). Nothing is windowed over a session: the first edit is a minimum, and what
came before it is counted by an aggregate against that minimum, so a session of
any length is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numeric import ratio

#: The tools that change a file.
EDITS = ("Write", "Edit", "MultiEdit", "NotebookEdit")


def localisation(lines: DataFrame, relevant: DataFrame) -> DataFrame:
    """AGG-34, WIN-07: one row per session, against ``relevant(session, file)``.

    A file is relevant if it is one of the session's, or ends in one at a ``/``.
    Tokens count once per request. The three figures up to the first right edit
    are null where there is none.
    """
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    spoken = lines.filter(F.col("type") == "assistant")
    uses = spoken.select("session", "line_no", F.posexplode("uses").alias("i", "u")).select("session", "line_no", "i", F.col("u.name").alias("tool"), F.regexp_replace("u.file", r"\\", "/").alias("file")).filter(F.col("file") != "")
    r = relevant.select(F.col("session").alias("r_s"), F.regexp_replace("file", r"\\", "/").alias("r_f")).distinct().withColumn("r_b", base(F.col("r_f")))
    hit = uses.join(r, (F.col("session") == F.col("r_s")) & (base(F.col("file")) == F.col("r_b")) & ((F.col("file") == F.col("r_f")) | F.col("file").endswith(F.concat(F.lit("/"), "r_f"))), "left_semi").select("session", "line_no", "i").withColumn("right", F.lit(True))
    marked = uses.join(hit, ["session", "line_no", "i"], "left")
    reads = marked.filter(F.col("tool") == "Read").groupBy("session").agg(F.count("*").alias("reads"), F.count_distinct("file").alias("distinct_reads"), F.count_if(F.col("right").isNull()).alias("wrong_reads"))
    edit = marked.filter(F.col("tool").isin(*EDITS) & F.col("right")).groupBy("session").agg(F.min("line_no").alias("edit_line"))
    # a request's usage stands on each of its lines: the first counts
    usage = spoken.filter((F.col("request") != "") & F.col("input_tokens").isNotNull()).groupBy("session", "request").agg(F.min_by(F.struct("line_no", "input_tokens", "output_tokens"), "line_no").alias("u"))
    spent = usage.join(edit, "session").filter(F.col("u.line_no") <= F.col("edit_line")).groupBy("session").agg(F.sum(F.coalesce("u.input_tokens", F.lit(0)) + F.coalesce("u.output_tokens", F.lit(0))).alias("tokens_to_edit"))
    turns = spoken.join(edit, "session").filter(F.col("line_no") <= F.col("edit_line")).groupBy("session").agg(F.count("*").alias("turns_to_edit"), F.max(F.when(F.col("line_no") == F.col("edit_line"), F.col("at"))).alias("edit_at"))
    whole = lines.groupBy("session").agg(F.min_by("at", F.when(F.col("at").isNotNull(), F.col("line_no"))).alias("began"), F.count_if(F.col("type") == "assistant").alias("turns"))
    out = whole.join(reads, "session", "left").join(edit, "session", "left").join(spent, "session", "left").join(turns, "session", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    again = n("reads") - n("distinct_reads")
    return out.select(
        "session",
        "turns",
        n("reads").alias("reads"),
        n("distinct_reads").alias("distinct_reads"),
        n("wrong_reads").alias("wrong_reads"),
        again.alias("redundant_reads"),
        F.coalesce(ratio(again, n("reads")), F.lit(0.0)).alias("redundant_ratio"),
        F.when(F.col("edit_line").isNotNull(), n("tokens_to_edit")).alias("tokens_to_edit"),
        "turns_to_edit",
        F.when(F.col("edit_line").isNotNull(), F.unix_millis("edit_at") - F.unix_millis("began")).alias("ms_to_edit"),
    )


def role_sessions(sessions: DataFrame) -> DataFrame:
    """AGG-37, WIN-08: ``sessions(item, place, role, model, counted)`` with a label each: the role, its number from the second
    session of that role on, and the model where the item's sessions do not all have counts and one model.

    The number of earlier sessions of a role comes from a running count in two
    levels; items are a few sessions, but a role of one item may be long.
    """
    from tallyforge.operators.joins import numbered

    nth = numbered(sessions, ["item", "role"], ["place"], F.floor(F.col("place") / 10_000))
    same = sessions.groupBy(F.col("item").alias("s_i")).agg(((F.count_distinct("model") == 1) & F.bool_and("counted")).alias("same"))
    name = F.concat(F.col("role"), F.when(F.col("nth") > 1, F.concat(F.lit(" "), F.col("nth").cast("string"))).otherwise(""))
    return nth.join(same, F.col("item") == F.col("s_i")).select("item", "place", F.when(F.col("same"), name).otherwise(F.concat(name, F.lit(" · "), F.col("model"))).alias("label"))


def churn(diffs: DataFrame) -> DataFrame:
    """SRC-22, SRC-23: (item, file, added, deleted) of ``diffs(item, text)``, texts of lines ``added<TAB>deleted<TAB>path``.

    A binary file's ``-`` is 0, a path may hold tabs, shorter lines are skipped.
    """
    parts = F.split("line", "\t")
    number = lambda i: F.coalesce(parts[i].try_cast("bigint"), F.lit(0).cast("bigint"))
    lines = diffs.select("item", F.explode(F.split("text", "\n")).alias("line")).filter((F.trim("line") != "") & (F.size(F.split("line", "\t")) >= 3))
    return lines.select("item", F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "\t").alias("file"), number(0).alias("added"), number(1).alias("deleted")).filter(F.col("file") != "")


#: Fixed value: a statement that makes or removes a table, with or without a schema and quotes.
TABLE_STATEMENT = r'(?i)\b((?:CREATE|DROP)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?(?:"\w+"|\w+)(?:\s*\.\s*(?:"\w+"|\w+))?)'


def surviving_tables(files: DataFrame) -> DataFrame:
    """AGG-43: (project, name) of the tables whose last statement, by path and place, is a CREATE; ``files(project, path, text)``."""
    said = files.select("project", "path", F.posexplode(F.regexp_extract_all("text", F.lit(TABLE_STATEMENT), F.lit(1))).alias("i", "s"))
    name = F.lower(F.regexp_extract("s", r'"?(\w+)"?$', 1))
    last = said.select("project", name.alias("name"), F.struct("path", "i").alias("at"), F.upper(F.substring("s", 1, 6)).alias("action")).groupBy("project", "name").agg(F.max_by("action", "at").alias("action"))
    return last.filter(F.col("action") == "CREATE").select("project", "name")


def best_schema(files: DataFrame) -> DataFrame:
    """AGG-44, AGG-55: per project the folder whose schema files declare most models; ``files(project, path, text)``.

    Models of all files in a folder count together; of equals the first path is taken.
    """
    own = files.filter(F.col("path").endswith(".prisma")).select("project", F.regexp_extract("path", "^(.*/|)[^/]*$", 1).alias("folder"), F.regexp_count("text", F.lit(r"(?m)^[ \t]*model[ \t]+\w+[ \t]*\{")).alias("n"))
    per = own.groupBy("project", "folder").agg(F.sum("n").alias("models"))
    best = per.groupBy("project").agg(F.max("models").alias("models"), F.min_by("folder", F.struct(-F.col("models"), F.col("folder"))).alias("folder"))
    return best.select("project", "folder", "models")
