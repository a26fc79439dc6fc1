"""The ledger as streams: tempo per window, repeated rows dropped, findings that close by themselves.

The reference point of every stream is its batch twin over the same files
(``availableNow`` reads what is there and ends). Event times without zone are
read as UTC, since watermarks need instants. State is bounded by the watermark:
windows and keys older than it are dropped, rows that come later are too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, under the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def instant(c: Column) -> Column:
    return c.cast("timestamp")


def tempo(rows: DataFrame, at: str, every: str = "7 days", late: str = "30 days", by: tuple[str, ...] = ()) -> DataFrame:
    """ST-06: rows per window and group, with a watermark; batch and stream alike."""
    timed = rows.withColumn("__at", instant(F.col(at)))
    if timed.isStreaming:
        timed = timed.withWatermark("__at", late)
    counted = timed.filter(F.col("__at").isNotNull()).groupBy(F.window("__at", every), *by).agg(F.count("*").alias("rows"))
    return counted.select(F.col("window.start").alias("start"), *by, "rows")


def once(rows: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """ST-02: each key once, the first that comes; in a stream a key is forgotten after ``late``."""
    if not rows.isStreaming:
        return rows.dropDuplicates(keys)
    return rows.withColumn("__at", instant(F.col(at))).withWatermark("__at", late).dropDuplicatesWithinWatermark(keys).drop("__at")


OPEN_SCHEMA = "project string, id string, status string, opened timestamp, changes bigint"


def current_states(transitions: DataFrame, forget: str = "72 hours", late: str = "1 day") -> DataFrame:
    """ST-01, ST-03, ST-07: the state of every (project, id) after each batch of transitions.

    ``transitions(project, id, status, at)``. Within a batch transitions apply in
    the order of ``at`` and, of equal ones, of status; a row is emitted per key and batch. A key is forgotten
    once the watermark is ``forget`` past its last transition, so time is that
    of the events and a replay gives the same states.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, opened, changes = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "status"], kind="stable")
        moves = rows["status"].fillna("active").replace("", "active")
        changes += int((moves != moves.shift(fill_value=status if status is not None else "\0")).sum())
        status = moves.iloc[-1]
        opened = opened if opened is not None else rows["at"].iloc[0].to_pydatetime()
        state.update((status, opened, changes))
        last = int(rows["at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"project": [key[0]], "id": [key[1]], "status": [status], "opened": [opened], "changes": [changes]})

    named = transitions.select("project", "id", "status", instant(F.col("at")).alias("at")).withWatermark("at", late)
    return named.groupBy("project", "id").applyInPandasWithState(step, OPEN_SCHEMA, "status string, opened timestamp, changes bigint", "update", GroupStateTimeout.EventTimeTimeout)


def sessions(rows: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """ST-05: activity sessions of a key that end after a gap."""
    timed = rows.withColumn("__at", instant(F.col(at)))
    if timed.isStreaming:
        timed = timed.withWatermark("__at", late)
    return timed.groupBy(F.session_window("__at", gap).alias("s"), key).agg(F.count("*").alias("steps")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "steps")


def correlated(pointers: DataFrame, results: DataFrame, within: str = "72 hours", late: str | None = None) -> DataFrame:
    """ST-04: pointers written before a run joined with the result that consumes them within a time; rows may be ``late``
    (by default as long), and each side waits for the other no longer."""
    p = pointers.select(F.col("run").alias("p_run"), "payload", instant(F.col("at")).alias("p_at")).withWatermark("p_at", late or within)
    r = results.select(F.col("run").alias("r_run"), "outcome", instant(F.col("at")).alias("r_at")).withWatermark("r_at", late or within)
    joined = p.join(r, (F.col("p_run") == F.col("r_run")) & F.expr(f"r_at BETWEEN p_at AND p_at + INTERVAL {within}"))
    return joined.select(F.col("p_run").alias("run"), "payload", "outcome")
