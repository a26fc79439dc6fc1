"""Queries that run as streams over whole tables: all files there are, batch by batch, to their end.

Each starts a Structured Streaming query with its own checkpoint, lets it read
what is there (``availableNow``), and gives what it wrote. Results are written
by the executors to the shared folder, not held by the driver. What must come
out is that of the batch twin, so each has SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.views import CTE
from tallyforge.registry import Registry, table
from tallyforge.session import checkpoint_dir
from tallyforge.streaming import ledger as S

R = Registry()

#: How late a row may be in a replay of all history, whose files come in any order.
HISTORY = "4000 days"


def replayed(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """The result of a stream that has read all there is.

    In ``complete`` mode the last batch holds it; else all batches together, of
    which with ``key`` the latest row of each key counts.
    """
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/rows/{'all' if mode == 'complete' else n}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    rows = spark.read.parquet(f"{at}/rows/*")
    if key is None:
        return rows.drop("__batch")
    own = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*own), "__batch").alias("x")).select(*key, *[F.col(f"x.{c}") for c in own])


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    like = table(spark, sf_dir, name)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return S.read_stream(spark, f"{sf_dir}/{name}.parquet", like)
    return spark.readStream.schema(like.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream reads folders


@R.query("stream_tempo", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS rows FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-06: events per week and kind, counted as they come."""
    out = replayed(S.tempo(_stream(spark, sf_dir, "events"), "ts", late=HISTORY, by=("event_type",)), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.query("stream_once", "SELECT DISTINCT user_id, event_type FROM events WHERE ts IS NOT NULL")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-02: the first event of each kind of a user; repeats are dropped by their key."""
    return replayed(S.once(_stream(spark, sf_dir, "events").filter(F.col("ts").isNotNull()), ["user_id", "event_type"], "ts", HISTORY).select("user_id", "event_type"), "append")


@R.query(
    "stream_sessions",
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS steps FROM s GROUP BY user_id, nth
""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-05: activity of a user that ends after two hours without an event."""
    rows = _stream(spark, sf_dir, "events").filter(F.col("ts").isNotNull() & F.col("user_id").isNotNull())
    out = replayed(S.sessions(rows, "user_id", "ts", "2 hours", HISTORY), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "steps")


@R.query(
    "stream_states",
    CTE
    + """, r AS (SELECT project, id, coalesce(nullif(status, ''), 'active') AS s, found_at + to_microseconds(finding_id::BIGINT) AS ts FROM (SELECT DISTINCT project, id, status, found_at, finding_id FROM findings WHERE project IS NOT NULL AND id IS NOT NULL AND found_at IS NOT NULL)),
o AS (SELECT *, lag(s) OVER (PARTITION BY project, id ORDER BY ts, s) AS earlier FROM r)
SELECT project, id, arg_max(s, (ts, s)) AS status, min(ts) AS opened, count(*) FILTER (earlier IS DISTINCT FROM s) AS changes FROM o GROUP BY project, id
""",
)
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-01, ST-07: the state of every finding id after all its transitions, which a state per key holds."""
    rows = _stream(spark, sf_dir, "findings").filter(F.col("project").isNotNull() & F.col("id").isNotNull() & F.col("found_at").isNotNull())
    at = F.timestamp_micros(F.unix_micros(S.instant(F.col("found_at"))) + F.col("finding_id")).alias("at")
    moves = rows.select("project", "id", F.coalesce(F.nullif("status", F.lit("")), F.lit("active")).alias("status"), at)  # a repeated move changes nothing
    out = replayed(S.current_states(moves, forget="96000 hours", late=HISTORY), "update", ["project", "id"])
    return out.select("project", "id", "status", F.col("opened").cast("timestamp_ntz").alias("opened"), "changes")


@R.query(
    "stream_pointers",
    """
WITH p AS (SELECT DISTINCT project || '/' || slug AS run, min(sealed_at) AS at FROM contracts WHERE project IS NOT NULL AND slug IS NOT NULL AND sealed_at IS NOT NULL GROUP BY ALL),
r AS (SELECT project || '/' || slug AS run, min(ingested_at) AS at FROM entries WHERE project IS NOT NULL AND slug IS NOT NULL AND ingested_at IS NOT NULL GROUP BY ALL)
SELECT run FROM p JOIN r USING (run) WHERE r.at BETWEEN p.at AND p.at + INTERVAL 72 HOUR
""",
)
def stream_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-03, ST-04: a pointer written when a work item's contract is sealed, consumed once by its first entry within 72 hours; later ones are evicted."""
    at = f"{checkpoint_dir(spark)}/pointers-{uuid.uuid4().hex}"
    sides = {}
    for name, source, when, extra in (("pointers", "contracts", "sealed_at", "payload"), ("results", "entries", "ingested_at", "outcome")):
        rows = table(spark, sf_dir, source).filter(F.col("project").isNotNull() & F.col("slug").isNotNull() & F.col(when).isNotNull())
        first = rows.groupBy(F.concat_ws("/", "project", "slug").alias("run")).agg(F.min(when).alias("at")).withColumn(extra, F.lit(source))
        first.write.parquet(f"{at}/{name}")
        sides[name] = S.read_stream(spark, f"{at}/{name}", first, 1_000)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return replayed(S.correlated(sides["pointers"], sides["results"], "72 hours", HISTORY), "append").select("run")
