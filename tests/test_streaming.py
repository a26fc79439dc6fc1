"""Each stream against its batch twin over the same files."""

import time

import pytest
from pyspark.sql import functions as F

from tallyforge.streaming import ledger as S


def drain(spark, df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events") / "rows")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    for week in range(5):  # written one after another, so the stream reads them in the order of time
        rows.filter(F.least(F.floor(F.dayofmonth("ts") / 7), F.lit(4)) == week).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return folder


def test_tempo(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    stream = S.tempo(S.read_stream(spark, events, batch, 1), "ts", by=("event_type",))
    got = drain(spark, stream, "tempo_rows", tmp_path, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.tempo(batch, "ts", by=("event_type",)).collect()))


def test_once(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    stream = S.once(S.read_stream(spark, events, batch, 1), ["user_id", "event_type"], "ts", "400 days")
    got = drain(spark, stream, "once_rows", tmp_path, "append")
    key = lambda df: sorted(map(tuple, df.select("user_id", "event_type").collect()))
    assert key(got) == key(S.once(batch, ["user_id", "event_type"], "ts"))


def test_sessions(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    got = drain(spark, S.sessions(S.read_stream(spark, events, batch, 1), "user_id", "ts", "2 hours"), "session_rows", tmp_path, "append")
    want = set(map(tuple, S.sessions(batch, "user_id", "ts", "2 hours").collect()))
    assert got.count() > 0.8 * len(want)
    assert set(map(tuple, got.collect())) <= want  # the last sessions are still open


def test_states(spark, tmp_path):
    rows = [("p", "F1", None, 1), ("p", "F1", "closed", 5), ("p", "F2", "active", 2), ("p", "F1", "active", 3), ("q", "F1", "promoted", 4)]
    df = spark.createDataFrame(rows, "project string, id string, status string, d int").select("project", "id", "status", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("d"), F.lit(0), F.lit(0), F.lit(0)).alias("at"))
    folder = str(tmp_path / "rows")
    df.coalesce(1).write.parquet(folder)
    got = drain(spark, S.current_states(S.read_stream(spark, folder, df)), "state_rows", tmp_path, "update")
    assert sorted((r.project, r.id, r.status, r.changes) for r in got.collect()) == [("p", "F1", "closed", 2), ("p", "F2", "active", 1), ("q", "F1", "promoted", 1)]


def test_pointers(spark, tmp_path):
    a = spark.createDataFrame([("r1", "x", "2024-01-01 00:00:00"), ("r2", "y", "2024-01-01 00:00:00"), ("r3", "z", "2024-01-01 00:00:00")], "run string, payload string, at string")
    b = spark.createDataFrame([("r1", "ok", "2024-01-01 01:00:00"), ("r2", "late", "2024-01-09 00:00:00")], "run string, outcome string, at string")
    for name, df in (("a", a), ("b", b)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    joined = S.correlated(S.read_stream(spark, str(tmp_path / "a"), a), S.read_stream(spark, str(tmp_path / "b"), b))
    assert [tuple(r) for r in drain(spark, joined, "pointer_rows", tmp_path, "append").collect()] == [("r1", "x", "ok")]
