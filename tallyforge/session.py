"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tallyforge", master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local or submitted session with the settings every query here assumes.

    UTC keeps dates independent of the host; AQE re-plans joins and splits
    skewed partitions at run time; LAST_WIN gives map merges the semantics of
    overlaying objects.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    return b.config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; the caller's settings stay as they are.

    Where it is unset, a local session (one machine, tests) gets a folder of its
    own. On a cluster that would be a different folder on every machine, so
    there a missing setting is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        conf = "file://" + os.path.join(tempfile.gettempdir(), "tallyforge-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended, and its exit hook with it
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage at a
    table that outlives any executor. It goes when the driver ends, or earlier
    with :func:`release`."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    stored = spark.read.parquet(path)
    stored._tallyforge_path = path
    return stored


def release(stored: DataFrame) -> None:
    """Delete a table of :func:`materialise` that no later plan reads."""
    path = getattr(stored, "_tallyforge_path", None)
    if path:
        _remove(stored.sparkSession, path)
