"""Session, shared working folder and small-table helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_made: list[str] = []


def build_session(app: str = "sluicegate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; callers may override any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder the cluster names.

    Only a local-mode session without that setting gets a temporary folder, which is then
    set as the session's own; on a cluster a missing setting is an error, because a
    machine-local folder would not be visible to the other executors.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sluicegate-"))
        root = context.getCheckpointDir()
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def clear_work(spark: SparkSession) -> int:
    """Delete the folders this process got from ``work_dir``, and return their number.

    Frames that read them can't be used any more: call it when a job's results are written.
    """
    settings, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    number = len(_made)
    while _made:
        folder = jvm.org.apache.hadoop.fs.Path(_made.pop())
        folder.getFileSystem(settings).delete(folder, True)
    return number


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_own_session(*frames: DataFrame) -> list[DataFrame]:
    """The same rows in one new session, for jobs that observe what they write.

    A session that has made an observation once can't run fitted pipelines any more: what keeps its observations is
    part of it and doesn't serialise. Here it is part of a session that nothing else uses.
    """
    own = frames[0].sparkSession.newSession()
    copies = []
    for frame in frames:
        name = f"rows_{uuid.uuid4().hex}"
        frame.createGlobalTempView(name)
        copies.append(own.table(f"global_temp.{name}"))
        frame.sparkSession.catalog.dropGlobalTempView(name)
    return copies


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table as a local relation, so that the optimizer knows its size."""
    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema=schema)
