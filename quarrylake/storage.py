"""Where lineage is cut: reliable checkpoints in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quarrylake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they see the driver's folder; elsewhere it has to be given to them (--py-files)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least: a file of one row group would be one task. Larger inputs stay as read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


ROWS, TASKS = 50_000, 200  # rows of a task; with more tasks than TASKS Spark's shuffle writer keeps what it deals out in memory


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df of a file's rows over tasks by a key, one for ROWS rows and one a core at least. A file is cut at its row groups only, so one
    of a single group would be one task, however large it is and whatever number of partitions it shows."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, min(TASKS, -(-df.count() // ROWS)))
    return df.repartition(n, key)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join by shuffle: sizes are guessed from compressed files, so a side of millions of rows may pass for small enough
    to go through the driver to all tasks."""
    return df.hint("merge")
