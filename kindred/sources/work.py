"""Intermediate tables in the folder that the driver and all executors share.

A table written there cuts the lineage: what follows reads it again and depends on no executor's
disk. Tables lie in the application's own part of the folder. ``discard`` removes them all once the
results are stored elsewhere, ``settle`` those of one finished step.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the checkpoint folder that was set on its context.

    Where both are unset, a local session gets a temporary folder; on a cluster that's an error,
    since executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    have = context._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kindred-"))
        have = context._jsc.sc().getCheckpointDir()
    return have.get().rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in the application's own part of it."""
    path = f"{shared_dir(spark)}/kindred/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def discard(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder, once its results are stored elsewhere."""
    remove(spark, f"{shared_dir(spark)}/kindred/{spark.sparkContext.applicationId}")


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return session_of(df).read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again."""
    return stored(df, work_dir(session_of(df), label))


def settle(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that ``make`` gives, written; the tables that were written on the way to it are deleted."""
    before, target = len(_paths), work_dir(spark, label)
    out = stored(make(), target)
    for path in _paths[before + 1 :]:
        remove(spark, path)
    del _paths[before:]
    return out
