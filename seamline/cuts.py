"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_SEEN: set[str] = set()


class NoSharedFolder(RuntimeError):
    """A cluster's session names no folder that all executors share."""


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset, a local session (one machine) gets a temporary folder of this process; on a cluster a machine's
    own folder would lose rows, so NoSharedFolder is raised.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="seamline-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; removed when the application's Python ends."""
    folder = f"{shared_folder(spark)}/seamline-{spark.sparkContext.applicationId}"
    if folder not in _SEEN:
        _SEEN.add(folder)
        atexit.register(_drop_at_exit, spark.sparkContext._jvm, folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back: later uses neither recompute it nor depend on executors that may be lost.

    An empty frame is written and read like any other. The files stay until drop_cuts() or the end of the application.
    """
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete what this application has cut; frames built on it can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropped(spark: SparkSession):
    """Drops the cuts of a block of work when it is done, for jobs that write their results inside the block."""
    try:
        yield
    finally:
        drop_cuts(spark)


def _drop_at_exit(jvm, folder: str) -> None:
    """Works after the session was stopped, too, as long as its JVM is there."""
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # noqa: BLE001 - without a JVM there is no way to reach the folder
        pass
