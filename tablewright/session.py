"""Session set-up, reliable lineage cuts and shared scratch folders."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing_lock, _writing = threading.Lock(), []    # what the setting was, then one entry for each write under way
SMALL_SHARE = 64 << 20     # bytes per core below which a table counts as small
FEW_ROWS = 1_000           # rows per core not worth spreading


def build_session(app: str = "tablewright", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, a private one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tablewright-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table beside the checkpoints and read it back.

    It survives executor loss, later passes read only their columns, and its size is known to Spark. The
    shuffle files of the writing are given back as soon as it has ended.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    with shuffle_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Give back shuffle files at the end of each write inside.

    The session has one setting for all its threads: the first one in turns it on, the last one out leaves it as it was.
    """
    with _writing_lock:
        if not _writing:
            _writing.append(spark.conf.get(SHUFFLE_CLEANUP, None))
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _writing.append(None)
    try:
        yield
    finally:
        with _writing_lock:
            _writing.pop()
            if len(_writing) == 1:
                before = _writing.pop()
                if before is None:
                    spark.conf.unset(SHUFFLE_CLEANUP)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP, before)


class Generations:
    """Settled tables of which only the newest is read: the one before is deleted once the next is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def settle(self, df: DataFrame) -> DataFrame:
        made = settle(df)
        old, self.path = self.path, made.inputFiles()[:1]
        if old:
            release(self.spark, os.path.dirname(old[0]))
        return made

    def close(self) -> None:
        """Delete the newest one too."""
        old, self.path = self.path, None
        if old:
            release(self.spark, os.path.dirname(old[0]))


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder beside the checkpoints, on whatever file system they are."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle_partitions(df: DataFrame) -> DataFrame:
    """A checkpoint that keeps the partitions as they are, for work that is defined by partition."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A table that is small beside the cluster over all its cores; any other keeps its partitions.

    Worth it ahead of Python functions and of training, where one small file would mean one busy core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SHARE else df


def settle_for_training(df: DataFrame) -> DataFrame:
    """``settle``, and over all cores when the rows came out in fewer files than that."""
    rows = settle(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores or rows.count() < cores * FEW_ROWS:
        return rows
    return settle(rows.repartition(cores))


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name beside the checkpoints, reachable from every executor."""
    return os.path.join(checkpoint_root(spark), f"{purpose}-{uuid.uuid4().hex}")


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application and whatever the thread, as ``--py-files`` would."""
    context = spark.sparkContext
    with _shipping:
        if context.applicationId in _shipped:
            return
        package = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="tablewright-"), package.name)
        context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
