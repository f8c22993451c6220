"""Where a job may keep tables that every executor has to see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the session's ``spark.checkpoint.dir``.

    What a query keeps there must outlive its own call, since the frame it
    returns still reads it, so nothing is deleted here: the folder belongs to
    the session's checkpoint directory and goes when its owner clears that.
    Where the setting is missing, a local master gets a machine-local folder
    that is removed when the process ends; on a cluster that would lose rows
    (each executor would write to its own disk), so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/tideline-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tideline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Scratch:
    """The intermediate tables of one call, by name, in a shared folder of their own.

    The call owns them and drops each one when the tables made from it are written, so a
    long job holds few at a time. A written table has no lineage: what it was made of is
    never read again, also not when executors are lost. Tables that the returned frame
    still reads are left, like everything under ``spark.checkpoint.dir``, to the session's
    owner.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        """The frame as the table ``name``, which must be new."""
        return written(frame, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that nothing will read any more."""
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark's setting that has the shuffle files of a statement removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, path: str) -> DataFrame:
    """The frame as a Parquet table at ``path``: its lineage starts anew there.

    So nothing reads the shuffle files of the write any more, and they go at its end instead of
    when the driver happens to collect its garbage.
    """
    conf = frame.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
