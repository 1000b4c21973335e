"""Tables that are computed once and read many times, and the shared folder that they lie in."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
_made: list[tuple[SparkSession, str]] = []


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


@atexit.register
def _remove_made() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone at exit
            return


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the context was given, or spark.checkpoint.dir as the cluster names it; a
    temporary one only on a local master. Checkpoints in it go when no frame reads them any more."""
    context = spark.sparkContext
    # tables are removed once nothing refers to them; a setting of the user's stays
    conf = context._jsc.sc().conf()
    if not conf.contains("spark.cleaner.referenceTracking.cleanCheckpoints"):
        conf.set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has, removed when the driver's process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def settled(df: DataFrame) -> DataFrame:
    """`df` as a checkpoint: whatever reads it, and however often, it is computed once and outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, a settled table of strings and numbers, with a broadcast hint if its values take no more than so many bytes."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        width = width + (F.coalesce(F.octet_length(name), F.lit(0)) + 16 if kind == "string" else F.lit(8))
    size = df.agg(F.sum(width.cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= most_bytes else df
