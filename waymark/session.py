"""Small helpers around the session: where checkpoints go, and what is small enough to be sent to every executor."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many bytes, as their rows are counted, are sent to every executor.
BROADCAST_BYTES = 24_000_000
#: Seconds between two collections of the driver's heap, after which Spark drops shuffles that nothing refers to.
_CLEAN_EVERY = 5.0
_cleaned = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests, and an
    error elsewhere: executors would write to disks of their own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return found or current.get()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="waymark-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; now and then let Spark's cleaner drop the shuffles behind it."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    if time.monotonic() - _cleaned[0] > _CLEAN_EVERY:
        gc.collect()
        out.sparkSession.sparkContext._jvm.System.gc()
        _cleaned[0] = time.monotonic()
    return out


def small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most `most` bytes; it must be materialised."""
    rows = most // row_bytes
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
