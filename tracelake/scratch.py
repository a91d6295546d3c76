"""Intermediate tables in the folder that driver and executors share: they cut lineage, are read more than once, and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has at most so many rows, counted first.
BROADCAST_ROWS = 200_000

_TABLES: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine, if it is the only one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is read back; it goes with drop() or when the driver ends."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _TABLES:
        atexit.register(drop_all)
    _TABLES[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count shows that it fits; else as it is, to be joined by shuffling."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def drop(*frames: DataFrame) -> None:
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path in _TABLES:
            _delete(_TABLES.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_all() -> None:
    for path, spark in list(_TABLES.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended first
            pass
    _TABLES.clear()
