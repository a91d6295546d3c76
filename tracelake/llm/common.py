"""Plumbing shared by the corpus operators: word splitting, scratch tables, size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word pattern [^\x20\x09-\x0D]+.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_REGEX = "[\\x20\\x09-\\x0D]+"

#: A side of a join is broadcast only when it has at most so many rows, counted first.
BROADCAST_ROWS = 500_000

_SCRATCH: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ws_words(text: Column) -> Column:
    """Array of maximal runs of [^\\x20\\x09-\\x0D]; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_REGEX))


def hold(docs: DataFrame) -> DataFrame:
    """Whole rows in one column _row, beside their _key, doc_id and the text's hash: joins with verdicts then meet no other names."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))


def release(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The held rows with the columns that they had."""
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of this machine, if it is the only one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and outlives lost executors.

    The table is removed by drop_scratch() or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _SCRATCH[path] = spark
    if len(_SCRATCH) == 1:
        atexit.register(_drop_all)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def materialize_parts(df: DataFrame, name: str, column: str, values: list[str]) -> list[DataFrame]:
    """As materialize, in one pass, but a table for each value of a column, which can be dropped by itself."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    if not _SCRATCH:
        atexit.register(_drop_all)
    _SCRATCH[path] = spark
    tables = []
    for value in values:
        out = spark.read.schema(df.drop(column).schema).parquet(path).where(F.lit(False))
        own = f"{path}/{column}={value}"
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            out = spark.read.schema(df.drop(column).schema).parquet(own)
            _SCRATCH[own] = spark
            out.scratch_path = own
        tables.append(out)
    return tables


def drop_scratch(*frames: DataFrame) -> None:
    """Delete scratch tables that no later action reads."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path in _SCRATCH:
            _delete(_SCRATCH.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for path, spark in list(_SCRATCH.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended first
            pass
    _SCRATCH.clear()


#: Rows of an Arrow batch between the JVM and Python, in place of Spark's 10,000: texts are long, and both sides hold whole batches.
ARROW_ROWS = 1_000


def ship_package(spark: SparkSession) -> None:
    """Make Python operators ready: this package goes to the executors once, as their Python may not have it on its path,
    and Arrow batches become smaller unless the session has its own size for them."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(context, "_tracelake_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="tracelake-")) / "tracelake-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "tracelake").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(target))
    context._tracelake_shipped = True


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its count shows that it fits; else df as it is, to be joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
