"""Which channels each log file has, as a side table: files of channels that no rule names are not opened.

The table has a row for each file and channel (a null channel for a file without any). update() reads new and changed files alone and adds their rows under a new generation; a file's rows
of its newest generation count. A file of several channels is read for each of them, so no match is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans.rule import Rule, required_channels
from tracelake.sources import evtx

SCHEMA = "source_file string, size bigint, changed bigint, channel string, generation bigint"


class FileChannels:
    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    def _all(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.table)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(SCHEMA).parquet(self.table) if there else self.spark.createDataFrame([], SCHEMA)

    def rows(self) -> DataFrame:
        """source_file, size, changed, channel of every known file."""
        newest = self._all().groupBy("source_file").agg(F.max("generation").alias("generation"))
        return self._all().join(newest, ["source_file", "generation"]).drop("generation")

    def update(self, path: str) -> int:
        """Read the files below a path that the table does not have, or not as they are now; how many they were."""
        here = self.spark.createDataFrame(evtx.listing(path), "source_file string, size bigint, changed bigint")
        new = here.join(self.rows().select("source_file", "size", "changed").distinct(), ["source_file", "size", "changed"], "left_anti")
        names = [r.source_file for r in new.collect()]  # files, not records
        if names:
            generation = (self._all().agg(F.max("generation")).first()[0] or 0) + 1
            found = evtx.log_files(self.spark, path, files=names).select("source_file", "channel").where("channel is not null").distinct()
            found = new.join(found, "source_file", "left").withColumn("generation", F.lit(generation).cast("bigint"))
            found.select("source_file", "size", "changed", "channel", "generation").write.mode("append").parquet(self.table)
        return len(names)

    def channels(self) -> set[str]:
        return {r.channel for r in self.rows().select("channel").where("channel is not null").distinct().collect()}

    def files(self, rules: list[Rule]) -> list[str] | None:
        """The files that some rule can match, or None for all: a rule may name no channel."""
        needs = [required_channels(r) for r in rules]
        if not needs or any(n is None for n in needs):
            return None
        wanted = self.spark.createDataFrame([(x.lower(),) for x in sorted(set().union(*needs))], "_wanted string")
        met = self.rows().join(F.broadcast(wanted), F.lower("channel").contains(F.col("_wanted")), "left_semi")  # as many rows as rules name channels
        return sorted(r.source_file for r in met.select("source_file").distinct().collect())
