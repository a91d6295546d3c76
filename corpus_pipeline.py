"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; every stage's result is written and read
back as the next one's docs. Mixing repeats documents that it takes twice, so sharding places every copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from tracelake.llm.common import drop_scratch, materialize, table

#: Near duplicates share 80% of their shingles of five words; ngram_join's own defaults are op3_ngram_jaccard's.
NEAR = {"ngram": 5, "percent": 80}


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, **NEAR)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [("quality rules", good), ("n-gram Jaccard join", distinct), ("benchmark decontamination", clean), ("mixing", mixed), ("sharding", sharded)]

#: The k-d tree of the last stage has no practical SQL; tests hold the pipeline to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        before, docs = docs, materialize(out, name.replace(" ", "-"))
        drop_scratch(before)
    return docs
