"""Summaries of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import columns as C

from .metrics import top


def by_level(detections: DataFrame) -> DataFrame:
    """total and distinct rules of each level."""
    return detections.groupBy("level").agg(F.count("*").alias("total"), F.count_distinct("rule_id").alias("unique_rules"))


def busiest_date(detections: DataFrame) -> DataFrame:
    """The date with the most detections of each level; of equal ones the first."""
    days = detections.groupBy("level", F.to_date("event_ts").alias("day")).agg(F.count("*").alias("total"))
    return top(days, ["level"], "total", 1, ["day"])


def top_computers(detections: DataFrame, k: int = 5) -> DataFrame:
    """The computers with the most distinct rules of each level."""
    pairs = detections.select("level", "computer", "rule_id").distinct().groupBy("level", "computer").agg(F.count("*").alias("total"))
    return top(pairs, ["level"], "total", k, ["computer"])


def top_rules(detections: DataFrame, k: int = 5) -> DataFrame:
    """The rules with the most detections of each level."""
    return top(detections.groupBy("level", "title").agg(F.count("*").alias("total")), ["level"], "total", k, ["title"])


def authors(detections: DataFrame) -> DataFrame:
    """Detected rules of each author; names are divided by , / or ;."""
    rules = detections.select("rule_id", "author").distinct()
    return rules.select(F.explode(F.array_distinct(F.transform(F.split("author", "[,/;]"), lambda x: F.trim(x)))).alias("author")).where("author <> ''").groupBy("author").agg(F.count("*").alias("rules"))


def data_reduction(detections: DataFrame, total: int) -> DataFrame:
    """Events with a hit, all events, and the share without one."""
    hits = detections.agg(F.count_distinct("event_ts_ns", "event_id").alias("events_with_hits"))
    return hits.select("events_with_hits", F.lit(total).cast("bigint").alias("events"), F.round((F.lit(total) - F.col("events_with_hits")) / F.lit(max(total, 1)) * 100, 2).alias("reduction_percent"))


def tactics(detections: DataFrame, names: dict[str, str]) -> DataFrame:
    """Detections and distinct rules of each tactic and computer."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rows = detections.select("computer", "rule_id", F.explode("tags").alias("tag")).withColumn("tactic", F.try_element_at(known, F.lower("tag"))).where("tactic is not null")
    return rows.groupBy("tactic", "computer").agg(F.count("*").alias("total"), F.count_distinct("rule_id").alias("unique_rules"))


def pivot_keywords(records: DataFrame, categories: dict[str, list[str]], fields) -> DataFrame:
    """category, value: distinct values of each category's fields, local addresses and dashes left out; records need a level."""
    entries = [F.struct(F.lit(k).alias("category"), fields.value(name).alias("value")) for k, names in categories.items() for name in names]
    rows = records.where(C.scalar(F.col("event"), "Event.System.Level").isNotNull()).select(F.explode(F.array(*entries)).alias("x")).select("x.*")
    return rows.where("value is not null and value not in ('', '-', '127.0.0.1', '::1')").distinct()
