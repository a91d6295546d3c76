"""Filters of records before any rule."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import columns as C


def computers(records: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Exact names; a record without a computer passes."""
    include, exclude = list(include), list(exclude)
    if include:
        records = records.where(F.col("computer").isNull() | F.col("computer").isin(include))
    if exclude:
        records = records.where(F.col("computer").isNull() | ~F.col("computer").isin(exclude))
    return records


def event_ids(records: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Ids as text; a missing one is the empty text."""
    own = F.coalesce("event_id", F.lit(""))
    include, exclude = [str(x) for x in include], [str(x) for x in exclude]
    if include:
        records = records.where(own.isin(include))
    return records.where(~own.isin(exclude)) if exclude else records


def target_ids(records: DataFrame, targets: Iterable[str]) -> DataFrame:
    """Ids of a target list; an empty list lets all through, and so does an id that is no scalar."""
    targets = [str(x) for x in targets]
    return records.where(F.col("event_id").isNull() | F.col("event_id").isin(targets)) if targets else records


def valid_channel(records: DataFrame) -> DataFrame:
    return records.where(F.col("channel").isNotNull() & (F.col("channel") != "null"))


_OFFSET = re.compile(r"(\d+)([yMdhms])")


def offset_interval(text: str):
    """1y3M30d24h30m10s as an interval; M are months, m minutes."""
    if not text or _OFFSET.sub("", text):
        raise ValueError(f"an offset like 1y3M30d24h30m10s is needed, not {text!r}")
    n = dict.fromkeys("yMdhms", 0)
    for number, unit in _OFFSET.findall(text):
        n[unit] += int(number)
    return F.make_interval(F.lit(n["y"]), F.lit(n["M"]), F.lit(0), F.lit(n["d"]), F.lit(n["h"]), F.lit(n["m"]), F.lit(n["s"]))


def time_range(records: DataFrame, start: str | None = None, end: str | None = None, last: str | None = None, now: str | None = None) -> DataFrame:
    """From start to end, both included, or the last offset up to now; records without a time stay."""
    ts = F.col("event_ts")
    if last:
        until = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        records = records.where(ts.isNull() | ts.between(until - offset_interval(last), until))
    if start:
        records = records.where(ts.isNull() | (ts >= F.to_timestamp(F.lit(start))))
    return records.where(ts.isNull() | (ts <= F.to_timestamp(F.lit(end)))) if end else records


def channels(records: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    low = F.lower("channel")
    include, exclude = [x.lower() for x in include], [x.lower() for x in exclude]
    if include:
        records = records.where(low.isin(include))
    return records.where(~C.truth(low.isin(exclude))) if exclude else records


def file_names(records: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Globs over the last part of the path, without regard to case."""
    name = F.element_at(F.split("source_file", "/"), -1)
    any_ = lambda globs: "|".join(f"(?:{C.glob(g)})" for g in globs)
    include, exclude = list(include), list(exclude)
    if include:
        records = records.where(C.truth(name.rlike(any_(include))))
    return records.where(~C.truth(name.rlike(any_(exclude)))) if exclude else records


def rule_channels(records: DataFrame, rules) -> DataFrame:
    """Records of channels that some rule names, unless a rule can match any; partitions go first where a table is partitioned by channel."""
    from tracelake.plans.rule import required_channels

    needs = [required_channels(r) for r in rules]
    if not needs or any(n is None for n in needs):
        return records
    names = sorted({x.lower() for n in needs for x in n})
    return records.where(F.lower("channel").rlike("|".join(re.escape(x) for x in names)))
