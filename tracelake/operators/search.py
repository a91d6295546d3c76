"""Keyword search over whole records."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.plans.selection import Fields, java_regex

from .render import all_fields


def search(records: DataFrame, keywords: Iterable[str] = (), regex: str | None = None, filters: Iterable[str] = (), every: bool = False, ignore_case: bool = False,
           fields: Fields | None = None, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """Records that hold a keyword (every: all of them) or match a regex, and whose fields match all `Name: glob` filters.

    timestamp, title, channel, event_id, record_id, all_fields, computer, source_file, each once, in the order of the timestamp's text.
    """
    fields = fields or Fields()
    keywords = list(keywords)
    text = F.col("data_string")
    if regex is not None:
        test = C.truth(text.rlike(("(?iu)" if ignore_case else "") + java_regex(regex)))
    else:
        low = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
        tests = [C.truth(low(text).contains(k.lower() if ignore_case else k)) for k in keywords]
        test = reduce(and_ if every else or_, tests) if tests else F.lit(True)
    for f in filters:
        name, _, pattern = f.partition(":")
        test = test & C.truth(fields.value(name.strip()).rlike(C.glob(pattern.strip())))
    shown = all_fields(F.col("event"))
    if abbreviations:
        shown = C.replace_all(shown, sorted(abbreviations.items()))
    found = records.where(test).select(
        C.format_time(F.col("event_ts"), "RFC-3339").alias("timestamp"), F.coalesce("computer", F.lit("-")).alias("computer"), F.coalesce("channel", F.lit("-")).alias("channel"),
        F.coalesce("event_id", F.lit("-")).alias("event_id"), F.coalesce("record_id", F.lit("-")).alias("record_id"), shown.alias("all_fields"), "source_file",
    )
    return found.distinct().orderBy("timestamp", "record_id", "source_file")


def field_globs(text: str) -> list[str]:
    """`A: x*, B: y` in parts."""
    return [x.strip() for x in re.split(r",(?=[^,:]+:)", text) if x.strip()]
