"""Windows over keys that are cut into bins equal those over whole keys."""

from __future__ import annotations

import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import match, split_windows
from tracelake.plans.rule import from_doc, link
from tracelake.plans.selection import Fields

SECOND = 1_000_000_000


def test_next_starts_and_leaving():
    r = np.random.default_rng(0)
    for _ in range(200):
        n = int(r.integers(1, 60))
        ns = np.sort(r.integers(0, 40, n)) * SECOND // 2
        frame, number, own = int(r.integers(0, 5)), int(r.integers(1, 6)), int(r.integers(1, n + 1))
        op = (operator.ge, operator.eq, operator.lt, operator.gt, operator.le)[r.integers(0, 5)]
        values = r.integers(0, 3, n).astype(str) if r.random() < 0.5 else None
        end, count, after = split_windows.next_starts(ns, frame, op, number, values, own)
        for i in range(own):
            stop = sum(ns <= ns[i] + frame * SECOND)
            want = len(set(values[i:stop])) if values is not None else stop - i
            assert (end[i], count[i]) == (stop, want) and after[i] == (stop if op(want, number) else i + 1)
        out = split_windows.leaving(after)
        for i in range(own):
            at = i
            while at < own:
                at = after[at]
            assert out[i] == at


RULES = {
    "many": {"s": {"EventID": 1}, "condition": "s | count() by Computer >= 4", "timeframe": "20s"},
    "few": {"s": {"EventID": 1}, "condition": "s | count() by Computer <= 2", "timeframe": "3s"},
    "exact": {"s": {"EventID": 1}, "condition": "s | count() == 3", "timeframe": "2s"},
    "users": {"s": {"EventID": 1}, "condition": "s | count(User) by Computer >= 3", "timeframe": "15s"},
    "endless": {"s": {"EventID": 1}, "condition": "s | count() by Computer >= 500"},
}


@pytest.mark.parametrize("hot, size", [(500, 300), (100, 1), (50, 40)])
def test_one_hot_key_over_many_tasks(spark, monkeypatch, hot, size):
    """One key without a gap in it, bursts within a frame, ties in time, keys below the limit beside it."""
    r = np.random.default_rng(hot)
    n = 3_000
    seconds = np.cumsum(r.choice([0, 0, 1, 1, 2, 5], n))
    seconds[1_000:1_400] = seconds[1_000]  # a burst
    seconds.sort()
    hosts = ["HOT" if x < 0.9 else f"H{int(x * 1000) % 7}" for x in r.random(n)]
    rows = [(f"f{i % 3}.evtx", str(i), "1", "S", hosts[i], int(seconds[i]) * SECOND + int(r.integers(0, 3)), f"u{i * i % 5}") for i in range(n)]
    records = spark.createDataFrame(rows, "source_file string, record_id string, event_id string, channel string, computer string, event_ts_ns long, user string").repartition(7)
    event = F.struct(F.struct(F.struct(F.lit(1).alias("EventID"), F.col("computer").alias("Computer")).alias("System"), F.struct(F.col("user").alias("User")).alias("EventData")).alias("Event"))
    records = records.select("*", F.timestamp_micros(F.floor(F.col("event_ts_ns") / 1000)).alias("event_ts"), F.to_variant_object(event).alias("event"), F.lit("p").alias("provider"), F.lit("").alias("data_string"))
    fields = Fields(aliases={"EventID": "Event.System.EventID", "Computer": "Event.System.Computer"})
    docs = [{"id": k, "title": k, "level": "low", "status": "test", "author": "a", "date": "2024-01-01", "logsource": {"category": "t"}, "detection": d} for k, d in RULES.items()]
    rules = link([from_doc(d) for d in docs]).rules

    def windows() -> list:
        return sorted(map(str, match.windows(match.match(records, rules, fields), rules, fields).collect()))

    want = windows()
    assert len(want) > 300 and {k for k in RULES if any(f"'{k}'" in w for w in want)} == set(RULES)
    sizes = []
    real = split_windows.hot_windows

    def watched(rows, keys, *args):
        sizes.append({(x.rule_id, x.key) for x in keys.collect()})
        return real(rows, keys, *args)

    monkeypatch.setattr(split_windows, "HOT_ROWS", hot)
    monkeypatch.setattr(split_windows, "BIN_ROWS", size)
    monkeypatch.setattr(split_windows, "hot_windows", watched)
    assert windows() == want
    assert ("many", "HOT") in sizes[0] and ("exact", "_") in sizes[0] and not any(rule == "endless" for rule, _ in sizes[0])


def test_a_task_holds_a_bin_and_a_frame(spark, monkeypatch):
    monkeypatch.setattr(split_windows, "BIN_ROWS", 200)
    seen = spark.range(20_000).select(F.lit("r").alias("rule_id"), F.lit("k").alias("key"), F.lit(None).cast("string").alias("value"), (F.col("id") * SECOND).alias("ns"), F.lit(30).cast("bigint").alias("frame"), F.col("id").cast("string").alias("record_id"), *[F.lit("x").alias(c) for c in ("computer", "channel", "event_id", "source_file")])
    held = []
    real = split_windows.scratch.written
    monkeypatch.setattr(split_windows.scratch, "written", lambda df, name: held.append((name, real(df, name))) or held[-1][1])
    hot = seen.groupBy("rule_id", "key").agg(F.min("ns").alias("first"), F.max("ns").alias("last"))
    import pyarrow as pa

    kinds = match._WINDOW.split(", ")
    schema = pa.schema([(n, pa.list_(pa.string()) if "array" in t else pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split(" ", 1) for x in kinds)])
    out = split_windows.hot_windows(seen, hot, {"r": (30, operator.ge, 10, False)}, schema, match._WINDOW)
    assert out.count() == len(match.greedy_windows([i * SECOND for i in range(20_000)], 30, ">=", 10))
    bins = dict(held)["window-bins"].groupBy("bin").count().collect()
    assert len(bins) > 50 and max(r["count"] for r in bins) <= 200 + 2 * 31
