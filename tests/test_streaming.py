"""Rules over streams in several batches against the same rules over the table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelake import catalog
from tracelake.operators import match
from tracelake.streaming import rules as streaming

SF = "/root/testdata/sf0.001"
STORE = "spark.sql.streaming.stateStore.providerClass"
DAY = 86_400_000_000_000


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The records as files in the order of their times, one a batch, and a record far behind them that moves the watermark past all."""
    slim = catalog.records(spark, SF).drop("event").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    folder = str(tmp_path_factory.mktemp("stream") / "in")
    low, last = slim.agg(F.min("event_ts_ns"), F.max("event_ts_ns")).first()
    parts = 4
    step = (last - low) // parts + 1
    for i in range(parts):
        slim.where(F.floor((F.col("event_ts_ns") - low) / step) == i).coalesce(1).write.mode("append").parquet(folder)
    late = slim.where("event_id = '4625'").limit(1).withColumn("event_ts", F.col("event_ts") + F.expr("interval 400 days")).withColumn("event_ts_ns", F.lit(last + 400 * DAY))
    late.coalesce(1).write.mode("append").parquet(folder)
    make = lambda df: df.withColumn("event", F.parse_json("data_string"))
    return make(spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", 1).parquet(folder)), make(slim), last


def run(spark, df, name, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


@pytest.mark.parametrize("kind", ["temporal", "temporal_ordered"])
def test_temporal_correlations(spark, events, tmp_path, kind):
    """The stream's confirmed windows are the table's, one of the referred rules a count of its own."""
    stream, table, last = events
    burst = {"s": {"EventID": 4624}, "condition": "s | count() by Computer >= 2", "timeframe": "24h"}
    rules = catalog.linked(
        catalog.rule("first", {"s": {"EventID": 4625}}), catalog.rule("second", burst), catalog.rule("third", {"s": {"EventID": 4688}}),
        catalog.correlation("all", type=kind, rules=["first", "second", "third"], timespan="2d", group_by=["Computer"]),
    )
    both = next(r for r in rules if r.kind == kind)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = run(spark, streaming.stream_temporal(stream, rules, both, catalog.fields(), "1 minute"), f"seen_{kind}", tmp_path).where(F.col("start_ns") <= last)
        got = sorted(tuple(r) for r in seen.select("rule_id", "key", "count", "start_ns", "end_ns").collect())
    finally:
        spark.conf.set(STORE, before)
    counted = [r for r in rules if r.count is not None]
    windows = match.windows(match.match(table, counted, catalog.fields()), counted, catalog.fields())
    want = match.temporal(windows, both.refs[0], list(both.refs[1:]), both.frame, kind == "temporal_ordered")
    assert got == sorted(("all", *r) for r in want.select("key", "count", "start_ns", "end_ns").collect()) != []


def test_count_windows_in_batches(spark, events, tmp_path):
    stream, table, last = events
    rules = catalog.linked(catalog.rule("w", catalog.BURST))
    seen = run(spark, streaming.stream_windows(stream, rules[0], catalog.fields(), "1 minute"), "windows_in_batches", tmp_path).where(F.col("start_ns") <= last)
    want = match.windows(match.match(table, rules, catalog.fields()), rules, catalog.fields())
    show = lambda df: sorted(tuple(r) for r in df.select("key", "count", "start_ns", "end_ns").collect())
    assert show(seen) == show(want) != []


@pytest.mark.parametrize("distinct", [False, True])
def test_settled_in_steps_equals_whole(distinct):
    """Windows settled while the time moves on are those of all records at once; no record stays open whose frame has passed."""
    rng = random.Random(5)
    for op, number in ((">=", 3), ("==", 2), ("<", 2), (">", 4), ("<=", 1)):
        ns = sorted(rng.randrange(0, 400) * streaming.SECOND for _ in range(150))
        values = [rng.choice("abcde") for _ in ns]
        want = [(ns[a], ns[b - 1], c) for a, b, c in match.greedy_windows(ns, 20, op, number, values if distinct else None)]
        got, t, v, fed = [], [], [], 0
        for done in [*range(0, 400 * streaming.SECOND, 7 * streaming.SECOND), 10**12]:
            new = [i for i in range(fed, len(ns)) if ns[i] < done + 5 * streaming.SECOND]
            t, v, fed = t + [ns[i] for i in new], v + [values[i] for i in new], fed + len(new)
            found, t, v = streaming.settled(t, v, 20, op, number, distinct, done)
            got += found
            assert all(x + 20 * streaming.SECOND >= done for x in t)
        assert got == want and not t


def test_a_count_without_timeframe_is_an_error(spark, events):
    endless = {"s": {"EventID": 4624}, "condition": "s | count() by Computer >= 2"}
    rules = catalog.linked(catalog.rule("first", {"s": {"EventID": 4625}}), catalog.rule("second", endless), catalog.correlation("all", type="temporal", rules=["first", "second"], timespan="2h", group_by=["Computer"]))
    with pytest.raises(ValueError):
        streaming.stream_temporal(events[0], rules, next(r for r in rules if r.kind == "temporal"), catalog.fields())
