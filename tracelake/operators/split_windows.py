"""Greedy windows of keys with very many records, over time cut into bins.

A greedy window's start decides all that follows: the next start is the first record behind the window if that satisfies the comparison, else the next record.
So a bin of records is a function from the start that enters it to the start that leaves it.

1. A key's time is cut into fine bins no shorter than the frame; consecutive ones join until they have BIN_ROWS records. A window that begins in a bin ends in it or in the
   next, so a bin gets the next one's records of one frame beside its own.
2. Each bin's task finds where every one of its records leaves it.
3. The functions are applied one after another, which passes one number from bin to bin: the starts that enter.
4. Each bin's task walks from the start that enters it and gives the windows that begin in it.

A task holds a bin and a frame of records at most, never a session or a key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake import scratch

#: Keys with more records are cut.
HOT_ROWS = 200_000
#: Records of a bin, as far as frames allow it.
BIN_ROWS = 100_000
#: Fine bins of a key.
FINE_BINS = 1 << 20
SECOND = 1_000_000_000


def next_starts(ns: np.ndarray, frame: int, compare, number: int, values: np.ndarray | None, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of the first `own` records, in order: the end of its window, the count (of distinct values, if given) and the next start."""
    start = np.arange(own)
    end = np.searchsorted(ns, ns[:own] + frame * SECOND, side="right")
    if values is None:
        count = end - start
    else:
        # A value counts in a window where it stands first: one running set, as both ends only move on.
        count, seen, right, n = np.empty(own, dtype=np.int64), {}, 0, 0
        codes = np.unique(values, return_inverse=True)[1].tolist()
        for i, stop in enumerate(end.tolist()):
            while right < stop:
                seen[codes[right]] = seen.get(codes[right], 0) + 1
                n += seen[codes[right]] == 1
                right += 1
            count[i] = n
            seen[codes[i]] -= 1
            n -= seen[codes[i]] == 0
    hit = compare(count, number)
    return end, count, np.where(hit, end, start + 1)


def leaving(after: np.ndarray) -> np.ndarray:
    """Of each record, the first start at or behind the end of the bin that a walk from it comes to."""
    n, out = len(after), after.copy()
    while len(inside := np.flatnonzero(out < n)):  # paths double at every step
        out[inside] = out[out[inside]]
    return out


def _ordered(rows: pa.Table) -> tuple[pa.Table, int]:
    """A bin's own records, then the next bin's, by time and id; the number of its own."""
    rows = rows.sort_by([("ahead", "ascending"), ("ns", "ascending"), ("record_id", "ascending"), ("source_file", "ascending")])
    return rows, len(rows) - pa.compute.sum(rows["ahead"]).as_py()


def _starts(rows: pa.Table, own: int, term: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    frame, compare, number, distinct = term
    values = rows["value"].to_numpy(zero_copy_only=False).astype(str) if distinct else None
    return next_starts(rows["ns"].to_numpy(), frame, compare, number, values, own)


def hot_windows(rows: DataFrame, hot: DataFrame, terms: dict[str, tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """Windows of the keys of `hot` (rule_id, key, n, first, last), by rows of rule_id, key, value, ns, frame, record_id, computer, channel, event_id, source_file.

    terms: of each rule its frame, comparison, number, and whether distinct values count.
    """
    width = F.greatest(F.col("frame") * SECOND, F.ceil((F.col("last") - F.col("first")) / FINE_BINS), F.lit(SECOND)).cast("bigint")
    mine = rows.join(F.broadcast(hot), ["rule_id", "key"]).withColumn("_width", width).withColumn("_fine", F.floor((F.col("ns") - F.col("first")) / F.col("_width")))
    by = Window.partitionBy("rule_id", "key").orderBy("_fine")
    fine = mine.groupBy("rule_id", "key", "_fine").agg(F.count("*").alias("_n"), F.first("first").alias("_first"), F.first("_width").alias("_w"))
    fine = fine.withColumn("_bin", F.floor((F.sum("_n").over(by) - F.col("_n")) / BIN_ROWS))
    before = F.lag("_bin").over(by)
    # A fine bin that begins a bin knows where the bin before it ends.
    until = F.when(before < F.col("_bin"), F.col("_first") + (F.lag("_fine").over(by) + 1) * F.col("_w"))
    fine = fine.withColumn("_until", until).withColumn("_before", F.when(F.col("_until").isNotNull(), before))
    bins = fine.select("rule_id", "key", "_fine", "_bin", "_before", "_until")
    cut = mine.join(bins, ["rule_id", "key", "_fine"])
    ahead = F.col("ns") < F.col("_until") + F.col("frame") * SECOND
    place = lambda b, k: F.struct(b.alias("bin"), F.lit(k).alias("ahead"))
    cut = cut.withColumn("_at", F.explode(F.array_compact(F.array(place(F.col("_bin"), 0), F.when(ahead, place(F.col("_before"), 1))))))
    cut = scratch.written(cut.select("rule_id", "key", F.col("_at.bin").alias("bin"), F.col("_at.ahead").alias("ahead"), "value", "ns", "record_id", "computer", "channel", "event_id", "source_file"), "window-bins")

    def function(key: tuple, part: pa.Table) -> pa.Table:
        part, own = _ordered(part)
        _, _, after = _starts(part, own, terms[key[0].as_py()])
        out = leaving(after) - own
        return pa.table({"rule_id": [key[0]], "key": [key[1]], "bin": [key[2]], "own": pa.array([own], pa.int64()), "out": [zlib.compress(out.astype("<i4").tobytes(), 1)]})

    groups = ("rule_id", "key", "bin")
    functions = scratch.written(cut.groupBy(*groups).applyInArrow(function, "rule_id string, key string, bin bigint, own bigint, out binary"), "window-functions")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A key's bins one after another, in order."""
        current, start = None, 0
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if (r["rule_id"], r["key"]) != current:
                    current, start = (r["rule_id"], r["key"]), 0
                if start < r["own"]:
                    found.append({"rule_id": r["rule_id"], "key": r["key"], "bin": r["bin"], "entry": start})
                    start = int(np.frombuffer(zlib.decompress(r["out"]), dtype="<i4")[start])
                else:  # the walk passes over the whole bin
                    start -= r["own"]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("rule_id", pa.string()), ("key", pa.string()), ("bin", pa.int64()), ("entry", pa.int64())]))

    in_turn = functions.repartition("rule_id", "key").sortWithinPartitions("rule_id", "key", "bin")
    entries = scratch.written(in_turn.mapInArrow(compose, "rule_id string, key string, bin bigint, entry bigint"), "window-entries")

    def emit(key: tuple, part: pa.Table, entry: pa.Table) -> pa.Table:
        found = []
        if len(part) and len(entry):
            rule_id = key[0].as_py()
            part, own = _ordered(part)
            ends, counts, after = _starts(part, own, terms[rule_id])
            ns, at = part["ns"].to_numpy(), entry["entry"][0].as_py()
            while at < own:
                a, b, at = at, int(ends[at]), int(after[at])
                if terms[rule_id][1](counts[a], terms[rule_id][2]):
                    texts = lambda c: sorted({x for x in part[c].slice(a, b - a).to_pylist() if x is not None})  # noqa: E731, B023
                    found.append({"rule_id": rule_id, "key": key[1].as_py(), "count": int(counts[a]), "values": texts("value") if terms[rule_id][3] else [], "start_ns": int(ns[a]), "end_ns": int(ns[b - 1]), "computers": texts("computer"), "channels": texts("channel"), "event_ids": texts("event_id"), "files": texts("source_file")})
        return pa.Table.from_pylist(found, schema=schema)

    return cut.groupBy(*groups).cogroup(entries.groupBy(*groups)).applyInArrow(emit, ddl)


def hot_keys(rows: DataFrame) -> DataFrame:
    """rule_id, key, first, last of the keys with more than HOT_ROWS records and a frame."""
    n = rows.where("frame is not null").groupBy("rule_id", "key").agg(F.count("*").alias("_n"), F.min("ns").alias("first"), F.max("ns").alias("last"))
    return n.where(F.col("_n") > HOT_ROWS).drop("_n")
