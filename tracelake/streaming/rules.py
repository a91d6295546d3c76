"""Rules over streams: plain hits without state, count rules and temporal correlations with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracelake.operators.match import by_rule, greedy_windows, group_key, match
from tracelake.plans.rule import Rule
from tracelake.plans.selection import Fields

OUT = "rule_id string, key string, count bigint, start_ns bigint, end_ns bigint"
STATE = "ns array<bigint>, values array<string>"
SECOND = 1_000_000_000


def stream_hits(records: DataFrame, rules: list[Rule], fields: Fields | None = None) -> DataFrame:
    """Matches of plain rules as they come; the same plan as for tables."""
    return match(records, [r for r in rules if r.count is None], fields)


def stream_windows(records: DataFrame, rule: Rule, fields: Fields | None = None, delay: str = "10 minutes") -> DataFrame:
    """Windows of a count rule, each once, when the watermark has passed the frame that it starts. State is a key's records from the
    first whose frame the watermark has not passed.

    A window is settled when no record of its frame can come any more, so results equal those over a table for all records
    that are not later than the delay.
    """
    fields = fields or Fields()
    hits = match(records, [rule], fields)
    value = F.coalesce(fields.value(rule.count.field), F.lit("")) if rule.count.field else F.lit("")
    rows = hits.select("rule_id", group_key(rule.count.by, fields).alias("key"), value.alias("value"), "event_ts_ns", "event_ts").withWatermark("event_ts", delay)
    frame, op, number, distinct = rule.frame, rule.count.op, rule.count.number, rule.count.field is not None
    if frame is None:
        raise ValueError("a count rule over a stream needs a timeframe")
    rule_id = rule.id

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ns, values = (list(x) for x in state.get) if state.exists else ([], [])
        for b in batches:
            ns += b["event_ts_ns"].tolist()
            values += b["value"].tolist()
        found, t, v = settled(ns, values, frame, op, number, distinct, state.getCurrentWatermarkMs() * 1_000_000)
        if t:
            state.update((t, v))
            state.setTimeoutTimestamp(max(t[0] // 1_000_000 + frame * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(rule_id, key[1], c, a, b) for a, b, c in found], columns=["rule_id", "key", "count", "start_ns", "end_ns"])

    return rows.groupBy("rule_id", "key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settled(ns: list[int], values: list[str], frame: int, op: str, number: int, distinct: bool, done: int) -> tuple[list[tuple[int, int, int]], list[int], list[str]]:
    """(start, end, count) of the windows whose frame ends before done, and the times and values of the records that are still open."""
    order = np.argsort(np.array(ns, dtype=np.int64), kind="stable")
    t, v = [ns[i] for i in order], [values[i] for i in order]
    windows = greedy_windows(t, frame, op, number, v if distinct else None, done)
    # A record goes once a window has taken it or its own frame has passed.
    left = max(windows[-1][1] if windows else 0, int(np.searchsorted(np.array(t, dtype=np.int64), done - frame * SECOND)))
    return [(t[a], t[b - 1], c) for a, b, c in windows], t[left:], v[left:]


def stream_temporal(records: DataFrame, rules: list[Rule], rule: Rule, fields: Fields | None = None, delay: str = "10 minutes") -> DataFrame:
    """Windows of a temporal correlation's base rule (rule_id is the correlation's) that its other rules confirm, each once.

    rules: linked, those that `rule` refers to among them. One operator holds a key's open records and its settled windows as list state. A batch
    only appends to them; a timer settles windows that the watermark has passed, judges the base's windows once every window near
    them is settled, and drops windows that no later base can reach. Results equal `match.temporal` over the same records, as far as the
    watermark has come and no record is later than the delay. Needs the RocksDB state store. A key's open records meet in one task.
    """
    fields = fields or Fields()
    known = {r.id: r for r in rules}
    parts = [known[i] for i in rule.refs]
    if not parts or any(p.count is None or p.frame is None for p in parts):
        raise ValueError("a temporal correlation over a stream needs rules with timeframes")
    value = by_rule(parts, lambda r: F.coalesce(fields.value(r.count.field), F.lit("")) if r.count.field else F.lit(""), "string")
    number = by_rule(parts, lambda r: F.lit(rule.refs.index(r.id)), "int")
    rows = match(records, parts, fields).select(by_rule(parts, lambda r: group_key(r.count.by, fields), "string").alias("key"), number.alias("part"), value.alias("value"), "event_ts_ns", "event_ts").withWatermark("event_ts", delay)
    terms = [(p.frame, p.count.op, p.count.number, p.count.field is not None) for p in parts]
    return rows.groupBy("key").transformWithStateInPandas(Correlate(rule.id, terms, rule.frame, rule.kind == "temporal_ordered"), OUT, "append", "eventtime")


class Correlate(StatefulProcessor):
    """The state of a key: open records (part, ns, value) and settled windows (part, start, end, count). Part 0 is the base."""

    def __init__(self, rule_id: str, terms: list[tuple[int, str, int, bool]], seconds: int, ordered: bool) -> None:
        self.rule_id, self.terms, self.span, self.ordered = rule_id, terms, seconds * SECOND, ordered
        self.longest = max(t[0] for t in terms) * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "part int, ns bigint, value string")
        self.windows = handle.getListState("windows", "part int, start_ns bigint, end_ns bigint, count bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for b in rows:
            if len(b):
                self.open.appendList(list(zip(b["part"].tolist(), b["event_ts_ns"].tolist(), b["value"].tolist())))
                first = min(x for x in (first, int(b["event_ts_ns"].min())) if x is not None)
        if first is not None:
            # A timer that fires no later than this will set the next one.
            due = self._after(first + min(t[0] for t in self.terms) * SECOND, timerValues)
            if not any(t <= due for t in self.handle.listTimers()):
                self.handle.registerTimer(due)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = timerValues.getCurrentWatermarkInMs() * 1_000_000
        held, kept = [tuple(x) for x in self.open.get()], [tuple(x) for x in self.windows.get()]
        still, due = [], []
        for part, (frame, op, number, distinct) in enumerate(self.terms):
            mine = [x for x in held if x[0] == part]
            found, t, v = settled([x[1] for x in mine], [x[2] for x in mine], frame, op, number, distinct, done)
            kept += [(part, a, b, c) for a, b, c in found]
            still += [(part, a, b) for a, b in zip(t, v)]
            due += [t[0] + frame * SECOND] if t else []
        # Windows that start here or before are all known.
        sure = done - self.longest
        base = sorted(w for w in kept if w[0] == 0)
        starts = [np.array(sorted(w[1] for w in kept if w[0] == part), dtype=np.int64) for part in range(len(self.terms))]
        fired = [w for w in base if w[1] + self.span < sure and self._confirmed(w[1], starts)]
        waiting = [w for w in base if w[1] + self.span >= sure]
        # The earliest base that is still to be judged, or to come.
        earliest = min([w[1] for w in waiting] + [x[1] for x in still if x[0] == 0] + [done])
        others = [w for w in kept if w[0] and w[1] >= earliest - self.span]
        due += [w[1] + self.span + self.longest for w in waiting] + [w[1] + self.span for w in others]
        self._set(self.open, still)
        self._set(self.windows, waiting + others)
        if due:
            self.handle.registerTimer(self._after(min(due), timerValues))
        yield self._rows(key, fired)

    def _confirmed(self, start: int, starts: list[np.ndarray]) -> bool:
        at = start if self.ordered else start - self.span
        for own in starts[1:]:
            i = int(np.searchsorted(own, at))
            if i == len(own) or own[i] > start + self.span:
                return False
            at = int(own[i]) if self.ordered else at
        return len(starts) > 1

    def _rows(self, key, windows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(self.rule_id, key[0], c, a, b) for _, a, b, c in windows], columns=["rule_id", "key", "count", "start_ns", "end_ns"]).astype({"count": "int64", "start_ns": "int64", "end_ns": "int64"})

    @staticmethod
    def _after(ns: int, timers) -> int:
        """The first millisecond behind a time, and behind the watermark."""
        return max(ns // 1_000_000 + 1, timers.getCurrentWatermarkInMs() + 1)

    @staticmethod
    def _set(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()
