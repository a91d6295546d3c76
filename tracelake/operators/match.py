"""One scan of the records for all rules, counts over their matches, and correlations between counts."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake import scratch
from tracelake.functions import columns as C
from tracelake.operators import filters, split_windows
from tracelake.plans import literals
from tracelake.plans.condition import Count
from tracelake.plans.rule import Rule, required_channels
from tracelake.plans.selection import Fields

#: Rules of one array of hits.
CHUNK = 100
#: From so many rules with literals on, an automaton finds each record's candidates among them first; those are told apart in arrays of PREFILTER_CHUNK.
PREFILTER_RULES, PREFILTER_CHUNK = 500, 50
#: The JVM never compiles methods of more bytes; Spark makes one method of all fields and predicates up to its own limit of 65,535, and smaller ones of what is above the limit.
METHOD_BYTES = 8_000
#: Columns of a record that matches keep.
KEPT = ("source_file", "record_id", "event_id", "channel", "computer", "provider", "event_ts", "event_ts_ns", "recovered", "event", "data_string")


def prune(rules: list[Rule], channels: set[str]) -> list[Rule]:
    """Rules that can match records of these channels."""
    low = {c.lower() for c in channels}
    return [r for r in rules if (need := required_channels(r)) is None or any(n.lower() in c for n in need for c in low)]


def match(records: DataFrame, rules: list[Rule], fields: Fields | None = None) -> DataFrame:
    """A row for each record and rule that matches: the record's columns and the rule's id.

    Every path that some rule asks for becomes one column first; each rule is one predicate over them, and the
    ids of those that hold are exploded. Nothing is joined or shuffled. Where every rule names its channels, records of
    others are left out before any field is read. Of hundreds of rules and more, those that ask for some text are tried on the records alone that hold it,
    and of them only those are compiled whose text is in some record. A pass over the records' text tells which, and which of a rule's texts is the rarest (not for streams).
    """
    rules = [r for r in rules if r.kind not in ("temporal", "temporal_ordered")]
    fields = fields or Fields()
    if len(rules) >= PREFILTER_RULES and "data_string" in records.columns and literals.available():
        seen: set[str] = set()
        needs = {r.id: literals.needed(r, fields, seen=seen) for r in rules}
        sought = [r for r in rules if needs[r.id]]
        if len(sought) >= PREFILTER_RULES:
            rest = [r for r in rules if not needs[r.id]]
            if not records.isStreaming:
                texts = filters.rule_channels(records, sought) if fields.path("Channel") == "Event.System.Channel" else records
                counts = literals.count(texts, sorted(seen))
                needs = {r.id: literals.needed(r, fields, lambda need: sum(counts.get(x, 0) for x in need)) for r in sought}
                sought = [r for r in sought if any(counts.get(x) for x in needs[r.id])]
            found = _match(records, sought, fields, [needs[r.id] for r in sought])
            return found.unionByName(_match(records, rest, fields)) if rest else found
    return _match(records, rules, fields)


def small_methods(spark: SparkSession) -> None:
    """Have Spark generate methods that the JVM compiles, unless the session has its own limit."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))


def _match(records: DataFrame, rules: list[Rule], fields: Fields, needs: list[frozenset[str]] | None = None) -> DataFrame:
    cols = [c for c in KEPT if c in records.columns]
    if not rules:
        return records.select(*cols, F.lit("").alias("rule_id")).where("false")
    small_methods(records.sparkSession)
    probe = Fields(aliases=fields.aliases, files=fields.files, windash=fields.windash, strict_cased=fields.strict_cased, numbered="_f")

    def hit(i: int) -> Column:
        test = rules[i].matcher(probe)
        return F.when(F.array_contains("_candidates.rules", i) & test if needs else test, i).otherwise(-1)

    # One projection of one scan, however many rules there are; an array for so many of them keeps the generated methods small.
    # array_remove is compiled with the predicates inside it, where array_compact has Spark interpret them for each record.
    size = PREFILTER_CHUNK if needs else CHUNK
    parts = [F.array_remove(F.array(*[hit(i) for i in range(k, min(k + size, len(rules)))]), -1) for k in range(0, len(rules), size)]
    if needs:
        parts = [F.when(F.array_contains("_candidates.chunks", k), p).otherwise(F.array().cast("array<int>")) for k, p in enumerate(parts)]
    hits = parts[0] if len(parts) == 1 else F.concat(*parts)
    if fields.path("Channel") == "Event.System.Channel":
        records = filters.rule_channels(records, rules)
    more = []
    if needs:
        more = ["_candidates"]
        records = records.withColumn("_candidates", literals.finder(needs, size)(F.col("data_string"))).where(F.size("_candidates.rules") > 0)
    typed = {"Event.System.EventID": "event_id", "Event.System.Channel": "channel", "Event.System.Computer": "computer"}
    flat = records.select(*cols, *more, *[(F.col(typed[p]) if p in typed else C.scalar(F.col("event"), p)).alias(f"_f{k}") for k, p in enumerate(probe.asked)])
    # The hits are a column of their own first: inside the generator nothing is compiled. It is an outer one: the filter that Spark infers
    # for an inner one would evaluate all predicates once more, below the projection, with every field's expression written out in each of them.
    found = flat.select(*cols, hits.alias("_hits")).select(*cols, F.explode_outer("_hits").alias("_hit")).where("_hit is not null")
    return found.select(*cols, F.get(F.lit([r.id for r in rules]), F.col("_hit")).alias("rule_id"))


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """rule_id, title, level, level_rank, rule_file, author, tags, status, rule_date, rule_modified: as many rows as there are rules."""
    text = lambda r, key: str(r.doc[key]) if r.doc.get(key) else None
    rows = [(r.id, r.title, r.level, r.rank, r.path, str(r.doc.get("author") or ""), r.tags, str(r.doc.get("details") or ""), text(r, "status"), text(r, "date"), text(r, "modified")) for r in rules]
    return F.broadcast(spark.createDataFrame(rows, "rule_id string, title string, level string, level_rank int, rule_file string, author string, tags array<string>, details string, status string, rule_date string, rule_modified string"))


def group_key(keys: tuple[str, ...], fields: Fields) -> Column:
    """Values of the keys, joined; a missing one is _."""
    if not keys:
        return F.lit("_")
    return F.concat_ws(",", *[F.coalesce(fields.value(k), F.lit("_")) for k in keys])


_WINDOW = "rule_id string, key string, count bigint, values array<string>, start_ns bigint, end_ns bigint, computers array<string>, channels array<string>, event_ids array<string>, files array<string>"
_COMPARE = {"==": operator.eq, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}


def greedy_windows(ns: list[int], frame: int, op: str, number: int, values: list | None = None, until: int | None = None) -> list[tuple[int, int, int]]:
    """(first, end, count) of windows over times in order: each is as long as the frame allows; one that
    satisfies the comparison ends there, else its first record goes. values: count distinct ones instead.
    until: only windows whose frame ends before that time, which are settled once no earlier record can come."""
    n, left, right = len(ns), 0, 0
    out, seen = [], {}
    compare = _COMPARE[op]
    while left < n and (until is None or ns[left] + frame * 1_000_000_000 < until):
        while right < n and ns[right] - ns[left] <= frame * 1_000_000_000:
            if values is not None:
                seen[values[right]] = seen.get(values[right], 0) + 1
            right += 1
        count = len(seen) if values is not None else right - left
        if compare(count, number):
            out.append((left, right, count))
            seen, left = {}, right
        else:
            if values is not None and left < right:
                seen[values[left]] -= 1
                if not seen[values[left]]:
                    del seen[values[left]]
            left += 1
            right = max(right, left)
    return out


def by_rule(rules: list[Rule], make, kind: str) -> Column:
    """A column that depends on the row's rule: one flat choice, whose depth does not grow with the rules."""
    out = F.when(F.lit(False), F.lit(None).cast(kind))
    for r in rules:
        out = out.when(F.col("rule_id") == r.id, make(r))
    return out


def windows(matches: DataFrame, rules: list[Rule], fields: Fields) -> DataFrame:
    """Windows of all count rules over their matches, in one pass.

    The records that rules have matched are written once. Keys of more than split_windows.HOT_ROWS records are cut into bins of time, a task each. Of the others, times further
    apart than the frame can never share a window, so a key's records fall into sessions that are judged apart. Without a frame the whole key is one window's span,
    in one task.
    """
    rules = [r for r in rules if r.count is not None]
    terms = {r.id: (r.frame, r.count.op, r.count.number, r.count.field is not None) for r in rules}
    text = lambda r: F.coalesce(fields.value(r.count.field), F.lit("")) if r.count.field else F.lit(None).cast("string")
    rows = matches.where(F.col("rule_id").isin(list(terms))).select(
        "rule_id", by_rule(rules, lambda r: group_key(r.count.by, fields), "string").alias("key"), by_rule(rules, text, "string").alias("value"),
        F.coalesce("event_ts_ns", F.lit(220_924_800_000_000_000)).alias("ns"), "record_id", "computer", "channel", "event_id", "source_file",
        by_rule(rules, lambda r: F.lit(r.frame), "bigint").alias("frame"),
    )
    rows = scratch.written(rows, "counted")
    schema = pa.schema([(n, pa.list_(pa.string()) if "array" in t else pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split(" ", 1) for x in _WINDOW.split(", "))])
    hot, cut = scratch.written(split_windows.hot_keys(rows), "hot-keys"), None
    if not hot.isEmpty():  # fewer than the records by HOT_ROWS
        how = {r: (frame, _COMPARE[op], number, distinct) for r, (frame, op, number, distinct) in terms.items()}
        cut = split_windows.hot_windows(rows, hot, how, schema, _WINDOW)
        rows = rows.join(F.broadcast(hot), ["rule_id", "key"], "left_anti")
    order = Window.partitionBy("rule_id", "key").orderBy("ns", "record_id", "source_file")
    gap = F.col("ns") - F.lag("ns").over(order) > F.col("frame") * 1_000_000_000
    rows = rows.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int"))
    rows = rows.withColumn("session", F.sum("gap").over(order)).drop("gap", "frame")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sessions come one after another, in the order of their times."""
        held: dict[str, list] = {}
        current = None

        def close() -> Iterator[dict]:
            rule_id, key, _ = current
            frame, op, number, distinct = terms[rule_id]
            ns = held["ns"]
            if frame is None:
                frame = ns[-1] // 1_000_000_000 - ns[0] // 1_000_000_000
            for a, b, count in greedy_windows(ns, frame, op, number, held["value"] if distinct else None):
                texts = lambda c: sorted({x for x in held[c][a:b] if x is not None})  # noqa: E731, B023
                yield {"rule_id": rule_id, "key": key, "count": count, "values": texts("value") if distinct else [], "start_ns": ns[a], "end_ns": ns[b - 1], "computers": texts("computer"), "channels": texts("channel"), "event_ids": texts("event_id"), "files": texts("source_file")}

        for batch in batches:
            found = []
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            marks = list(zip(cols["rule_id"], cols["key"], cols["session"]))
            at = 0
            while at < len(marks):
                end = at
                while end < len(marks) and marks[end] == marks[at]:
                    end += 1
                if marks[at] != current:
                    if current is not None:
                        found += close()
                    current, held = marks[at], {c: [] for c in cols}
                for c, v in cols.items():
                    held[c] += v[at:end]
                at = end
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist(list(close()), schema=schema)

    # The window has brought each key's rows together and in order; the sort states it and costs nothing more.
    found = rows.sortWithinPartitions("rule_id", "key", "ns", "record_id", "source_file").mapInArrow(judge, _WINDOW)
    return found if cut is None else found.unionByName(cut)


def count_text(rule: Rule) -> Column:
    """Count:n, the counted field's values and the keys' values, as one text."""
    c = rule.count
    parts = [F.concat(F.lit("Count:"), F.col("count").cast("string"))]
    if c.field:
        parts.append(F.concat(F.lit(f"{c.field}:"), F.array_join(F.array_sort("values"), "/")))
    if c.by:
        parts.append(F.concat(F.lit(f"{','.join(c.by)}:"), F.col("key")))
    return F.concat_ws(C.SEPARATOR, *parts)


def temporal(results: DataFrame, base: str, others: list[str], seconds: int, ordered: bool) -> DataFrame:
    """Results of the base rule with one of every other rule near in time and with the same key.

    Unordered: within `seconds` on either side. Ordered: each rule's earliest result not before the one before it, no later than
    `seconds` behind the base. Times meet in bins of the span, so the joins are by equality; a base without others never fires.
    """
    if not others:
        return results.where("false")
    width = max(1, seconds) * 1_000_000_000
    now = results.where(F.col("rule_id") == base).withColumn("_at", F.col("start_ns"))
    for i, other in enumerate(others):
        two = results.where(F.col("rule_id") == other).select(F.col("key").alias("_k"), F.col("start_ns").alias("_t"), F.floor(F.col("start_ns") / width).alias("_b"))
        bins = F.array(*[F.floor(F.col("start_ns") / width) + d for d in ((0, 1) if ordered else (-1, 0, 1))])
        near = now.withColumn("_bin", F.explode(bins))
        low = F.col("_at") if ordered else F.col("start_ns") - seconds * 1_000_000_000
        same = (F.col("key") == F.col("_k")) & (F.col("_bin") == F.col("_b")) & F.col("_t").between(low, F.col("start_ns") + seconds * 1_000_000_000)
        if ordered:
            hit = near.join(two, same).groupBy("key", "start_ns", "_at").agg(F.min("_t").alias("_next"))
            hit = hit.select(F.col("key").alias("_hk"), F.col("start_ns").alias("_hs"), F.col("_at").alias("_ha"), "_next")
            now = now.join(hit, (F.col("key") == F.col("_hk")) & (F.col("start_ns") == F.col("_hs")) & (F.col("_at") == F.col("_ha")))
            now = now.withColumn("_at", F.col("_next")).drop("_hk", "_hs", "_ha", "_next")
        else:
            hit = near.join(two, same, "left_semi").select(F.col("key").alias("_hk"), F.col("start_ns").alias("_hs")).distinct()
            now = now.join(hit, (F.col("key") == F.col("_hk")) & (F.col("start_ns") == F.col("_hs")), "left_semi")
    return now.drop("_at")


_OUT = ("rule_id", "event_ts", "event_ts_ns", "computer", "channel", "event_id", "record_id", "source_file", "agg_text", "event", "recovered")


def detect(records: DataFrame, rules: list[Rule], fields: Fields | None = None) -> DataFrame:
    """Detections of linked rules: plain hits, count windows and temporal correlations, with the rules' columns."""
    fields = fields or Fields()
    spark = records.sparkSession
    # Each rule is evaluated in one of the two branches alone, and each branch reads only its rules' channels and fields.
    hits = match(records, [r for r in rules if r.kind == "plain" and r.count is None], fields)
    if "recovered" not in hits.columns:
        hits = hits.withColumn("recovered", F.lit(None).cast("boolean"))
    out = [hits.withColumn("agg_text", F.lit(None).cast("string")).select(*_OUT)]
    join = lambda c: F.array_join(F.array_sort(c), C.SEPARATOR)

    def shown(df: DataFrame, text: Column, id_: Column) -> DataFrame:
        return df.select(
            id_.alias("rule_id"), F.timestamp_micros(F.floor(F.col("start_ns") / 1000)).alias("event_ts"), F.col("start_ns").alias("event_ts_ns"), join("computers").alias("computer"),
            join("channels").alias("channel"), join("event_ids").alias("event_id"), F.lit("-").alias("record_id"), join("files").alias("source_file"), text.alias("agg_text"), F.lit(None).cast("variant").alias("event"),
            F.lit(None).cast("boolean").alias("recovered"),
        )

    counted = [r for r in rules if r.count is not None]
    if counted:
        results = windows(match(records, counted, fields), counted, fields)
        if any(r.kind.startswith("temporal") for r in rules):
            results = scratch.written(results, "windows")  # read by each correlation; far smaller than the matches
        shown_rules = [r for r in counted if not r.hidden]
        if shown_rules:
            own = results.where(F.col("rule_id").isin([r.id for r in shown_rules]))
            out.append(shown(own, by_rule(shown_rules, count_text, "string"), F.col("rule_id")))
        for r in rules:
            if r.kind in ("temporal", "temporal_ordered") and r.refs:
                fired = temporal(results, r.refs[0], list(r.refs[1:]), r.frame, r.kind == "temporal_ordered")
                out.append(shown(fired, F.lit(None).cast("string"), F.lit(r.id)))
    table = rule_table(spark, [r for r in rules if not r.hidden])
    return reduce(DataFrame.unionByName, out).join(table, "rule_id")


#: What the timeline is ordered by; what ties then goes by what is shown.
ORDER = ("event_ts_ns", "level_rank", "event_id", "rule_file", "computer", "record_id")


def in_order(detections: DataFrame, keys: str | None = None) -> DataFrame:
    """The timeline's order; keys: a column that holds ORDER's columns, whose rows go by all other columns where they tie, from the left.

    A range sort reads its input once for the ranges and once more for the rows. Detections are shuffled as they are
    first, so both read them from there, and no rule is evaluated twice.
    """
    if keys:
        rest = [F.col(f"`{c}`") for c in detections.columns if c != keys]
        return detections.repartition(keys).orderBy(*[F.col(keys).getField(c) for c in ORDER], *rest)
    rest = [c for c in ("rule_id", "source_file", "agg_text", "details") if c in detections.columns]
    return detections.repartition("rule_id", "record_id", "source_file", "event_ts_ns").orderBy(*ORDER, *rest)


def without_duplicates(detections: DataFrame) -> DataFrame:
    """Detections that differ in their file alone become one, the first in order."""
    same = [c for c in detections.columns if c not in ("source_file", "event", "recovered")]
    first = Window.partitionBy(*[F.to_json(F.col(c)) if c == "tags" else F.col(c) for c in same]).orderBy("source_file")
    return detections.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
