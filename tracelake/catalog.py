"""Queries of the engine's own operators over the given tables, with the SQL that each is held against.

Records are made from the events table: every event is a log record with System and EventData. Each query has an oracle over
the same view of events (RECS).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import catalog_forms
from tracelake.engine import Engine
from tracelake.functions import columns as C
from tracelake.operators import base64_tokens, filters, match, metrics, render, search, sinks, summary
from tracelake.plans.rule import from_doc, link
from tracelake.plans.selection import Fields
from tracelake.sources import records as sources

ALIASES = {"EventID": "Event.System.EventID", "Channel": "Event.System.Channel", "Computer": "Event.System.Computer"}


def fields() -> Fields:
    return Fields(aliases=dict(ALIASES))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sources.spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    kind, user, number = F.col("event_type"), F.col("user_id"), F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    eid = F.when(kind == "view", 4624).when(kind == "error", 4625).when(kind == "purchase", 4688).when(kind == "signup", 4768).otherwise(7045)
    channel = F.when(kind == "click", "System").otherwise("Security")
    command = F.when(kind == "purchase", text("tool.exe -enc ", F.base64(text("payload number ", number).cast("binary")))).otherwise(text("tool.exe -run ", kind, " /k:", number % 50))
    data = F.struct(
        text("user", user).alias("TargetUserName"), text("svc", user % 7).alias("SubjectUserName"), text("DOM", user % 3).alias("TargetDomainName"), text("WS", user % 11).alias("WorkstationName"),
        text("10.", user % 4, ".", number % 256, ".", number % 200).alias("IpAddress"), F.floor(F.col("value") * 100 + 0.5).cast("string").alias("Amount"), command.alias("CommandLine"),
        (number % 12).cast("string").alias("LogonType"), F.when(number % 3 == 0, text("user", user)).otherwise(text("svc", user % 7)).alias("Caller"), F.when(number % 4 == 0, text("0x", F.hex(number))).alias("Code"),
    )
    system = F.struct(eid.alias("EventID"), channel.alias("Channel"), text("HOST-", user % 20).alias("Computer"), number.alias("EventRecordID"), F.when(kind == "error", 2).otherwise(4).alias("Level"))
    # Through a generator, so that the variant is made once a row and not once for every field that a query reads.
    event = F.explode_outer(F.array(F.to_variant_object(F.struct(F.struct(system.alias("System"), data.alias("EventData")).alias("Event")))))
    return e.select(
        text("log-", kind, ".evtx").alias("source_file"), number.cast("string").alias("record_id"), eid.cast("string").alias("event_id"), channel.alias("channel"), text("HOST-", user % 20).alias("computer"),
        text("prov-", kind).alias("provider"), F.timestamp_micros(micros).alias("event_ts"), (micros * 1000).alias("event_ts_ns"), F.lit(False).alias("recovered"), event.alias("event"),
    ).withColumn("data_string", F.to_json("event"))


RECS = r"""recs AS (
  SELECT 'log-' || event_type || '.evtx' AS source_file, event_id::VARCHAR AS record_id, event_id AS num, event_type AS kind, user_id AS uid,
    CASE event_type WHEN 'view' THEN '4624' WHEN 'error' THEN '4625' WHEN 'purchase' THEN '4688' WHEN 'signup' THEN '4768' ELSE '7045' END AS event_id,
    CASE event_type WHEN 'click' THEN 'System' ELSE 'Security' END AS channel, 'HOST-' || (user_id % 20) AS computer, epoch_us(ts) * 1000 AS ns,
    'user' || user_id AS target, 'svc' || (user_id % 7) AS subject, 'DOM' || (user_id % 3) AS dom, 'WS' || (user_id % 11) AS ws,
    '10.' || (user_id % 4) || '.' || (event_id % 256) || '.' || (event_id % 200) AS ip, floor(value * 100 + 0.5)::BIGINT AS amount,
    CASE WHEN event_type = 'purchase' THEN 'tool.exe -enc ' || to_base64(encode('payload number ' || event_id)) ELSE 'tool.exe -run ' || event_type || ' /k:' || (event_id % 50) END AS command,
    (event_id % 12)::VARCHAR AS logon_type, CASE WHEN event_id % 3 = 0 THEN 'user' || user_id ELSE 'svc' || (user_id % 7) END AS caller,
    CASE WHEN event_id % 4 = 0 THEN '0x' || upper(format('{:X}', event_id)) END AS code
  FROM events)"""


def rule(id_: str, detection: dict, level: str = "medium", **more) -> dict:
    return {"id": id_, "title": f"Rule {id_}", "level": level, "status": "test", "author": more.pop("author", "A, B"), "date": "2024-01-01", "logsource": {"category": "test"}, "detection": detection, **more}


def correlation(id_: str, level: str = "high", **body) -> dict:
    return {"id": id_, "title": f"Rule {id_}", "level": level, "status": "test", "author": "C", "date": "2024-01-01", "correlation": {k.replace("_", "-") if k == "group_by" else k: v for k, v in body.items()}}


def linked(*docs: dict):
    out = link([from_doc(d) for d in docs])
    if out.errors:
        raise ValueError(out.errors)
    return out.rules


#: id -> (detection, SQL): one rule for each form of a leaf or condition.
LEAVES: dict[str, tuple[dict, str]] = {
    "equal": ({"s": {"TargetUserName": "USER7"}}, "target = 'user7'"),
    "wild prefix": ({"s": {"TargetUserName": "user1*"}}, "target LIKE 'user1%'"),
    "wild inside": ({"s": {"CommandLine": "tool*view*?:7"}}, r"regexp_full_match(command, 'tool.*view.*[^\n]:7')"),
    "startswith": ({"s": {"CommandLine|startswith": "TOOL.EXE -r"}}, "command LIKE 'tool.exe -r%'"),
    "endswith": ({"s": {"CommandLine|endswith": "/K:9"}}, "command LIKE '%/k:9'"),
    "contains": ({"s": {"CommandLine|contains": "Signup"}}, "command LIKE '%signup%'"),
    "contains cased": ({"s": {"CommandLine|contains|cased": "Signup"}}, "command LIKE '%Signup%'"),
    "contains all": ({"s": {"CommandLine|contains|all": ["run", "click", ":1"]}}, "command LIKE '%run%' AND command LIKE '%click%' AND command LIKE '%:1%'"),
    "contains any": ({"s": {"CommandLine|contains": ["click", ":11"]}}, "command LIKE '%click%' OR command LIKE '%:11%'"),
    "windash": ({"s": {"CommandLine|contains|windash": " -run error"}}, "command LIKE '% -run error%'"),
    "regex": ({"s": {"CommandLine|re": r"k:4\d$"}}, r"regexp_matches(command, 'k:4\d$')"),
    "regex flags": ({"s": {"CommandLine|re|i": "TOOL.*VIEW"}}, "regexp_matches(command, '(?i)TOOL.*VIEW')"),
    "exists": ({"s": {"Code|exists": True}}, "code IS NOT NULL"),
    "absent": ({"s": {"Code": None}}, "code IS NULL"),
    "same field": ({"s": {"Caller|equalsfield": "TargetUserName"}}, "caller = target"),
    "field in field": ({"s": {"Caller|fieldref|startswith": "SubjectUserName"}}, "starts_with(caller, subject)"),
    "network": ({"s": {"IpAddress|cidr": "10.2.64.0/18"}}, "ip LIKE '10.2.%' AND split_part(ip, '.', 3)::INT BETWEEN 64 AND 127"),
    "greater": ({"s": {"Amount|gt": 20000}}, "amount > 20000"),
    "at most": ({"s": {"Amount|lte": 150}}, "amount <= 150"),
    # Of the last character only the bits that no neighbour changes are compared: any digit can follow the 1.
    "base64": ({"s": {"CommandLine|base64offset|contains": "number 12"}}, "kind = 'purchase' AND num::VARCHAR LIKE '1_%'"),
    "not equal": ({"s": {"TargetUserName|neq": ["user1", "user2"]}}, "target NOT IN ('user1', 'user2')"),
    "length": ({"s": {"CommandLine": {"min_length": 25}}}, "strlen(command) >= 25"),
    "keywords": ({"k": ["HOST-13", "*WS9*"]}, "computer = 'HOST-13' OR ws = 'WS9'"),
    "id": ({"s": {"EventID": 4625}}, "event_id = '4625'"),
    "and not": ({"a": {"EventID": 4624}, "b": {"LogonType": ["3", "10"]}, "condition": "a and not b"}, "event_id = '4624' AND logon_type NOT IN ('3', '10')"),
    "all of": ({"sel_a": {"Channel": "Security"}, "sel_b": {"LogonType": "5"}, "condition": "all of sel_*"}, "channel = 'Security' AND logon_type = '5'"),
    "one of": ({"sel_a": {"EventID": 7045}, "sel_b": {"LogonType": "5"}, "x": {"TargetUserName|endswith": "1"}, "condition": "(1 of sel_*) and x"}, "(event_id = '7045' OR logon_type = '5') AND target LIKE '%1'"),
    "precedence": ({"a": {"EventID": 4625}, "b": {"LogonType": "1"}, "c": {"Amount|gte": 10000}, "condition": "a or b and not c"}, "event_id = '4625' OR logon_type = '1' AND NOT amount >= 10000"),
}


#: Lines of the files that rules name.
RULE_FILES = {"wanted.txt": [r"^tool\.exe -run", "", r"-enc"], "allowed.txt": ["view", r"k:1\d$"]}

#: More forms of a leaf, as LEAVES.
FORMS: dict[str, tuple[dict, str]] = {
    "keywords all": ({"k": {"|all": ["HOST-13", "*WS9*"]}}, "computer = 'HOST-13' AND ws = 'WS9'"),
    "keyword regex": ({"k": {"|re": r"HOST-1[37]\W"}}, "computer IN ('HOST-13', 'HOST-17')"),
    "ends as field": ({"s": {"Caller|fieldref|endswith": "TargetUserName"}}, "ends_with(caller, target)"),
    "endswithfield": ({"s": {"Caller|endswithfield": "SubjectUserName"}}, "ends_with(caller, subject)"),
    "contains field": ({"s": {"Caller|fieldref|contains": "SubjectUserName"}}, "contains(caller, subject)"),
    "base64 whole": ({"s": {"CommandLine|base64|contains": "payload number 123"}}, "kind = 'purchase' AND num::VARCHAR LIKE '123%'"),
    "utf16 bytes": ({"a": {"CommandLine|utf16le|base64offset|contains": "payload"}, "b": {"EventID": 4688}, "condition": "b and not a"}, "event_id = '4688'"),
    "wide bytes": ({"a": {"CommandLine|wide|base64offset|contains": "payload"}, "b": {"LogonType": "2"}, "condition": "a or b"}, "logon_type = '2'"),
    "regex files": ({"s": {"CommandLine": {"regexes": "wanted.txt", "allowlist": "allowed.txt"}}}, "command NOT LIKE '%view%' AND NOT regexp_matches(command, 'k:1[0-9]$')"),
    "allowlist": ({"s": {"CommandLine": {"allowlist": "allowed.txt"}}}, "command NOT LIKE '%view%' AND NOT regexp_matches(command, 'k:1[0-9]$')"),
    "value and length": ({"s": {"Amount": {"value": "1*", "min_length": 4}}}, "amount::VARCHAR LIKE '1%' AND strlen(amount::VARCHAR) >= 4"),
    "regex lines": ({"s": {"CommandLine|re|m": "^tool.*k:7$"}}, "command LIKE 'tool%k:7'"),
    "regex any": ({"s": {"CommandLine|re|s": "run.click"}}, "command LIKE '%run_click%'"),
    "all before contains": ({"s": {"CommandLine|all|contains": ["run", "click", ":1"]}}, "command LIKE '%run%' AND command LIKE '%click%' AND command LIKE '%:1%'"),
    "startswith cased": ({"s": {"TargetUserName|startswith|cased": ["user1", "USER2"]}}, "target LIKE 'user1%'"),
    "endswith cased": ({"s": {"CommandLine|endswith|cased": ["k:8", "K:9"]}}, "command LIKE '%k:8'"),
    "less": ({"s": {"Amount|lt": 100}}, "amount < 100"),
    "at least": ({"s": {"Amount|gte": 25000}}, "amount >= 25000"),
    "not there": ({"s": {"Code|exists": False}}, "code IS NULL"),
    "one letter": ({"s": {"WorkstationName": "WS?"}}, "ws LIKE 'WS_'"),
    "list of maps": ({"s": [{"EventID": 4625, "LogonType": "1"}, {"EventID": 7045, "LogonType": "2"}]}, "event_id = '4625' AND logon_type = '1' OR event_id = '7045' AND logon_type = '2'"),
    "not all of": ({"s_1": {"EventID": 4624}, "s_2": {"LogonType": "5"}, "condition": "not all of s_*"}, "NOT (event_id = '4624' AND logon_type = '5')"),
    "nested": ({"a": {"EventID": 4625}, "b": {"LogonType": "1"}, "c": {"Amount|gte": 10000}, "condition": "(a or b) and not (b and c)"}, "(event_id = '4625' OR logon_type = '1') AND NOT (logon_type = '1' AND amount >= 10000)"),
}


def timeline_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = [rule(k, d, "low") for k, (d, _) in FORMS.items()]
    own = Fields(aliases=dict(ALIASES), files=lambda name: RULE_FILES[name])
    return match.detect(records(spark, sf_dir), linked(*docs), own).select("rule_id", F.col("event_ts_ns").alias("ns"), "computer", "event_id", "record_id")


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of hundreds over one scan, counted by rule."""
    docs = [rule(f"m{k}", {"s": {"TargetUserName": f"user{k}"}, "t": {"LogonType": str(k % 12)}, "condition": "s and not t"}, "low", details=f"number {k}: %TargetUserName%") for k in range(300)]
    rules = linked(*docs)
    found = render.details(match.detect(records(spark, sf_dir), rules, fields()), fields(), rules)
    return found.groupBy("rule_id", "details").agg(F.count("*").alias("total"))


def time_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select("record_id", *[C.format_time(F.col("event_ts"), style).alias(name) for style, name in (("default", "plain"), ("European", "european"), ("ISO-8601", "iso"), ("RFC-3339", "rfc3339"), ("US", "us"), ("US military", "us_military"))], C.duration(F.col("record_id").cast("bigint") * 7).alias("duration"))


def abbreviated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select("record_id", render.abbreviate(F.col("channel"), {"Security": "Sec", "system": "Sys"}).alias("channel"), render.abbreviate(F.col("provider"), {"prov-view": "PV"}, {"prov": "p", "-c": "_C"}).alias("provider"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = [rule(k, d, ("low", "medium", "high")[i % 3]) for i, (k, (d, _)) in enumerate(LEAVES.items())]
    found = match.detect(records(spark, sf_dir), linked(*docs), fields())
    return match.in_order(found).select("rule_id", "level", F.col("event_ts_ns").alias("ns"), "computer", "channel", "event_id", "record_id", "source_file")


def _hits_sql() -> str:
    levels = ("low", "medium", "high")
    return " UNION ALL ".join(f"SELECT '{k}' AS rule_id, '{levels[i % 3]}' AS level, * FROM recs WHERE {sql}" for i, (k, (_, sql)) in enumerate(LEAVES.items()))


HITS = f"{RECS}, hits AS ({_hits_sql()})"


def _windows_sql(source: str, key: str, frame: int, test: str, value: str | None = None) -> str:
    """CTEs ending in wins(key, ns, n, last_ns): greedy windows over source rows by key."""
    count = f"count(DISTINCT b.{value})" if value else "count(*)"
    return f"""
numbered AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY ns, record_id) AS i FROM {source}),
reach AS (SELECT a.k, a.i, a.ns, {count} AS n, max(b.i) AS j, max(b.ns) AS last_ns FROM numbered a JOIN numbered b ON a.k = b.k AND b.i >= a.i AND b.ns - a.ns <= {frame}::BIGINT * 1000000000 GROUP BY ALL),
walk(k, i) AS (
  SELECT DISTINCT k, 1::BIGINT FROM numbered UNION ALL
  SELECT w.k, CASE WHEN r.n {test} THEN r.j + 1 ELSE w.i + 1 END FROM walk w JOIN reach r ON w.k = r.k AND w.i = r.i),
wins AS (SELECT r.k AS key, r.ns, r.n, r.last_ns FROM walk w JOIN reach r ON w.k = r.k AND w.i = r.i WHERE r.n {test})"""


def _count_query(detection: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = linked(rule("count", detection))
        f = fields()
        w = match.windows(match.match(records(spark, sf_dir), rules, f), rules, f)
        return w.select("key", "count", "start_ns", "end_ns")

    return run


BURST = {"s": {"EventID": 4625}, "condition": "s | count() by Computer >= 3", "timeframe": "6h"}
SPREAD = {"s": {"Channel": "Security"}, "condition": "s | count(TargetUserName) by SubjectUserName >= 3", "timeframe": "30m"}
FEW = {"s": {"EventID": 4768}, "condition": "s | count() by Computer <= 2", "timeframe": "4h"}


def _pair(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = [rule("first", {"s": {"EventID": 4625}}), rule("second", {"s": {"EventID": 4624}}), correlation("both", type=kind, rules=["first", "second"], timespan="20m", group_by=["Computer"])]
        out = match.detect(records(spark, sf_dir), linked(*docs), fields())
        return out.select("rule_id", F.col("event_ts_ns").alias("ns"), "computer", "level")

    return run


def _pair_sql(ordered: bool) -> str:
    one = lambda name, eid: f"{name} AS (SELECT *, computer AS k, row_number() OVER (PARTITION BY computer ORDER BY ns, record_id) AS i FROM recs WHERE event_id = '{eid}')"
    walk = lambda n: f"r{n} AS (SELECT a.k, a.i, a.ns, max(b.i) AS j FROM n{n} a JOIN n{n} b ON a.k = b.k AND b.i >= a.i AND b.ns - a.ns <= 1200000000000 GROUP BY ALL), w{n}(k, i) AS (SELECT DISTINCT k, 1::BIGINT FROM n{n} UNION ALL SELECT w.k, r.j + 1 FROM w{n} w JOIN r{n} r ON w.k = r.k AND w.i = r.i), t{n} AS (SELECT r.k, r.ns FROM w{n} w JOIN r{n} r ON w.k = r.k AND w.i = r.i)"
    near = "t2.ns BETWEEN t1.ns AND t1.ns + 1200000000000" if ordered else "abs(t2.ns - t1.ns) <= 1200000000000"
    return f"WITH RECURSIVE {RECS}, {one('n1', 4625)}, {one('n2', 4624)}, {walk(1)}, {walk(2)} SELECT 'both' AS rule_id, ns, k AS computer, 'high' AS level FROM t1 WHERE EXISTS (SELECT 1 FROM t2 WHERE t2.k = t1.k AND {near})"


def event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = [rule("a", {"s": {"EventID": 4625}}), rule("b", {"s": {"EventID": 7045}}), correlation("sum", type="event_count", rules=["a", "b"], timespan="2h", group_by=["Computer"], condition={"gte": 3})]
    out = match.detect(records(spark, sf_dir), linked(*docs), fields())
    return out.select("rule_id", F.col("event_ts_ns").alias("ns"), "computer", "agg_text")


def value_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = [rule("a", {"s": {"EventID": 4624}}), correlation("users", type="value_count", rules=["a"], timespan="3h", group_by=["TargetDomainName"], condition={"gte": 3, "field": "TargetUserName"})]
    rules = linked(*docs)
    f = fields()
    return match.windows(match.match(records(spark, sf_dir), rules, f), rules, f).select("key", "count", "start_ns", "end_ns")


def record_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = filters.computers(records(spark, sf_dir), include=["HOST-1", "HOST-2", "HOST-3"], exclude=["HOST-2"])
    r = filters.event_ids(r, exclude=["4768"])
    r = filters.time_range(r, "2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z")
    r = filters.channels(filters.valid_channel(filters.target_ids(r, ["4624", "4625", "4688"])), include=["security"])
    return filters.file_names(r, exclude=["*PURCHASE*"]).select("record_id", "computer", "event_id", "channel")


def eid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = spark.createDataFrame([("Security", "4624", "Logon"), ("Security", "4625", "Failed logon")], "channel string, event_id string, title string")
    return metrics.event_id_counts(records(spark, sf_dir), titles)


def logon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.logons(records(spark, sf_dir))
    times = [c for c in out.columns if c.startswith(("first", "last"))]
    return out.select(*[F.unix_micros(c).alias(c) if c in times else F.col(c) for c in out.columns])


def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.logs(records(spark, sf_dir))
    return out.select("source_file", "events", F.unix_micros("first_time").alias("first_time"), F.unix_micros("last_time").alias("last_time"), "computers", "channels", "providers")


def computer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.computers(records(spark, sf_dir)).select("computer", "events")


def time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.time_span(records(spark, sf_dir)).select("total", F.unix_micros("first_time").alias("first_time"), F.unix_micros("last_time").alias("last_time"))


def critical_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.critical_systems(records(spark, sf_dir))


def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(records(spark, sf_dir), ["HOST-3", "k:4"], filters=["TargetUserName: user*"], every=True, fields=fields())
    return found.select("computer", "channel", "event_id", "record_id", "all_fields", "source_file")


def extract_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base64_tokens.extract(records(spark, sf_dir)).select("computer", "base64", "decoded", "original_field", F.col("length").cast("bigint").alias("length"), "is_binary", "double_encoding", "encoding", "event", "record_id")


def pivot_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields()
    hits = match.match(records(spark, sf_dir), linked(rule("p", {"s": {"EventID": 4625}})), f)
    return summary.pivot_keywords(hits, {"Users": ["TargetUserName", "SubjectUserName"], "Hosts": ["WorkstationName"]}, f)


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = [rule(k, d, ("low", "medium", "high")[i % 3], author=f"A{i % 4}, B{i % 3}", tags=["attack.execution", f"attack.t10{i}"] if i % 2 else []) for i, (k, (d, _)) in enumerate(LEAVES.items())]
    return match.detect(records(spark, sf_dir), linked(*docs), fields())


def summary_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_level(_detections(spark, sf_dir))


def summary_computers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_computers(_detections(spark, sf_dir))


def summary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_rules(_detections(spark, sf_dir))


def summary_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.busiest_date(_detections(spark, sf_dir)).select("level", F.col("day").cast("string").alias("day"), "total")


def summary_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.authors(_detections(spark, sf_dir))


def summary_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.tactics(_detections(spark, sf_dir), {"attack.execution": "Exec"})


def data_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.data_reduction(_detections(spark, sf_dir), records(spark, sf_dir).count())


def hit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = metrics.histogram(F.col("event_ts"), "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z", 30)
    return _detections(spark, sf_dir).groupBy(at.alias("bin")).agg(F.count("*").alias("hits"))


def duplicate_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = match.detect(records(spark, sf_dir), linked(rule("d", {"s": {"EventID": 4625}})), fields())
    twice = d.unionByName(d.withColumn("source_file", F.concat(F.lit("copy-"), "source_file")))
    return match.without_duplicates(twice).select("rule_id", "record_id", "source_file")


def duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("record_id", "event_ts_ns", "event_id")
    return metrics.without_duplicate_records(r.unionByName(r)).groupBy("event_id").agg(F.count("*").alias("total"))


def detail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = linked(rule("t", {"s": {"EventID": 4624}}, details="User: %TargetUserName% ¦ Code: %Code% ¦ IP: %IpAddress%"), rule("u", {"s": {"EventID": 7045}}))
    found = render.details(match.detect(records(spark, sf_dir), rules, fields()), fields(), rules)
    return found.select("rule_id", "record_id", "details")


def extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = F.concat(F.lit("User: "), C.scalar(F.col("event"), "Event.EventData.TargetUserName"), F.lit(" ¦ Cmd: "), C.scalar(F.col("event"), "Event.EventData.CommandLine"))
    return records(spark, sf_dir).select("record_id", render.extra_fields(F.col("event"), details).alias("extra"))


def mapped_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that stand in other keys' words, keys inside keys, and keys of some providers alone."""
    rules = [
        {"Channel": "Security", "EventID": [4624, 4625], "RewriteFieldData": {"LogonType": [{"11": "CACHED 1"}, {"3": "NETWORK"}, {"1": "3"}], "Caller": [{"user": "svc"}, {"svc": "user"}, {"user1": "never"}]}, "HexToDecimal": ["Code"]},
        {"Channel": "SYSTEM", "EventID": 7045, "Provider_Name": ["prov-click"], "RewriteFieldData": {"logontype": [{"1": "one "}]}},
        {"Channel": "Security", "EventID": 4688, "Provider_Name": "prov-view", "RewriteFieldData": {"LogonType": [{"1": "never"}]}},
    ]
    get = lambda name: render.mapped(C.scalar(F.col("event"), f"Event.EventData.{name}"), name, rules)
    return records(spark, sf_dir).select("record_id", get("LogonType").alias("logon_type"), get("Code").alias("code"), get("Caller").alias("caller"))


def mapped_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's columns with mapped values and abbreviations, in details, all fields and extra fields."""
    engine = Engine(
        spark, fields(), mapping=render.Mapping([{"Channel": "Security", "EventID": 4625, "RewriteFieldData": {"SubjectUserName": [{"svc1": "svc2"}, {"svc2": "svc3"}], "LogonType": [{"1": "2"}, {"2": "3"}]}, "HexToDecimal": ["Code"]}]),
        abbreviations=render.Abbreviations({"security": "Sec"}, {"prov-error": "PE"}, {"sec": "S", "P": "p"}),
    )
    rules = linked(rule("t", {"s": {"EventID": 4625}}, details="Who: %SubjectUserName% ¦ Type: %LogonType%"))
    profile = {"id": "%RecordID%", "channel": "%Channel%", "details": "%Details%", "extra": "%ExtraFieldInfo%"}
    return engine.timeline(records(spark, sf_dir), rules, profile, ordered=False)


def critical_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).withColumn("level_rank", render.uplift(F.col("level_rank"), F.col("computer"), ["HOST-1", "HOST-4"]))
    return d.groupBy(render.level_short(F.col("level_rank")).alias("level")).agg(F.count("*").alias("total"))


def ip_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("record_id", F.regexp_replace(C.scalar(F.col("event"), "Event.EventData.IpAddress"), r"^10\.([12])\.", "8.$1.").alias("ip"))
    ranges = spark.createDataFrame([(0x08010000, 0x0801FFFF, "AS1", "X", "a"), (0x08020000, 0x080280FF, "AS2", "Y", "b")], "first long, last long, asn string, country string, city string")
    return render.places(rows, "ip", ranges, "src")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select(F.col("record_id").alias("RecordID"), F.col("computer").alias("Computer"), F.concat(F.lit("User: "), C.scalar(F.col("event"), "Event.EventData.TargetUserName"), F.lit(" ¦ Amount: "), C.scalar(F.col("event"), "Event.EventData.Amount")).alias("Details"))
    return sinks.json_line(rows)


def repeated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = records(spark, sf_dir).groupBy("channel", "event_id").agg(F.count("*").alias("total"))
    return render.mark_repeats(totals, ["channel"], ["channel", "event_id"])


def marked_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline in order, with DUP for details that repeat those of the row before; lines of JSON, each with its number."""
    rules = linked(rule("t", {"s": {"EventID": 4625}}, details="Who: %SubjectUserName%"), rule("u", {"s": {"LogonType": "3"}}, level="high", details="Who: %SubjectUserName%"))
    shown = Engine(spark, fields()).timeline(records(spark, sf_dir), rules, {"RecordID": "%RecordID%", "RuleID": "%RuleID%", "Details": "%Details%"}, mark="json")
    return sinks.json_line(shown)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "timeline": timeline, "timeline_forms": timeline_forms, "many_rules": many_rules, "time_styles": time_styles, "abbreviated": abbreviated, "count_burst": _count_query(BURST), "count_distinct": _count_query(SPREAD), "count_few": _count_query(FEW), "event_count": event_count, "value_count": value_count,
        "temporal": _pair("temporal"), "temporal_ordered": _pair("temporal_ordered"), "record_filters": record_filters, "eid_metrics": eid_metrics, "logon_summary": logon_summary, "log_metrics": log_metrics,
        "computer_metrics": computer_metrics, "time_span": time_span, "critical_systems": critical_systems, "search": search_keywords, "extract_base64": extract_base64, "pivot_keywords": pivot_keywords,
        "summary_levels": summary_levels, "summary_computers": summary_computers, "summary_rules": summary_rules, "summary_dates": summary_dates, "summary_authors": summary_authors, "summary_tactics": summary_tactics,
        "data_reduction": data_reduction, "hit_histogram": hit_histogram, "duplicate_detections": duplicate_detections, "duplicate_records": duplicate_records, "detail_texts": detail_texts, "extra_fields": extra_fields,
        "mapped_codes": mapped_codes, "mapped_timeline": mapped_timeline, "critical_levels": critical_levels, "ip_places": ip_places, "json_lines": json_lines, "repeated_values": repeated_values, "marked_timeline": marked_timeline,
    } | catalog_forms.QUERIES


_LEAF_LIST = "['Amount: ' || amount, 'Caller: ' || caller, 'Code: ' || code, 'CommandLine: ' || command, 'IpAddress: ' || ip, 'LogonType: ' || logon_type, 'SubjectUserName: ' || subject, 'TargetDomainName: ' || dom, 'TargetUserName: ' || target, 'WorkstationName: ' || ws]"
_ALL = f"array_to_string(list_filter({_LEAF_LIST}, lambda x: x IS NOT NULL), ' ¦ ')"
_SHOWN = "[target, command]"
_EXTRA_MAPPED = ", ".join(f"CASE WHEN {c} NOT IN (who, kind_of) THEN '{n}: ' || {c} END" for n, c in (("Amount", "amount::VARCHAR"), ("Caller", "caller"), ("Code", "CASE WHEN code IS NOT NULL THEN num::VARCHAR END"), ("CommandLine", "command"), ("IpAddress", "ip"), ("TargetDomainName", "dom"), ("TargetUserName", "target"), ("WorkstationName", "ws")))


def oracles() -> dict[str, str]:
    top = lambda inner, ties: f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY total DESC, {ties}) AS r FROM ({inner})) WHERE r <= 5"
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in metrics.LOGON_TYPES.items())
    authors = " UNION ALL ".join(f"SELECT '{k}' AS rule_id, ['A{i % 4}', 'B{i % 3}'] AS own, {str(bool(i % 2)).lower()} AS tagged" for i, k in enumerate(LEAVES))
    list_without = "list_filter([" + ", ".join(f"CASE WHEN {c} NOT IN (target, command) THEN '{n}: ' || {c} END" for n, c in (("Amount", "amount::VARCHAR"), ("Caller", "caller"), ("Code", "code"), ("IpAddress", "ip"), ("LogonType", "logon_type"), ("SubjectUserName", "subject"), ("TargetDomainName", "dom"), ("WorkstationName", "ws"))) + "], lambda x: x IS NOT NULL)"
    out = {
        "timeline": f"WITH {HITS} SELECT rule_id, level, ns, computer, channel, event_id, record_id, source_file FROM hits",
        "timeline_forms": f"WITH {RECS} " + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, ns, computer, event_id, record_id FROM recs WHERE {sql}" for k, (_, sql) in FORMS.items()),
        "many_rules": f"WITH {RECS} SELECT 'm' || substr(target, 5) AS rule_id, 'number ' || substr(target, 5) || ': ' || target AS details, count(*) AS total FROM recs WHERE substr(target, 5)::INT < 300 AND logon_type <> (substr(target, 5)::INT % 12)::VARCHAR GROUP BY target",
        "time_styles": f"WITH {RECS}, t AS (SELECT record_id, num, make_timestamp(ns // 1000) AS ts FROM recs) SELECT record_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g +00:00') AS plain, strftime(ts, '%d-%m-%Y %H:%M:%S.%g +00:00') AS european, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S.%f+00:00') AS rfc3339, strftime(ts, '%m-%d-%Y %I:%M:%S.%g %p +00:00') AS us, strftime(ts, '%m-%d-%Y %H:%M:%S.%g +00:00') AS us_military, printf('%02d:%02d:%02d', num * 7 // 3600, num * 7 // 60 % 60, num * 7 % 60) AS duration FROM t",
        "abbreviated": f"WITH {RECS} SELECT record_id, CASE channel WHEN 'Security' THEN 'Sec' ELSE 'Sys' END AS channel, CASE kind WHEN 'view' THEN 'PV' ELSE replace('p-' || kind, '-c', '_C') END AS provider FROM recs",
        "count_burst": f"WITH RECURSIVE {RECS}, src AS (SELECT * FROM recs WHERE event_id = '4625'), {_windows_sql('src', 'computer', 21600, '>= 3')} SELECT key, n AS count, ns AS start_ns, last_ns AS end_ns FROM wins",
        "count_distinct": f"WITH RECURSIVE {RECS}, src AS (SELECT * FROM recs WHERE channel = 'Security'), {_windows_sql('src', 'subject', 1800, '>= 3', 'target')} SELECT key, n AS count, ns AS start_ns, last_ns AS end_ns FROM wins",
        "count_few": f"WITH RECURSIVE {RECS}, src AS (SELECT * FROM recs WHERE event_id = '4768'), {_windows_sql('src', 'computer', 14400, '<= 2')} SELECT key, n AS count, ns AS start_ns, last_ns AS end_ns FROM wins",
        "event_count": f"WITH RECURSIVE {RECS}, src AS (SELECT * FROM recs WHERE event_id IN ('4625', '7045')), {_windows_sql('src', 'computer', 7200, '>= 3')} SELECT 'sum' AS rule_id, ns, key AS computer, 'Count:' || n || ' ¦ Computer:' || key AS agg_text FROM wins",
        "value_count": f"WITH RECURSIVE {RECS}, src AS (SELECT * FROM recs WHERE event_id = '4624'), {_windows_sql('src', 'dom', 10800, '>= 3', 'target')} SELECT key, n AS count, ns AS start_ns, last_ns AS end_ns FROM wins",
        "temporal": _pair_sql(False), "temporal_ordered": _pair_sql(True),
        "record_filters": f"WITH {RECS} SELECT record_id, computer, event_id, channel FROM recs WHERE computer IN ('HOST-1', 'HOST-3') AND event_id IN ('4624', '4625') AND ns BETWEEN epoch_us(TIMESTAMP '2024-01-05') * 1000 AND epoch_us(TIMESTAMP '2024-01-20 12:00:00') * 1000",
        "eid_metrics": f"WITH {RECS} SELECT event_id, lower(channel) AS channel, count(*) AS total, round(count(*) / (SELECT count(*) FROM recs) * 1000) / 10 AS percent, CASE event_id WHEN '4624' THEN 'Logon' WHEN '4625' THEN 'Failed logon' ELSE 'Unknown' END AS title FROM recs GROUP BY event_id, lower(channel)",
        "logon_summary": f"WITH {RECS} SELECT 'Sec ' || event_id AS event, target AS dst_user, dom AS dst_domain, computer, CASE logon_type {names} ELSE logon_type END AS logon_type, subject AS src_user, '-' AS src_domain, ws AS src_computer, ip AS src_ip, count(*) FILTER (event_id = '4624') AS successes, count(*) FILTER (event_id = '4625') AS failures, min(ns) FILTER (event_id = '4624') // 1000 AS first_success, max(ns) FILTER (event_id = '4624') // 1000 AS last_success, min(ns) FILTER (event_id = '4625') // 1000 AS first_failure, max(ns) FILTER (event_id = '4625') // 1000 AS last_failure FROM recs WHERE event_id IN ('4624', '4625') GROUP BY ALL",
        "log_metrics": f"WITH {RECS} SELECT source_file, count(*) AS events, min(ns) // 1000 AS first_time, max(ns) // 1000 AS last_time, array_to_string(list_sort(list(DISTINCT computer)), ' ¦ ') AS computers, array_to_string(list_sort(list(DISTINCT channel)), ' ¦ ') AS channels, array_to_string(list_sort(list(DISTINCT 'prov-' || kind)), ' ¦ ') AS providers FROM recs GROUP BY source_file",
        "computer_metrics": f"WITH {RECS} SELECT computer, count(*) AS events FROM recs GROUP BY computer",
        "time_span": f"WITH {RECS} SELECT count(*) AS total, min(ns) // 1000 AS first_time, max(ns) // 1000 AS last_time FROM recs",
        "critical_systems": f"WITH {RECS} SELECT DISTINCT 'domain controller' AS kind, computer FROM recs WHERE event_id = '4768'",
        "search": f"WITH {RECS} SELECT computer, channel, event_id, record_id, {_ALL} AS all_fields, source_file FROM recs WHERE computer = 'HOST-3' AND command LIKE '%k:4%'",
        "extract_base64": f"WITH {RECS}, b AS (SELECT *, rtrim(split_part(command, ' ', 3), '=') AS tok, split_part(command, ' ', 3) AS whole FROM recs WHERE event_id = '4688') SELECT computer, whole AS base64, 'payload number ' || num AS decoded, 'tool.exe -enc <Base64String>' AS original_field, len('payload number ' || num)::BIGINT AS length, false AS is_binary, false AS double_encoding, 'UTF-8' AS encoding, 'Sec 4688' AS event, record_id FROM b",
        "pivot_keywords": f"WITH {RECS}, h AS (SELECT * FROM recs WHERE event_id = '4625') SELECT 'Users' AS category, target AS value FROM h UNION SELECT 'Users', subject FROM h UNION SELECT 'Hosts', ws FROM h",
        "summary_levels": f"WITH {HITS} SELECT level, count(*) AS total, count(DISTINCT rule_id) AS unique_rules FROM hits GROUP BY level",
        "summary_computers": f"WITH {HITS} " + top("SELECT level, computer, count(DISTINCT rule_id) AS total FROM hits GROUP BY ALL", "computer"),
        "summary_rules": f"WITH {HITS} " + top("SELECT level, 'Rule ' || rule_id AS title, count(*) AS total FROM hits GROUP BY ALL", "title"),
        "summary_dates": f"WITH {HITS}, d AS (SELECT level, make_timestamp(ns // 1000)::DATE::VARCHAR AS day, count(*) AS total FROM hits GROUP BY ALL) SELECT level, day, total FROM d QUALIFY row_number() OVER (PARTITION BY level ORDER BY total DESC, day) = 1",
        "summary_authors": f"WITH {HITS}, a AS ({authors}) SELECT author, count(*) AS rules FROM (SELECT rule_id, unnest(own) AS author FROM a WHERE rule_id IN (SELECT rule_id FROM hits)) GROUP BY author",
        "summary_tactics": f"WITH {HITS}, a AS ({authors}) SELECT 'Exec' AS tactic, computer, count(*) AS total, count(DISTINCT rule_id) AS unique_rules FROM hits JOIN a USING (rule_id) WHERE tagged GROUP BY computer",
        "data_reduction": f"WITH {HITS}, n AS (SELECT count(*) AS c FROM recs) SELECT count(DISTINCT (ns, event_id)) AS events_with_hits, any_value(c) AS events, round((any_value(c) - count(DISTINCT (ns, event_id))) / any_value(c) * 100, 2) AS reduction_percent FROM hits, n",
        "hit_histogram": f"WITH {HITS} SELECT least(floor((ns // 1000 - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0), 30)::BIGINT + 1 AS bin, count(*) AS hits FROM hits GROUP BY 1",
        "duplicate_detections": f"WITH {RECS} SELECT 'd' AS rule_id, record_id, least(source_file, 'copy-' || source_file) AS source_file FROM recs WHERE event_id = '4625'",
        "duplicate_records": f"WITH {RECS} SELECT event_id, count(*) AS total FROM recs GROUP BY event_id",
        "detail_texts": f"WITH {RECS} SELECT 't' AS rule_id, record_id, 'User: ' || target || ' ¦ Code: ' || coalesce(code, 'n/a') || ' ¦ IP: ' || ip AS details FROM recs WHERE event_id = '4624' UNION ALL SELECT 'u', record_id, {_ALL} FROM recs WHERE event_id = '7045'",
        "extra_fields": f"WITH {RECS} SELECT record_id, array_to_string({list_without}, ' ¦ ') AS extra FROM recs",
        # 10 and 11: a 1 behind nothing is a key, 11 has one inside that ends before it.
        "mapped_codes": f"WITH {RECS} SELECT record_id, CASE WHEN event_id IN ('4624', '4625') THEN CASE logon_type WHEN '1' THEN '3' WHEN '10' THEN '30' WHEN '11' THEN '33' WHEN '3' THEN 'NETWORK' ELSE logon_type END WHEN event_id = '7045' AND kind = 'click' THEN replace(logon_type, '1', 'one ') ELSE logon_type END AS logon_type, CASE WHEN event_id IN ('4624', '4625') AND code IS NOT NULL THEN num::VARCHAR ELSE code END AS code, CASE WHEN event_id IN ('4624', '4625') THEN CASE WHEN caller LIKE 'user%' THEN 'svc' || substr(caller, 5) ELSE 'user' || substr(caller, 4) END ELSE caller END AS caller FROM recs",
        "mapped_timeline": f"WITH {RECS}, m AS (SELECT *, CASE subject WHEN 'svc1' THEN 'svc2' WHEN 'svc2' THEN 'svc3' ELSE subject END AS who, CASE logon_type WHEN '1' THEN '2' WHEN '2' THEN '3' WHEN '10' THEN '20' WHEN '11' THEN '22' ELSE logon_type END AS kind_of FROM recs WHERE event_id = '4625') SELECT record_id AS id, 'S' AS channel, 'Who: ' || who || ' ¦ Type: ' || kind_of AS details, array_to_string(list_filter([{_EXTRA_MAPPED}], lambda x: x IS NOT NULL), ' ¦ ') AS extra FROM m",
        "critical_levels": f"WITH {HITS} SELECT CASE WHEN computer IN ('HOST-1', 'HOST-4') THEN CASE level WHEN 'low' THEN 'med' WHEN 'medium' THEN 'high' ELSE 'crit' END ELSE CASE level WHEN 'medium' THEN 'med' ELSE level END END AS level, count(*) AS total FROM hits GROUP BY 1",
        "ip_places": f"WITH {RECS}, i AS (SELECT record_id, regexp_replace(ip, '^10\\.([12])\\.', '8.\\1.') AS ip FROM recs), s AS (SELECT *, CASE WHEN ip LIKE '10.%' THEN 'p' WHEN ip LIKE '8.1.%' THEN 'x' WHEN split_part(ip, '.', 3)::INT <= 128 THEN 'y' ELSE 'n' END AS w FROM i) SELECT record_id, ip, CASE w WHEN 'p' THEN 'Private' WHEN 'x' THEN 'AS1' WHEN 'y' THEN 'AS2' ELSE '-' END AS src_asn, CASE w WHEN 'x' THEN 'X' WHEN 'y' THEN 'Y' ELSE '-' END AS src_country, CASE w WHEN 'x' THEN 'a' WHEN 'y' THEN 'b' ELSE '-' END AS src_city FROM s",
        "json_lines": f"""WITH {RECS} SELECT '{{"RecordID": ' || record_id || ', "Computer": "' || computer || '", "Details": {{"User": "' || target || '", "Amount": ' || amount || '}}}}' AS value FROM recs""",
        "marked_timeline": f"""WITH {RECS}, h AS (SELECT 't' AS rule_id, 3 AS lv, * FROM recs WHERE event_id = '4625' UNION ALL SELECT 'u', 4, * FROM recs WHERE logon_type = '3'), o AS (SELECT *, lag(subject) OVER (ORDER BY ns, lv, event_id, computer, record_id) AS prev FROM h) SELECT '{{"RecordID": ' || record_id || ', "RuleID": "' || rule_id || '", "Details": ' || CASE WHEN prev = subject THEN '"DUP"' ELSE '{{"Who": "' || subject || '"}}' END || '}}' AS value FROM o""",
        "repeated_values": f"WITH {RECS}, t AS (SELECT channel, event_id, count(*) AS total FROM recs GROUP BY ALL) SELECT CASE WHEN lag(channel) OVER (ORDER BY channel, event_id) = channel THEN 'DUP' ELSE channel END AS channel, event_id, total FROM t",
    }
    return out | catalog_forms.ORACLES
