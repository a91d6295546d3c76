"""More queries of the engine's operators: record kinds that the catalog's own view of events has not, exports, profiles, list items.

FORMS makes nine kinds of record of the events, by their number; each query has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.engine import Engine
from tracelake.functions import columns as C
from tracelake.operators import match, metrics, render, reports, search, sinks
from tracelake.plans.rule import from_doc, link
from tracelake.plans.selection import Fields
from tracelake.sources import records as sources

ALIASES = {"EventID": "Event.System.EventID", "Channel": "Event.System.Channel", "Computer": "Event.System.Computer"}
FORMS = r"""forms AS (
  SELECT event_id AS num, event_id % 9 AS kind, user_id AS uid, epoch_us(ts) * 1000 AS ns, 'HOST-' || (user_id % 20) AS computer,
    CASE event_id % 9 WHEN 0 THEN '4778' WHEN 1 THEN '4779' WHEN 2 THEN '21' WHEN 3 THEN '25' WHEN 4 THEN '1149' WHEN 5 THEN '302' WHEN 6 THEN '6009' WHEN 7 THEN '6013' ELSE '5145' END AS eid FROM events)"""


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sources.spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    n, user = F.col("event_id"), F.col("user_id")
    kind = n % 9
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    ids = (4778, 4779, 21, 25, 1149, 302, 6009, 6013, 5145)
    eid = F.element_at(F.array(*[F.lit(x) for x in ids]), (kind + 1).cast("int"))
    channel = F.when(kind.isin(0, 1, 8), metrics.SECURITY).when(kind.isin(2, 3), metrics.LSM).when(kind == 4, metrics.RCM).when(kind == 5, metrics.GATEWAY).otherwise("System")
    named = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    who, where = _text("user", user), _text("10.0.0.", n % 250)
    session = named(AccountName=who, AccountDomain=_text("DOM", user % 3), ClientName=_text("WS", user % 11), ClientAddress=where)
    bodies = [
        (kind.isin(0, 1), named(EventData=session)), (kind == 2, named(UserData=named(EventXML=named(User=_text("DOM", user % 3, "\\", who), Address=where)))), (kind == 3, named(UserData=named(EventXML=named(User=who, Address=where)))),
        (kind == 4, named(UserData=named(EventXML=named(Param1=who, Param2=_text("DOM", user % 3), Param3=where)))), (kind == 5, named(UserData=named(EventInfo=named(Username=_text("GW\\", who), IpAddress=where)))),
        (kind == 6, named(EventData=named(Data=F.array(F.lit("10.00."), _text("190", user % 4), F.lit(""))))), (kind == 7, named(EventData=named(Data=F.array(*[F.lit("")] * 4, _text(n % 1000), F.lit("60"), _text("-", user % 12 * 60, " Zone"))))),
        (kind == 8, named(EventData=named(ShareName=F.when(n % 2 == 0, F.lit("\\\\*\\IPC$")).otherwise(_text("\\\\*\\share", user % 5))))),
    ]
    body = F.lit(None).cast("string")
    for test, fields in bodies:
        body = F.when(test, F.to_json(fields)).otherwise(body)
    system = named(EventID=eid, Channel=channel, Computer=_text("HOST-", user % 20), EventRecordID=n, Provider_attributes=named(Name=_text("prov-", kind)))
    message = F.to_json(F.array(_text(" line ", n, "\r\nnext ")))
    message = F.substr(message, F.lit(2), F.length(message) - 2)
    whole = F.concat(F.lit('{"Event":{"System":'), F.to_json(system), F.lit(',"RenderingInfo":{"Message":'), message, F.lit("},"), F.substr(body, F.lit(2)), F.lit("}"))
    return e.select(
        _text("forms-", kind, ".evtx").alias("source_file"), n.cast("string").alias("record_id"), eid.cast("string").alias("event_id"), channel.alias("channel"), _text("HOST-", user % 20).alias("computer"), _text("prov-", kind).alias("provider"),
        F.timestamp_micros(micros).alias("event_ts"), (micros * 1000).alias("event_ts_ns"), (kind == 8).alias("recovered"), F.parse_json(whole).alias("event"), whole.alias("data_string"),
    )


def fields() -> Fields:
    return Fields(aliases=dict(ALIASES))


def rules(*docs: tuple[str, dict, dict]):
    """(id, detection, more keys)."""
    base = {"level": "medium", "status": "test", "author": "A, B", "date": "2024-01-01", "logsource": {"category": "test"}}
    out = link([from_doc({**base, "id": k, "title": f"Rule {k}", "detection": d, **more}) for k, d, more in docs])
    if out.errors:
        raise ValueError(out.errors)
    return out.rules


def logon_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, remote desktops and gateways: the kinds of logon beside 4624 and 4625."""
    out = metrics.logons(forms(spark, sf_dir))
    return out.select("event", "dst_user", "dst_domain", "computer", "logon_type", "src_user", "src_domain", "src_computer", "src_ip", "successes", "failures", F.unix_micros("first_success").alias("first_success"), F.unix_micros("last_success").alias("last_success"))


def computer_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System, zone, boot and uptime of computers."""
    versions = spark.createDataFrame([("1900", "S", "1"), ("1902", "S", "2")], "build string, product string, version string")
    out = metrics.computers(forms(spark, sf_dir), versions)
    return out.select("computer", "events", "build", "time_zone", "os", "uptime", F.unix_micros("last_boot").alias("last_boot"))


def file_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.critical_systems(forms(spark, sf_dir))


#: id -> (detection, SQL): leaves over a list of data.
LISTS: dict[str, tuple[dict, str]] = {
    "some item": ({"s": {"EventID": 6013, "Data|contains": "Zone"}}, "eid = '6013'"),
    "item is": ({"s": {"Data": "60", "EventID": 6013}}, "eid = '6013'"),
    "item starts": ({"s": {"Data|startswith": "1901"}}, "eid = '6009' AND uid % 4 = 1"),
    "no item": ({"a": {"EventID": 6009}, "b": {"Data|neq": "1902"}, "condition": "a and b"}, "eid = '6009' AND uid % 4 <> 2"),
    "no item of": ({"a": {"EventID": 6009}, "b": {"Data|neq": ["1902", "1900"]}, "condition": "a and b"}, "eid = '6009' AND uid % 4 IN (1, 3)"),
    "any of items": ({"s": {"Data": ["1900", "1903"]}}, "eid = '6009' AND uid % 4 IN (0, 3)"),
    "nested user data": ({"s": {"Event.UserData.EventXML.User|endswith": "3"}}, "kind IN (2, 3) AND uid % 10 = 3"),
}


def list_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.match(forms(spark, sf_dir), rules(*[(k, d, {}) for k, (d, _) in LISTS.items()]), fields())
    return found.select("rule_id", "record_id")


def data_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists in details, and details by provider and id where the rule has none."""
    own = rules(("t", {"s": {"EventID": 6009}}, {"details": "Build: %Data[2]% ¦ None: %Data[9]%"}), ("u", {"s": {"EventID": 5145}}, {}), ("v", {"s": {"EventID": 6013}}, {}))
    found = render.details(match.detect(forms(spark, sf_dir), own, fields()), fields(), own, {"prov-8_5145": "Share:   %ShareName%"})
    return found.select("rule_id", "record_id", "details")


def profile_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a profile: times, rule data, tag groups, rendered messages, recovered records, fixed texts."""
    tags = ["attack.execution", "attack.t1059", "attack.g0007", "attack.s0001", "car.2013-05-002"]
    own = rules(("x", {"s": {"EventID": 5145}}, {"tags": tags, "modified": "2024-02-02", "level": "critical"}), ("y", {"s": {"EventID": 302}}, {"level": "informational"}))
    profile = {
        "Time": "%Timestamp%", "Level": "%Level%", "Id": "%EventID%", "Record": "%RecordID%", "Title": "%RuleTitle%", "Author": "%RuleAuthor%", "Rule": "%RuleID%", "File": "%EvtxFile%", "Provider": "%Provider%",
        "Tactics": "%MitreTactics%", "Tags": "%MitreTags%", "Other": "%OtherTags%", "Status": "%Status%", "Created": "%RuleCreationDate%", "Modified": "%RuleModifiedDate%", "Recovered": "%RecoveredRecord%", "Message": "%RenderedMessage%", "Fixed": "own text",
    }
    return Engine(spark, fields()).timeline(forms(spark, sf_dir), own, profile, ordered=False, style="RFC-3339")


def powershell_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key=Value lines of classic PowerShell events as fields; the last of equal keys counts."""
    e = sources.spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    n = F.col("event_id")
    lines = _text("\tHost=h", n % 5, "\n\tUser = u", F.col("user_id"), "\r\n\tHost=second", n % 7, "\nno pair\n\tCmd=a=b")
    eid = F.element_at(F.array(F.lit("400"), F.lit("800"), F.lit("999")), (n % 3 + 1).cast("int"))
    items = F.when(eid == "800", F.array(F.lit("x"), lines)).otherwise(F.array(F.lit("x"), F.lit("y"), lines))
    event = F.to_variant_object(F.struct(F.struct(F.struct(eid.alias("EventID")).alias("System"), F.struct(items.alias("Data")).alias("EventData")).alias("Event")))
    rows = sources.powershell_classic(e.select(n.cast("string").alias("record_id"), eid.alias("event_id"), F.lit("Windows PowerShell").alias("channel"), event.alias("event")))
    return rows.select("record_id", *[C.scalar(F.col("event"), f"Event.EventData.{k}").alias(k.lower()) for k in ("Host", "User", "Cmd")])


def flat_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat objects, `result` wrappers, objects inside EventData and whole events become records alike."""
    e = sources.spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    n = F.col("event_id")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    stamp = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'.1234567Z'")
    flat = F.struct((n % 7).alias("EventID"), F.lit("S").alias("Channel"), _text("h", n % 3).alias("Hostname"), n.alias("RecordNumber"), _text("p", n % 2).alias("SourceName"), stamp.alias("@timestamp"), F.col("event_type").alias("Kind"))
    text = F.to_json(flat)
    inner = F.when(n % 4 == 1, F.concat(F.lit('{"result":'), text, F.lit("}"))).when(n % 4 == 2, F.concat(F.lit('{"Event":{"EventData":'), text, F.lit("}}")))
    whole = F.concat(F.lit('{"Event":{"System":{"EventID":'), (n % 7).cast("string"), F.lit(',"Channel":"S","Computer":"h'), (n % 3).cast("string"), F.lit('","EventRecordID":'), n.cast("string"), F.lit(',"Provider_attributes":{"Name":"p'), (n % 2).cast("string"), F.lit('"},"TimeCreated_attributes":{"SystemTime":"'), stamp, F.lit('"}},"EventData":{"Kind":"'), F.col("event_type"), F.lit('"}}}'))
    value = F.when(n % 4 == 3, whole).otherwise(F.coalesce(inner, text))
    raw = e.select(F.try_parse_json(value).alias("raw"), value.alias("value"), F.lit("a.jsonl").alias("source_file"), F.lit(1).cast("bigint").alias("file_size"))
    out = sources.normalized(raw)
    return out.select("record_id", "event_id", "channel", "computer", "provider", "event_ts_ns", C.scalar(F.col("event"), "Event.EventData.Kind").alias("kind"))


def csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of CSV: control characters and runs of spaces collapsed, parts and authors apart."""
    rows = forms(spark, sf_dir).select("record_id", F.concat(F.lit(" a\t\n"), F.col("record_id"), F.lit(" ¦  b\u0001c ")).alias("Details"), F.concat(F.lit("One , Two;T"), F.col("computer")).alias("RuleAuthor"), F.col("event_ts_ns").alias("ns"))
    return sinks.csv_ready(rows, separator="\t")


SHORT = render.Abbreviations({"system": "Sys", "security": "Sec"}, {"prov-8": "P8"}, {"prov-": "p:"})


def event_id_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = spark.createDataFrame([("Security", "5145", "Share checked"), ("System", "6009", "Boot")], "channel string, event_id string, title string")
    return reports.event_ids(metrics.event_id_counts(forms(spark, sf_dir), titles), SHORT)


def logon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.logons(metrics.logons(forms(spark, sf_dir)))


def computer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = spark.createDataFrame([("1900", "S", "1"), ("1902", "S", "2")], "build string, product string, version string")
    return reports.computers(metrics.computers(forms(spark, sf_dir), versions))


def log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forms(spark, sf_dir).withColumn("file_size", F.substring_index(F.substring_index("source_file", "-", -1), ".", 1).cast("bigint") * 700_000)
    return reports.logs(metrics.logs(rows.withColumn("source_file", F.concat(F.lit("/logs/"), "source_file"))), SHORT)


def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = spark.createDataFrame([("security", "5145", "Share checked")], "channel string, event_id string, title string")
    found = search.search(forms(spark, sf_dir), ["HOST-3", "HOST-7"], filters=["EventID: *5*"], fields=fields())
    return reports.search(found, titles, SHORT, separator="\t")


QUERIES = {f.__name__: f for f in (event_id_report, logon_report, computer_report, log_report, search_report, logon_kinds, computer_details, file_servers, list_leaves, data_items, profile_kinds, powershell_fields, flat_exports, csv_columns)}

_CHANNEL = f"CASE WHEN kind IN (0, 1, 8) THEN 'Security' WHEN kind IN (2, 3) THEN '{metrics.LSM}' WHEN kind = 4 THEN '{metrics.RCM}' WHEN kind = 5 THEN '{metrics.GATEWAY}' ELSE 'System' END"
_SHORT = f"CASE WHEN kind IN (0, 1, 8) THEN 'Sec' WHEN kind IN (6, 7) THEN 'Sys' ELSE {_CHANNEL} END"
_UP = "(up // 31536000) || 'Y ' || (up % 31536000 // 2592000) || 'M ' || (up % 2592000 // 86400) || 'd ' || (up % 86400 // 3600) || 'h ' || (up % 3600 // 60) || 'm ' || (up % 60) || 's'"
_STAMP = "'%Y-%m-%d %H:%M:%S.%g +00:00'"
_MESSAGE = "'line ' || num || ' next'"
ORACLES = {
    "event_id_report": f"""WITH {FORMS}, t AS (SELECT count(*) AS n, lower({_CHANNEL}) AS c, {_SHORT} AS short, eid FROM forms GROUP BY ALL)
SELECT n::VARCHAR AS "Total", format('{{:.1f}}%', round(n / (SELECT count(*) FROM forms) * 1000) / 10) AS "%", CASE WHEN short IN ('Sec', 'Sys') THEN short ELSE c END AS "Channel", eid AS "ID",
  CASE eid WHEN '5145' THEN 'Share checked' WHEN '6009' THEN 'Boot' ELSE 'Unknown' END AS "Event" FROM t""",
    "computer_report": f"""WITH {FORMS}, c AS (
  SELECT computer, count(*) AS n, max(CASE WHEN eid = '6009' THEN '190' || (uid % 4) END) AS build, max(CASE WHEN eid = '6013' THEN '-' || (uid % 12 * 60) || ' Zone' END) AS zone,
    max(CASE WHEN kind IN (6, 7) THEN ns END) // 1000000000 - max(CASE WHEN eid = '6009' THEN ns END) // 1000000000 AS up FROM forms GROUP BY computer)
SELECT computer AS "Computer", CASE build WHEN '1900' THEN 'S 1' WHEN '1902' THEN 'S 2' ELSE '' END AS "OS information", CASE WHEN up > 0 THEN {_UP} ELSE '' END AS "UpTime", coalesce(zone, '') AS "Timezone", n::VARCHAR AS "Events" FROM c""",
    "log_report": f"""WITH {FORMS} SELECT 'forms-' || kind || '.evtx' AS "Filename", array_to_string(list_sort(list(DISTINCT computer)), ' ¦') AS "Computers", format('{{:,}}', count(*)) AS "Events",
  strftime(make_timestamp(min(ns) // 1000), {_STAMP}) AS "First Timestamp", strftime(make_timestamp(max(ns) // 1000), {_STAMP}) AS "Last Timestamp", {_SHORT} AS "Channels", CASE kind WHEN 8 THEN 'P8' ELSE 'p:' || kind END AS "Providers",
  CASE kind WHEN 0 THEN '0 B' WHEN 1 THEN '683.6 KiB' ELSE format('{{:.1f}} MiB', kind * 700000 / 1048576) END AS "Size" FROM forms GROUP BY kind""",
    "logon_report": f"""WITH {FORMS}, k AS (
  SELECT CASE WHEN kind < 2 THEN 'Sec ' || eid WHEN kind < 4 THEN 'RDS-LSM ' || eid WHEN kind = 4 THEN 'RDS-RCM 1149' ELSE 'RDS-GTW 302' END AS event, 'user' || uid AS account,
    CASE kind WHEN 3 THEN '-' WHEN 5 THEN 'GW' ELSE 'DOM' || (uid % 3) END AS dom, computer, CASE WHEN kind < 2 THEN 'WS' || (uid % 11) ELSE '-' END AS ws, '10.0.0.' || (num % 250) AS ip, ns FROM forms WHERE kind < 6)
SELECT count(*)::VARCHAR AS "Successful", strftime(make_timestamp(min(ns) // 1000), {_STAMP}) AS "First Logon", strftime(make_timestamp(max(ns) // 1000), {_STAMP}) AS "Last Logon", event AS "Event", account AS "Target Account",
  dom AS "Target Domain", computer AS "Target Computer", '-' AS "Logon Type", '-' AS "Source Account", '-' AS "Source Domain", ws AS "Source Computer", ip AS "Source IP Address" FROM k GROUP BY ALL""",
    "search_report": rf"""WITH {FORMS}, s AS (SELECT *, strftime(make_timestamp(ns // 1000), '%Y-%m-%d %H:%M:%S.%f+00:00') AS stamp FROM forms WHERE (computer LIKE '%HOST-3%' OR computer LIKE '%HOST-7%') AND eid LIKE '%5%')
SELECT stamp AS "Timestamp", CASE eid WHEN '5145' THEN 'Share checked' ELSE '-' END AS "EventTitle", computer AS "Hostname", {_SHORT} AS "Channel", eid AS "Event ID", num::VARCHAR AS "Record ID",
  CASE kind WHEN 8 THEN 'Message: line ' || num || ' next' || chr(9) || 'ShareName: ' || CASE WHEN num % 2 = 0 THEN '\\*\IPC$' ELSE '\\*\share' || (uid % 5) END ELSE 'Address: 10.0.0.' || (num % 250) || chr(9) || 'Message: line ' || num || ' next' || chr(9) || 'User: user' || uid END AS "AllFieldInfo", 'forms-' || kind || '.evtx' AS "EvtxFile" FROM s""",
    "logon_kinds": f"""WITH {FORMS}, k AS (
  SELECT CASE WHEN kind < 2 THEN 'Sec ' || eid WHEN kind < 4 THEN 'RDS-LSM ' || eid WHEN kind = 4 THEN 'RDS-RCM 1149' ELSE 'RDS-GTW 302' END AS event, 'user' || uid AS dst_user,
    CASE kind WHEN 3 THEN '-' WHEN 5 THEN 'GW' ELSE 'DOM' || (uid % 3) END AS dst_domain, computer, CASE WHEN kind < 2 THEN 'WS' || (uid % 11) ELSE '-' END AS src_computer, '10.0.0.' || (num % 250) AS src_ip, ns FROM forms WHERE kind < 6)
SELECT event, dst_user, dst_domain, computer, '-' AS logon_type, '-' AS src_user, '-' AS src_domain, src_computer, src_ip, count(*) AS successes, 0::BIGINT AS failures, min(ns) // 1000 AS first_success, max(ns) // 1000 AS last_success FROM k GROUP BY ALL""",
    "computer_details": f"""WITH {FORMS}, c AS (
  SELECT computer, count(*) AS events, max(CASE WHEN eid = '6009' THEN '190' || (uid % 4) END) AS build, max(CASE WHEN eid = '6013' THEN '-' || (uid % 12 * 60) || ' Zone' END) AS time_zone,
    max(CASE WHEN eid = '6009' THEN ns END) // 1000 AS last_boot, max(CASE WHEN kind IN (6, 7) THEN ns END) // 1000 AS last_system FROM forms GROUP BY computer)
SELECT computer, events, build, time_zone, CASE build WHEN '1900' THEN 'S 1' WHEN '1902' THEN 'S 2' END AS os, last_system // 1000000 - last_boot // 1000000 AS uptime, last_boot FROM c""",
    "file_servers": f"WITH {FORMS} SELECT DISTINCT 'file server' AS kind, computer FROM forms WHERE eid = '5145' AND num % 2 = 1",
    "list_leaves": f"WITH {FORMS} " + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, num::VARCHAR AS record_id FROM forms WHERE {sql}" for k, (_, sql) in LISTS.items()),
    "data_items": rf"""WITH {FORMS} SELECT 't' AS rule_id, num::VARCHAR AS record_id, 'Build: 190' || (uid % 4) || ' ¦ None: n/a' AS details FROM forms WHERE eid = '6009'
UNION ALL SELECT 'u', num::VARCHAR, 'Share: ' || CASE WHEN num % 2 = 0 THEN '\\*\IPC$' ELSE '\\*\share' || (uid % 5) END FROM forms WHERE eid = '5145'
UNION ALL SELECT 'v', num::VARCHAR, 'Data[5]: ' || (num % 1000) || ' ¦ Data[6]: 60 ¦ Data[7]: -' || (uid % 12 * 60) || ' Zone ¦ Message: line ' || num || chr(13) || chr(10) || 'next' FROM forms WHERE eid = '6013'""",
    "profile_kinds": f"""WITH {FORMS} SELECT strftime(make_timestamp(ns // 1000), '%Y-%m-%d %H:%M:%S.%f+00:00') AS "Time", CASE eid WHEN '5145' THEN 'crit' ELSE 'info' END AS "Level", eid AS "Id", num::VARCHAR AS "Record",
  CASE eid WHEN '5145' THEN 'Rule x' ELSE 'Rule y' END AS "Title", 'A, B' AS "Author", CASE eid WHEN '5145' THEN 'x' ELSE 'y' END AS "Rule", 'forms-' || kind || '.evtx' AS "File", 'prov-' || kind AS "Provider",
  CASE eid WHEN '5145' THEN 'Exec' ELSE '' END AS "Tactics", CASE eid WHEN '5145' THEN 'T1059 ¦ G0007 ¦ S0001' ELSE '' END AS "Tags", CASE eid WHEN '5145' THEN 'car.2013-05-002' ELSE '' END AS "Other", 'test' AS "Status",
  '2024-01-01' AS "Created", CASE eid WHEN '5145' THEN '2024-02-02' ELSE '' END AS "Modified", CASE eid WHEN '5145' THEN 'Y' ELSE '' END AS "Recovered", {_MESSAGE} AS "Message", 'own text' AS "Fixed" FROM forms WHERE eid IN ('5145', '302')""",
    "powershell_fields": "SELECT event_id::VARCHAR AS record_id, CASE WHEN event_id % 3 < 2 THEN 'second' || (event_id % 7) END AS host, CASE WHEN event_id % 3 < 2 THEN 'u' || user_id END AS user, CASE WHEN event_id % 3 < 2 THEN 'a=b' END AS cmd FROM events",
    "flat_exports": "SELECT event_id::VARCHAR AS record_id, (event_id % 7)::VARCHAR AS event_id, 'S' AS channel, 'h' || (event_id % 3) AS computer, 'p' || (event_id % 2) AS provider, (epoch_us(ts) // 1000000) * 1000000000 + 123456700 AS event_ts_ns, event_type AS kind FROM events",
    "csv_columns": f"WITH {FORMS} SELECT num::VARCHAR AS record_id, 'a ' || num || chr(9) || 'b c' AS \"Details\", 'One' || chr(9) || 'Two' || chr(9) || 'T' || computer AS \"RuleAuthor\", ns FROM forms",
}
