"""Fixed analyses of records: ids, logons, computers, logs, totals, critical systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import scratch
from tracelake.functions import columns as C

SECURITY, LSM = "Security", "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational"
RCM, GATEWAY = "Microsoft-Windows-TerminalServices-RemoteConnectionManager/Operational", "Microsoft-Windows-TerminalServices-Gateway/Operational"

# Names of the logon types.
LOGON_TYPES = {
    "0": "0 - System", "2": "2 - Interactive", "3": "3 - Network", "4": "4 - Batch", "5": "5 - Service", "7": "7 - Unlock", "8": "8 - NetworkCleartext",
    "9": "9 - NewInteractive", "10": "10 - RemoteInteractive", "11": "11 - CachedInteractive", "12": "12 - CachedRemoteInteractive", "13": "13 - CachedUnlock",
}


def without_duplicate_records(records: DataFrame) -> DataFrame:
    """Records that share their number and time are one."""
    return records.dropDuplicates(["record_id", "event_ts_ns"])


def event_id_counts(records: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """total, percent, channel, event_id, title by id and channel, the most frequent first."""
    counts = records.groupBy(F.lower("event_id").alias("event_id"), F.lower("channel").alias("channel")).agg(F.count("*").alias("total"))
    # The groups are far fewer than records; their sum is one more small aggregate.
    whole = counts.agg(F.sum("total").alias("_all"))
    counts = counts.join(F.broadcast(whole)).withColumn("percent", C.percent_f32(F.col("total"), F.col("_all"))).drop("_all")
    if titles is not None:
        named = titles.select(F.lower("channel").alias("_c"), F.col("event_id").alias("_e"), F.col("title").alias("_title"))
        counts = counts.join(scratch.small(named), (F.col("channel") == F.col("_c")) & (F.col("event_id") == F.col("_e")), "left")
        counts = counts.withColumn("title", F.coalesce("_title", F.lit("Unknown"))).drop("_c", "_e", "_title")
    else:
        counts = counts.withColumn("title", F.lit("Unknown"))
    return counts.orderBy(F.desc("total"), "event_id", "channel")


def logons(records: DataFrame) -> DataFrame:
    """Successes and failures of logon events by user, domain, computer, type and source, with their first and last times."""
    e = F.col("event")
    data = lambda name: C.scalar(e, f"Event.EventData.{name}")
    user = lambda path: C.scalar(e, f"Event.UserData.{path}")
    tail = lambda v: F.substring_index(v, "\\", -1)
    head = lambda v: F.when(v.contains("\\"), F.substring_index(v, "\\", 1)).otherwise(F.lit("-"))
    number = F.schema_of_variant(F.try_variant_get(e, "$.Event.System.EventID", "variant")).isin("BIGINT", "TINYINT", "SMALLINT", "INT")
    eid, channel = F.col("event_id"), F.col("channel")
    kind = (
        F.when((channel == SECURITY) & eid.isin("4624", "4625"), "sec").when((channel == SECURITY) & eid.isin("4778", "4779"), "session")
        .when((channel == LSM) & eid.isin("21", "25"), "lsm").when((channel == RCM) & (eid == "1149"), "rcm").when((channel == GATEWAY) & (eid == "302"), "gateway")
    )
    rows = records.where(number).withColumn("_k", kind).where("_k is not null")
    lsm, gateway = user("EventXML.User"), user("EventInfo.Username")
    by = lambda sec, session, lsm_, rcm, gw: F.when(F.col("_k") == "sec", sec).when(F.col("_k") == "session", session).when(F.col("_k") == "lsm", lsm_).when(F.col("_k") == "rcm", rcm).otherwise(gw)
    dash = F.lit("-")
    names = F.create_map(*[F.lit(x) for kv in LOGON_TYPES.items() for x in kv])
    label = by(F.concat(F.lit("Sec "), eid), F.concat(F.lit("Sec "), eid), F.concat(F.lit("RDS-LSM "), eid), F.lit("RDS-RCM 1149"), F.lit("RDS-GTW 302"))
    keys = {
        "event": label,
        "dst_user": by(data("TargetUserName"), data("AccountName"), tail(lsm), user("EventXML.Param1"), tail(gateway)),
        "dst_domain": by(data("TargetDomainName"), data("AccountDomain"), head(lsm), user("EventXML.Param2"), head(gateway)),
        "computer": F.col("computer"),
        "logon_type": F.when(F.col("_k") == "sec", F.coalesce(F.try_element_at(names, data("LogonType")), data("LogonType"))),
        "src_user": data("SubjectUserName"),
        "src_domain": data("SubjectDomainName"),
        "src_computer": by(data("WorkstationName"), data("ClientName"), dash, dash, dash),
        "src_ip": by(data("IpAddress"), data("ClientAddress"), user("EventXML.Address"), user("EventXML.Param3"), user("EventInfo.IpAddress")),
    }
    rows = rows.select(*[F.coalesce(v, dash).alias(k) for k, v in keys.items()], (eid == "4625").alias("_failed"), "event_ts")
    when = lambda f, failed: f(F.when(F.col("_failed") == F.lit(failed), F.col("event_ts")))
    return rows.groupBy(*keys).agg(
        F.count_if(~F.col("_failed")).alias("successes"), F.count_if("_failed").alias("failures"),
        when(F.min, False).alias("first_success"), when(F.max, False).alias("last_success"), when(F.min, True).alias("first_failure"), when(F.max, True).alias("last_failure"),
    )


def computers(records: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Of each computer: records, system version, time zone, last boot and uptime in seconds."""
    e, eid = F.col("event"), F.col("event_id")
    system = F.col("channel") == "System"
    item = lambda i: F.get(C.array_of(e, "Event.EventData.Data"), F.lit(i))
    boot = F.when(system & eid.isin("12", "6005", "6009"), F.col("event_ts"))
    out = records.groupBy("computer").agg(
        F.count("*").alias("events"), F.max(F.when(system & (eid == "6009"), item(1))).alias("build"), F.max(F.when(system & (eid == "6013"), item(6))).alias("time_zone"),
        F.max(boot).alias("last_boot"), F.max(F.when(system, F.col("event_ts"))).alias("last_system"),
    )
    out = out.withColumn("uptime", F.unix_seconds("last_system") - F.unix_seconds("last_boot"))
    if versions is not None:
        known = versions.select(F.col("build").alias("_b"), F.concat_ws(" ", "product", "version").alias("os"))
        out = out.join(scratch.small(known), F.col("build") == F.col("_b"), "left").drop("_b")
    else:
        out = out.withColumn("os", F.col("build"))
    return out.orderBy(F.desc("events"), "computer")


def logs(records: DataFrame) -> DataFrame:
    """Of each file: records, first and last time, computers, channels, providers and its size."""
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(c)), C.SEPARATOR)
    size = F.first("file_size") if "file_size" in records.columns else F.lit(None).cast("bigint")
    out = records.groupBy("source_file").agg(
        F.count("*").alias("events"), F.min("event_ts").alias("first_time"), F.max("event_ts").alias("last_time"),
        texts("computer").alias("computers"), texts("channel").alias("channels"), texts("provider").alias("providers"), size.alias("file_size"),
    )
    return out.orderBy(F.desc("events"), "source_file")


def time_span(records: DataFrame) -> DataFrame:
    """total, first_time (none before 2007-01-30) and last_time."""
    real = F.when(F.col("event_ts") >= F.to_timestamp(F.lit("2007-01-30 00:00:00")), F.col("event_ts"))
    return records.agg(F.count("*").alias("total"), F.min(real).alias("first_time"), F.max("event_ts").alias("last_time"))


def critical_systems(records: DataFrame) -> DataFrame:
    """kind, computer: domain controllers issue Kerberos tickets (4768), file servers serve shares (5145)."""
    share = C.scalar(F.col("event"), "Event.EventData.ShareName")
    kind = F.when(F.col("event_id") == "4768", "domain controller").when((F.col("event_id") == "5145") & (share != "\\\\*\\IPC$"), "file server")
    return records.where(F.col("channel") == SECURITY).select(kind.alias("kind"), "computer").where("kind is not null and computer is not null").distinct()


def histogram(times: Column, low: str, high: str, bins: int) -> Column:
    """The bin, 1 to bins, of a time between two others."""
    a, b = F.unix_micros(F.to_timestamp(F.lit(low))), F.unix_micros(F.to_timestamp(F.lit(high)))
    return F.width_bucket(F.unix_micros(times).cast("double"), a.cast("double"), b.cast("double"), F.lit(bins))


def top(df: DataFrame, by: list[str], count: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows of each group with the largest count."""
    order = Window.partitionBy(*by).orderBy(F.desc(count), *ties)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
