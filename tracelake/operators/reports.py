"""Results of the fixed analyses as their files show them: columns under fixed headers, in order, every value a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import scratch
from tracelake.functions import columns as C

from .render import Abbreviations

NONE = Abbreviations({}, {}, {})

# Headers of the files.
EVENT_IDS = ("Total", "%", "Channel", "ID", "Event")
LOGONS = ("Event", "Target Account", "Target Domain", "Target Computer", "Logon Type", "Source Account", "Source Domain", "Source Computer", "Source IP Address")
COMPUTERS = ("Computer", "OS information", "UpTime", "Timezone", "Events")
LOGS = ("Filename", "Computers", "Events", "First Timestamp", "Last Timestamp", "Channels", "Providers", "Size")
BASE64 = ("Timestamp", "Computer", "Base64 String", "Decoded String", "Original Field", "Length", "Binary", "Double Encoding", "Encoding", "File Type", "Event", "Record ID", "File Name")
SEARCH = ("Timestamp", "EventTitle", "Hostname", "Channel", "Event ID", "Record ID", "AllFieldInfo", "EvtxFile")


def _under(df: DataFrame, header: tuple[str, ...], values: list[Column]) -> DataFrame:
    return df.select(*[v.cast("string").alias(name) for name, v in zip(header, values, strict=True)])


def _listed(v: Column, short, separator: str) -> Column:
    """Parts of a joined text, shortened, in order again."""
    return F.array_join(F.array_sort(F.transform(F.split(v, C.SEPARATOR), short)), separator)


def event_ids(counts: DataFrame, short: Abbreviations = NONE) -> DataFrame:
    """metrics.event_id_counts with a percent sign and short channels, the most frequent first."""
    rows = counts.orderBy(F.desc("total"), "channel", "event_id")
    return _under(rows, EVENT_IDS, [F.col("total"), F.format_string("%.1f%%", F.col("percent")), F.btrim(short.channel(F.col("channel"))), F.replace("event_id", F.lit('"'), F.lit("")), F.col("title")])


def logons(found: DataFrame, failed: bool = False, style: str = "default") -> DataFrame:
    """The successful or the failed ones of metrics.logons, the most frequent first; groups without any are left out."""
    count, first, last = ("failures", "first_failure", "last_failure") if failed else ("successes", "first_success", "last_success")
    keys = ["event", "dst_user", "dst_domain", "computer", "logon_type", "src_user", "src_domain", "src_computer", "src_ip"]
    header = ("Failed", "First Attempt", "Last Attempt") if failed else ("Successful", "First Logon", "Last Logon")
    rows = found.where(F.col(count) > 0).orderBy(F.desc(count), *keys)
    time = lambda c: F.coalesce(C.format_time(F.col(c), style), F.lit("-"))
    return _under(rows, header + LOGONS, [F.col(count), time(first), time(last), *map(F.col, keys)])


def computers(found: DataFrame) -> DataFrame:
    """metrics.computers: what is not known is empty, and so is an uptime of nothing or less."""
    known = lambda c: F.coalesce(c, F.lit(""))
    up = F.when(F.col("uptime") > 0, C.uptime(F.col("uptime")))
    return _under(found.orderBy(F.desc("events"), "computer"), COMPUTERS, [known(F.col("computer")), known(F.col("os")), known(up), known(F.col("time_zone")), F.col("events")])


def logs(found: DataFrame, short: Abbreviations = NONE, style: str = "default", separator: str = " ¦") -> DataFrame:
    """metrics.logs: lists joined, channels and providers short, the largest log first. A log without times has those of the epoch."""
    time = lambda c: C.format_time(F.coalesce(F.col(c), F.timestamp_seconds(F.lit(0))), style)
    texts = [_listed(F.col("computers"), lambda x: x, separator), F.format_number("events", 0), time("first_time"), time("last_time"), _listed(F.col("channels"), short.channel, separator), _listed(F.col("providers"), short.provider, separator)]
    name = F.element_at(F.split("source_file", r"[/\\]"), -1)
    return _under(found.orderBy(F.desc("events"), "source_file"), LOGS, [name, *texts, C.size_text(F.col("file_size"))])


def base64(found: DataFrame) -> DataFrame:
    """base64_tokens.extract: Y or N for truths, a note in place of what cannot be shown."""
    flag = lambda c: F.when(F.col(c), "Y").otherwise("N")
    decoded = F.when(F.col("is_binary"), "(Binary Data)").otherwise(F.col("decoded"))
    middle = [F.col("original_field"), F.col("length"), flag("is_binary"), flag("double_encoding"), F.col("encoding"), F.col("file_type"), F.col("event"), F.col("record_id"), F.col("source_file")]
    return _under(found, BASE64, [F.col("timestamp"), F.col("computer"), F.col("base64"), decoded, *middle])


def search(found: DataFrame, titles: DataFrame | None = None, short: Abbreviations = NONE, separator: str = C.SEPARATOR) -> DataFrame:
    """search.search with the titles of its events (channel, event_id, title; - where there is none), in its order."""
    if titles is None:
        title = F.lit("-")
    else:
        named = titles.select(F.lower("channel").alias("_c"), F.col("event_id").alias("_e"), F.col("title").alias("_title")).dropDuplicates(["_c", "_e"])
        found = found.join(scratch.small(named), (F.lower("channel") == F.col("_c")) & (F.col("event_id") == F.col("_e")), "left")
        title = F.coalesce("_title", F.lit("-"))
    shown = F.replace(C.collapse_spaces(F.col("all_fields")), F.lit(C.SEPARATOR), F.lit(separator))
    rows = found.orderBy("timestamp", "record_id", "source_file")
    return _under(rows, SEARCH, [F.col("timestamp"), title, F.col("computer"), short.channel(F.col("channel")), F.col("event_id"), F.col("record_id"), shown, F.col("source_file")])
