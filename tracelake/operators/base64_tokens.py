"""Base64 in command lines and scripts: tokens, decoded and named by what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import columns as C

POWERSHELL = ("Microsoft-Windows-PowerShell/Operational", "PowerShellCore/Operational")
TOKEN = r"[A-Za-z0-9+/]+={0,2}"

# The first bytes of common file types, in hex.
MAGIC = {
    "4D5A": "exe", "504B0304": "zip", "1F8B": "gz", "25504446": "pdf", "89504E470D0A1A0A": "png", "FFD8FF": "jpg", "47494638": "gif",
    "7F454C46": "elf", "377ABCAF271C": "7z", "526172211A07": "rar", "D0CF11E0A1B11AE1": "ole", "CAFEBABE": "class", "425A68": "bz2", "424D": "bmp",
}


def payloads(records: DataFrame) -> DataFrame:
    """The fields that may hold base64: a row each, with its event's name."""
    e, eid, channel = F.col("event"), F.col("event_id"), F.col("channel")
    data = lambda name: C.scalar(e, f"Event.EventData.{name}")
    third = F.get(C.array_of(e, "Event.EventData.Data"), F.lit(2))
    ps = channel.isin(*POWERSHELL)
    cases = [
        ((channel == "Security") & (eid == "4688"), "Sec 4688", [data("CommandLine")]),
        ((channel == "Microsoft-Windows-Sysmon/Operational") & (eid == "1"), "Sysmon 1", [data("CommandLine"), data("ParentCommandLine")]),
        (ps & (eid == "4104"), "PwSh 4104", [data("ScriptBlockText")]),
        (ps & (eid == "4103"), "PwSh 4103", [data("Payload")]),
        (ps & (eid == "4100"), "PwSh 4100", [data("ContextInfo"), data("Payload")]),
        (ps & (eid == "4102"), "PwSh 4102", [data("ContextInfo"), data("Payload")]),
        ((channel == "Windows PowerShell") & (eid == "400"), "PwShClassic 400", [third]),
        ((channel == "Windows PowerShell") & (eid == "403"), "PwShClassic 403", [third]),
        ((channel == "Windows PowerShell") & (eid == "600"), "PwShClassic 600", [third]),
        ((channel == "System") & (eid == "7045"), "Sys 7045", [data("ImagePath")]),
    ]
    struct = lambda name, v: F.struct(F.lit(name).alias("event_name"), v.alias("field"))
    found = F.lit(None).cast("array<struct<event_name:string,field:string>>")
    for test, name, values in cases:
        found = F.when(test, F.array(*[struct(name, v) for v in values])).otherwise(found)
    rows = records.withColumn("_p", F.explode(found)).where("_p.field is not null")
    return rows.select("event_ts", "computer", "record_id", "source_file", "_p.event_name", "_p.field")


def _decoded(token: Column) -> Column:
    """Bytes of standard base64 with or without padding; null where the text is none."""
    body = F.rtrim(F.replace(token, F.lit("="), F.lit(" ")))
    return F.when((F.length(body) % 4 != 1) & token.rlike(r"^[A-Za-z0-9+/]+={0,2}\z"), F.try_to_binary(body, F.lit("base64")))


def _text(raw: Column) -> tuple[Column, Column]:
    """Kind and text of bytes that are ASCII in UTF-8 or UTF-16; five characters at least."""
    hex_ = F.hex(raw)
    ascii_ = hex_.rlike(r"^(0[9AD]|[2-6][0-9A-F]|7[0-9A-E]){5,}\z")
    le, be = hex_.rlike(r"^((0[9AD]|[2-6][0-9A-F]|7[0-9A-E])00){5,}\z"), hex_.rlike(r"^(00(0[9AD]|[2-6][0-9A-F]|7[0-9A-E])){5,}\z")
    kind = F.when(ascii_, "UTF-8").when(le, "UTF-16 LE").when(be, "UTF-16 BE")
    text = F.when(ascii_, F.decode(raw, "UTF-8")).when(le, F.decode(raw, "UTF-16LE")).when(be, F.decode(raw, "UTF-16BE"))
    return kind, text


def extract(records: DataFrame) -> DataFrame:
    """A row a token: what it was cut from, decoded text, length, whether binary or encoded twice, encoding and file type.

    Tokens of under 10 characters or of letters alone, those behind a hyphen, and bytes of no known kind are passed over.
    """
    rows = payloads(records).withColumn("token", F.explode(F.regexp_extract_all("field", F.lit(TOKEN), F.lit(0))))
    rows = rows.where((F.length("token") >= 10) & ~F.col("token").rlike(r"^[A-Za-z]+\z"))
    rows = rows.withColumn("_raw", _decoded(F.col("token"))).where("_raw is not null")
    kind, text = _text(F.col("_raw"))
    magic = F.lit(None).cast("string")
    for head, name in sorted(MAGIC.items(), key=lambda x: len(x[0])):
        magic = F.when(F.hex("_raw").startswith(head), name).otherwise(magic)
    rows = rows.withColumn("encoding", kind).withColumn("decoded", text).withColumn("file_type", magic)
    rows = rows.where("encoding is not null or file_type is not null")
    marked = F.regexp_replace(F.replace(F.col("field"), F.col("token"), F.lit("<Base64String>")), "<Base64String>=+", "<Base64String>")
    inner = F.regexp_extract("decoded", TOKEN, 0)
    twice = C.truth((F.length(inner) >= 10) & (inner == F.btrim("decoded")) & ~inner.rlike(r"^[A-Za-z]+\z") & _decoded(inner).isNotNull())
    out = rows.select(
        C.format_time(F.col("event_ts")).alias("timestamp"), "computer", F.col("token").alias("base64"), F.coalesce("decoded", F.lit("")).alias("decoded"), marked.alias("original_field"),
        F.octet_length("_raw").alias("length"), F.col("encoding").isNull().alias("is_binary"), twice.alias("double_encoding"), F.coalesce("encoding", F.lit("Binary")).alias("encoding"),
        F.coalesce("file_type", F.lit("")).alias("file_type"), F.col("event_name").alias("event"), "record_id", "source_file",
    )
    return out.where(~F.col("original_field").contains("-<Base64String>"))
