"""Event records from JSON exports: lines, arrays, concatenated objects and search-tool exports.

Every reader ends in the same records: source_file, record_id, event_id, channel, computer, provider, level, event_ts,
event_ts_ns, recovered, event (variant), data_string. Unreadable lines are kept apart by rejected(), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.sources import split_json

#: Larger .json files are read by many tasks.
WHOLE_BYTES = 64 << 20
SYSTEM = {"RecordNumber": "EventRecordID", "SourceName": "Provider_Name", "Hostname": "Computer"}


def _files(spark: SparkSession, path: str, pattern: str | None, whole: bool, only: Column | None = None) -> DataFrame:
    reader = spark.read.option("wholetext", whole).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path)
    if only is not None:
        rows = rows.where(only)
    return rows.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("file_size"))


def json_lines(spark: SparkSession, path: str, pattern: str | None = "*.jsonl") -> DataFrame:
    """raw, source_file, file_size: a record a line; blank lines are skipped."""
    rows = _files(spark, path, pattern, False).where("trim(value) <> ''")
    return rows.select(F.try_parse_json("value").alias("raw"), "value", "source_file", "file_size")


def json_files(spark: SparkSession, path: str, pattern: str | None = "*.json") -> DataFrame:
    """raw, source_file, file_size: an array a file, or objects one after another; rows/fields exports and `result` objects too.

    Files of more than WHOLE_BYTES are cut by ranges of bytes (split_json) and come object by object, arrays and objects one after another alike.
    """
    large = split_json.objects(spark, path, pattern or "*", WHOLE_BYTES + 1).withColumn("raw", F.try_parse_json("value"))
    rows = _files(spark, path, pattern, True, F.col("_metadata.file_size") <= WHOLE_BYTES)
    whole = rows.withColumn("parsed", F.try_parse_json("value"))
    kind = F.schema_of_variant("parsed")
    arrays = whole.where(kind.startswith("ARRAY")).select(F.explode(F.try_variant_get("parsed", "$", "array<variant>")).alias("raw"), F.lit(None).cast("string").alias("value"), "source_file", "file_size")
    tables = whole.where(kind.startswith("OBJECT") & F.try_variant_get("parsed", "$.rows", "variant").isNotNull() & F.try_variant_get("parsed", "$.fields", "variant").isNotNull())
    fields = F.try_variant_get("parsed", "$.fields", "array<variant>")
    names = F.transform(fields, lambda f: F.coalesce(F.try_variant_get(f, "$.name", "string"), F.try_variant_get(f, "$", "string")))
    tables = tables.select(names.alias("names"), F.explode(F.try_variant_get("parsed", "$.rows", "array<array<string>>")).alias("row"), "source_file", "file_size")
    # Trailing cells without a name, and names without a cell, are left out.
    n = F.least(F.size("names"), F.size("row"))
    zipped = F.map_from_arrays(F.slice("names", 1, n), F.slice("row", 1, n))
    tables = tables.select(F.try_parse_json(F.to_json(zipped)).alias("raw"), F.to_json(zipped).alias("value"), "source_file", "file_size")
    singles = whole.where(kind.startswith("OBJECT") & (F.try_variant_get("parsed", "$.rows", "variant").isNull() | F.try_variant_get("parsed", "$.fields", "variant").isNull()))
    singles = singles.select(F.col("parsed").alias("raw"), "value", "source_file", "file_size")
    # Objects one after another: cut between } and {.
    many = whole.where("parsed is null").withColumn("piece", F.explode(F.split(F.regexp_replace("value", r"[\r\n]+", ""), r"(?<=\})\s*(?=\{)")))
    many = many.select(F.try_parse_json("piece").alias("raw"), F.col("piece").alias("value"), "source_file", "file_size")
    return arrays.unionByName(tables).unionByName(singles).unionByName(many).unionByName(large.select("raw", "value", "source_file", "file_size"))


def rejected(raw: DataFrame) -> DataFrame:
    """What could not be read as an object."""
    return raw.where(F.col("raw").isNull() | ~F.schema_of_variant("raw").startswith("OBJECT")).select("source_file", "value")


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, C.json_path(p), "string") for p in paths])


def normalized(raw: DataFrame) -> DataFrame:
    """Records of flat exports: System, EventData and UserData hold the same object, with the usual names of its fields.

    An object that already has Event.System stays as it is; a `result` object is taken out of its wrapper.
    """
    good = raw.where(F.schema_of_variant("raw").startswith("OBJECT"))
    inner = F.coalesce(F.try_variant_get("raw", "$.result", "variant"), F.try_variant_get("raw", "$.Event.EventData", "variant"), F.col("raw"))
    native = F.try_variant_get("raw", "$.Event.System", "variant").isNotNull()
    flat = good.withColumn("_in", inner).withColumn("_native", native)
    text = F.to_json(F.col("_in"))
    body = F.struct(F.col("_in").alias("EventData"), F.col("_in").alias("System"), F.col("_in").alias("UserData"))
    event = F.when(F.col("_native"), F.col("raw")).otherwise(F.try_parse_json(F.to_json(F.struct(body.alias("Event")))))
    rows = flat.select("source_file", "file_size", "_native", event.alias("event"), text.alias("_text"), "_in")
    return with_columns(rows, flat_source=True).drop("_native", "_text", "_in")


def with_columns(rows: DataFrame, flat_source: bool = False) -> DataFrame:
    """The typed columns of a record from its event."""
    e = F.col("event")
    system = lambda *names: _text(e, *[f"Event.System.{n}" for n in names])
    provider = _text(e, "Event.System.Provider_attributes.Name", "Event.System.Provider_Name", "Event.System.SourceName", "Event.System.Provider", "Event.System.Name")
    time = _text(e, "Event.System.TimeCreated_attributes.SystemTime", "Event.System.@timestamp", "Event.System._time", "Event.System.TimeCreated", "Event.System.EventTime", "Event.System.SystemTime")
    cols = [
        F.col("source_file"), system("EventRecordID", "RecordNumber", "RecordID").alias("record_id"), C.scalar(e, "Event.System.EventID").alias("event_id"), system("Channel").alias("channel"),
        system("Computer", "Hostname", "ComputerName", "host").alias("computer"), provider.alias("provider"), system("Level").alias("level"), C.parse_time(time).alias("event_ts"),
        C.nanoseconds(time).alias("event_ts_ns"), F.lit(False).alias("recovered"), e, F.to_json(e).alias("data_string"),
    ]
    more = [c for c in rows.columns if c not in ("source_file", "event")]
    return rows.select(*cols, *more)


def tasks(spark: SparkSession) -> int:
    """Tasks that keep all cores busy to the end, for work that is heavy a row."""
    return 4 * spark.sparkContext.defaultParallelism


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key over more tasks where their files give few: a row is some bytes on disk, but what is made of it costs far more than reading it."""
    few = tasks(rows.sparkSession)
    return rows.repartition(few, key) if rows.rdd.getNumPartitions() < few else rows


def powershell_classic(records: DataFrame) -> DataFrame:
    """Key=Value lines of classic PowerShell events become fields beside Data; a later key wins."""
    data = C.array_of(F.col("event"), "Event.EventData.Data")
    which = F.when(F.col("event_id") == "800", F.get(data, F.lit(1))).otherwise(F.get(data, F.lit(2)))
    mine = (F.col("channel") == "Windows PowerShell") & F.col("event_id").isin("400", "403", "600", "800") & which.isNotNull()
    pairs = F.transform(F.filter(F.split(which, r"\n"), lambda x: x.contains("=")), lambda x: F.struct(F.trim(F.regexp_replace(F.substring_index(x, "=", 1), r"[\t\r]", "")).alias("key"), F.trim(F.regexp_replace(F.substr(x, F.instr(x, "=") + 1), r"[\t\r]", "")).alias("value")))

    def last(ps: Column) -> Column:
        numbered = F.transform(ps, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i")))
        return F.filter(numbered, lambda p: (p["key"] != "") & ~F.exists(F.slice(ps, p["i"] + 2, F.size(ps)), lambda q: q["key"] == p["key"]))

    def merged(x: Column) -> Column:
        found = x["found"]
        fields = F.map_concat(F.map_filter(x["own"], lambda k, v: ~F.array_contains(x["names"], k)), F.transform_values(found, lambda k, v: F.try_variant_get(F.try_parse_json(F.to_json(F.array(v))), "$[0]", "variant")))
        body = F.struct(fields.alias("EventData"), F.try_variant_get("event", "$.Event.System", "variant").alias("System"))
        return F.when(F.size(found) > 0, F.try_parse_json(F.to_json(F.struct(body.alias("Event"))))).otherwise(F.col("event"))

    # Each step is made once a record, and not once for every line and field that a lambda looks at.
    found = F.map_from_entries(F.transform(C.let(pairs, last), lambda p: F.struct(p["key"], p["value"])))
    own = F.try_variant_get("event", "$.Event.EventData", "map<string,variant>")
    whole = C.let(found, lambda m: C.let(F.struct(m.alias("found"), F.map_keys(m).alias("names"), own.alias("own")), merged))
    new = F.when(mine, whole).otherwise(F.col("event"))
    return records.withColumn("event", new).withColumn("data_string", F.to_json("event"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all .json and .jsonl files below a path."""
    return normalized(json_lines(spark, path).unionByName(json_files(spark, path)))
