"""Large JSON files, an array or objects one after another, read by many tasks.

Spark's text reader cuts files into ranges of bytes and ranges at every `}`. Whether a brace closes an object at the top depends on all that stands before it, but
little of that: whether a string is open, and how deep the brackets are.

1. Of each range: whether it leaves strings as it found them, and by how much it deepens the brackets, for either state that it may begin in.
2. Summed over the ranges before, a file's ranges know the state that they begin in.
3. Each range gives the objects that begin and end in it. What it ends of an object before, and begins of one behind it, are fragments, two a range, which are put together by file.

A task holds an object at most. An object that does not close takes what follows in its file with it, as one rejected text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPED = re.compile(rb"\\.", re.S)
_STATES = "source_file string, block bigint, flips int, deeper0 bigint, deeper1 bigint, bytes bigint, first string"
_CUT = "source_file string, file_size bigint, block bigint, place int, closed boolean, value binary"


def _depth(piece: bytes, inside: int) -> tuple[int, int]:
    """Of what stands before a brace: whether it ends in a string, and how much deeper the brackets are there."""
    parts = (_ESCAPED.sub(b"", piece) if b"\\" in piece else piece).split(b'"')
    deeper = sum(p.count(b"{") + p.count(b"[") - p.count(b"]") for p in parts[inside::2])
    return inside ^ (len(parts) - 1) & 1, deeper


def _pieces(spark: SparkSession, path: str, pattern: str, least: int) -> DataFrame:
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    return rows.where(F.col("file_size") >= least)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range."""
    now, out = None, {}

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"source_file": now[0], "block": now[1], "flips": out["state"][0], "deeper0": out["deeper"][0], "deeper1": out["deeper"][1], "bytes": out["bytes"], "first": out["first"]}], schema=pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("flips", pa.int32()), ("deeper0", pa.int64()), ("deeper1", pa.int64()), ("bytes", pa.int64()), ("first", pa.string())]))

    for batch in batches:
        for file, block, piece in zip(*(batch.column(c).to_pylist() for c in ("source_file", "block", "value"))):
            if (file, block) != now:
                if now:
                    yield row()
                now, out = (file, block), {"state": [0, 1], "deeper": [0, 0], "bytes": 0, "first": None}
            for k in (0, 1):
                out["state"][k], more = _depth(piece, out["state"][k])
                out["deeper"][k] += more - (not out["state"][k])
            out["bytes"] += len(piece) + 1
            if out["first"] is None and (start := piece.removeprefix(b"\xef\xbb\xbf").lstrip()):
                out["first"] = chr(start[0])
    if now:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole objects (place null) and fragments: what ends an object of a range before (place 0), what begins one (place 1)."""
    schema = pa.schema([("source_file", pa.string()), ("file_size", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("closed", pa.bool_()), ("value", pa.binary())])
    now, text, waiting, head, found = None, [], None, False, []
    inside = deep = base = 0
    open_end = False

    def take(piece: bytes, brace: bool) -> None:
        nonlocal text, head, inside, deep
        inside, more = _depth(piece, inside)
        deep += more - (brace and not inside)
        text.append(piece + b"}" if brace else piece)
        if brace and not inside and deep == base:
            give(True)
            head = False

    def give(closed: bool) -> None:
        nonlocal text
        if any(text):
            place = 0 if head else None if closed else 1
            found.append({"source_file": now[0], "file_size": now[1], "block": now[2], "place": place, "closed": closed, "value": b"".join(text)})
        text = []

    def end() -> None:
        if now:
            take(waiting, not open_end)
            give(False)

    for batch in batches:
        names = ("source_file", "file_size", "block", "value", "inside", "deep", "base", "open_end")
        for file, size, block, piece, inside_, deep_, base_, open_ in zip(*(batch.column(c).to_pylist() for c in names)):
            if (file, size, block) != now:
                end()
                now, text, inside, deep, base, open_end = (file, size, block), [], inside_, deep_, base_, open_
                # A range that begins a file, or behind a whole object, has no end of one before it.
                head = block > 0 and not (inside == 0 and deep == base)
            else:
                take(waiting, True)
            waiting = piece
        yield pa.RecordBatch.from_pylist(found, schema=schema)
        found.clear()
    end()
    yield pa.RecordBatch.from_pylist(found, schema=schema)


def objects(spark: SparkSession, path: str, pattern: str = "*.json", least: int = 0) -> DataFrame:
    """value, source_file, file_size: the text of each object at the top of the files of `least` bytes or more; other text, too, but for commas and outer brackets."""
    pieces = _pieces(spark, path, pattern, least)
    sizes = pieces.select("source_file", "block", "value").mapInArrow(_measure, _STATES)
    in_turn = Window.partitionBy("source_file").orderBy("block")
    before, whole = in_turn.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source_file")
    states = sizes.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    states = states.withColumn("deep", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("deeper0")).otherwise(F.col("deeper1"))).over(before), F.lit(0)))
    begins = F.min(F.when(F.col("first").isNotNull(), F.struct("block", "first"))).over(whole)
    states = states.withColumns({"base": F.when(begins["first"] == "[", 1).otherwise(0), "_total": F.sum("bytes").over(whole), "_last": F.col("block") == F.max("block").over(whole)})
    states = states.select(F.col("source_file").alias("_file"), F.col("block").alias("_block"), F.col("inside").cast("int").alias("inside"), "deep", "base", "_total", "_last")
    # A row for each range of bytes.
    known = pieces.join(F.broadcast(states), (F.col("source_file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    # Every piece was counted with a brace; where the file has a byte less, its last piece has none. The reader leaves out a mark of three bytes at the start of a file.
    known = known.select("source_file", "file_size", "block", "value", "inside", "deep", "base", (F.col("_last") & (F.col("_total") - F.col("file_size")).isin(1, -2)).alias("open_end"))
    cut = known.mapInArrow(_cut, _CUT)
    order = Window.partitionBy("source_file").orderBy("block", "place")
    parts = cut.where("place is not null").withColumn("_object", F.coalesce(F.sum(F.col("closed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = parts.groupBy("source_file", "file_size", "_object").agg(F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("_parts"))
    joined = joined.select("source_file", "file_size", F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["value"])).alias("value"))
    text = cut.where("place is null").select("source_file", "file_size", "value").unionByName(joined).withColumn("value", F.decode("value", "UTF-8"))
    text = text.withColumn("value", F.regexp_replace("value", r"^\uFEFF?[\s,\[]*+", ""))
    return text.where(~F.col("value").rlike(r"^[\s,\]]*\z")).select("value", "source_file", "file_size")
