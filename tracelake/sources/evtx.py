"""Binary event logs as a partitioned source: chunks of 64 KB, a range of chunks of one file a partition.

A chunk has its own strings and templates, so it is read by itself. A record is binary XML: nearly always a template, which the chunk
defines once, with values. A template becomes a tree once a chunk, and a record walks it with its values into JSON: attributes stand beside
their element as NAME_attributes, a Data element with a Name goes by that name, elements of one name become a list.

    spark.dataSource.register(EvtxSource)
    spark.read.format("evtx").load("/logs")          # options: recover, checksums, files

Filters on event_id and channel (equality, in) are taken by the reader where Spark's Python filter pushdown is on (spark.sql.python.filterPushdown.enabled; log_files() sets the option
`pushdown` by it): records of others are passed over before their JSON is made.
`recover` also looks for records in a chunk's free space and in chunks whose header is gone (recovered = true). What cannot be read is a row with `error` and no event; nothing else
of its file is lost. Paths: whatever pyarrow's file systems open.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tracelake.sources import records

# Fixed values of the file format.
HEAD, CHUNK, RECORDS = 4096, 65536, 512
FILE_MARK, CHUNK_MARK, RECORD_MARK = b"ElfFile\0", b"ElfChnk\0", b"**\0\0"
EPOCH_NS = 11_644_473_600 * 1_000_000_000
NUMBERS = {0x03: "<b", 0x04: "<B", 0x05: "<h", 0x06: "<H", 0x07: "<i", 0x08: "<I", 0x09: "<q", 0x0A: "<Q", 0x0B: "<f", 0x0C: "<d"}
FIXED_SIZES = {0x03: 1, 0x04: 1, 0x05: 2, 0x06: 2, 0x07: 4, 0x08: 4, 0x09: 8, 0x0A: 8, 0x0B: 4, 0x0C: 8, 0x0D: 4, 0x0F: 16, 0x11: 8, 0x12: 16, 0x14: 4, 0x15: 8}

#: Chunks of a partition.
CHUNKS_A_PARTITION = 256
SCHEMA = "source_file string, record_id bigint, written_ns bigint, event_id string, channel string, event string, recovered boolean, error string"
_ARROW = pa.schema([("source_file", pa.string()), ("record_id", pa.int64()), ("written_ns", pa.int64()), ("event_id", pa.string()), ("channel", pa.string()), ("event", pa.string()), ("recovered", pa.bool_()), ("error", pa.string())])


class Broken(ValueError):
    pass


def _time(ticks: int) -> str:
    """100 ns since 1601 as RFC 3339 with all digits."""
    whole = datetime(1601, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=ticks // 10_000_000)
    return f"{whole:%Y-%m-%dT%H:%M:%S}.{ticks % 10_000_000:07d}Z"


def scalar(kind: int, raw: bytes) -> object:
    """A value as what JSON has for it; None for none."""
    if kind & 0x80:
        return _list(kind & 0x7F, raw)
    if kind in NUMBERS and len(raw) == struct.calcsize(NUMBERS[kind]):
        return struct.unpack(NUMBERS[kind], raw)[0]
    if kind == 0x10:  # a size: as wide as the machine's words
        return "0x" + format(int.from_bytes(raw, "little"), "x")
    if kind == 0x00:
        return None
    if kind == 0x01:
        return raw.decode("utf-16-le", "replace").rstrip("\0")
    if kind == 0x02:
        return raw.decode("cp1252", "replace").rstrip("\0")
    if kind == 0x0D:
        return any(raw)
    if kind == 0x0E:
        return raw.hex().upper()
    if kind == 0x0F and len(raw) == 16:
        return str(uuid.UUID(bytes_le=raw)).upper()
    if kind == 0x11 and len(raw) == 8:
        return _time(struct.unpack("<Q", raw)[0])
    if kind == 0x12 and len(raw) == 16:
        y, mo, _, d, h, mi, s, ms = struct.unpack("<8H", raw)
        return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"
    if kind == 0x13 and len(raw) >= 8:
        parts = struct.unpack(f"<{raw[1]}I", raw[8 : 8 + 4 * raw[1]])
        return "-".join(["S", str(raw[0]), str(int.from_bytes(raw[2:8], "big")), *map(str, parts)])
    if kind in (0x14, 0x15):
        return "0x" + format(int.from_bytes(raw, "little"), "x")
    raise Broken(f"value of type {kind:#x} and {len(raw)} bytes")


def _list(kind: int, raw: bytes) -> list:
    if kind in (0x01, 0x02):
        text = scalar(kind, raw) if raw else ""
        return text.split("\0") if text else []
    size = FIXED_SIZES.get(kind)
    if not size or len(raw) % size:
        raise Broken(f"list of type {kind:#x} and {len(raw)} bytes")
    return [scalar(kind, raw[i : i + size]) for i in range(0, len(raw), size)]


class Element:
    """A name, attributes (name, parts) and parts: texts, other elements, and (place, optional) of values to be put in."""

    __slots__ = ("attributes", "name", "parts")

    def __init__(self, name: str):
        self.name, self.attributes, self.parts = name, [], []


class Chunk:
    """Binary XML of one chunk."""

    def __init__(self, data: bytes):
        self.data = data
        self.templates: dict[int, tuple[list, int]] = {}
        self.names: dict[int, tuple[str, int]] = {}

    def _u(self, form: str, at: int) -> int:
        return struct.unpack_from(form, self.data, at)[0]

    def _name(self, at: int) -> tuple[str, int]:
        """A string, and its end."""
        if at not in self.names:
            end = at + 8 + 2 * self._u("<H", at + 6)
            self.names[at] = self.data[at + 8 : end].decode("utf-16-le", "replace"), end + 2
        return self.names[at]

    def _named(self, at: int) -> tuple[str, int]:
        """The name that is pointed to at a place; where it stands behind the pointer, the end is behind it."""
        to = self._u("<I", at)
        name, end = self._name(to)
        return name, end if to == at + 4 else at + 4

    def _template(self, at: int) -> tuple[list, int]:
        """A template's parts, and the end of its definition."""
        if at not in self.templates:
            size = self._u("<I", at + 20)
            parts, _ = self.parse(at + 24, at + 24 + size, True)
            self.templates[at] = parts, at + 24 + size
        return self.templates[at]

    def parse(self, at: int, end: int, depends: bool) -> tuple[list, int]:
        """The parts of a fragment and its end. depends: elements carry a dependency, as in templates."""
        root = Element("")
        open_, here = [root], None  # here: the parts that an attribute's value goes to
        while at < end:
            token = self.data[at]
            kind = token & 0xBF
            into = open_[-1].parts if here is None else here
            if kind == 0x00:
                at += 1
                break
            if kind == 0x0F:
                at += 4
            elif kind == 0x01:
                name, behind = self._named(at + (7 if depends else 5))
                open_[-1].parts.append(e := Element(name))
                open_.append(e)
                at = behind + (4 if token & 0x40 else 0)
            elif kind == 0x06:
                name, at = self._named(at + 1)
                open_[-1].attributes.append((name, here := []))
            elif kind == 0x02:
                at, here = at + 1, None
            elif kind in (0x03, 0x04):
                if len(open_) == 1:
                    raise Broken("an end without an element")
                open_.pop()
                at, here = at + 1, None
            elif kind == 0x05:
                if self.data[at + 1] != 0x01:
                    raise Broken("a text that is no string")
                n = self._u("<H", at + 2)
                into.append(self.data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"))
                at += 4 + 2 * n
            elif kind == 0x07:
                n = self._u("<H", at + 1)
                into.append(self.data[at + 3 : at + 3 + 2 * n].decode("utf-16-le", "replace"))
                at += 3 + 2 * n
            elif kind == 0x08:
                into.append(chr(self._u("<H", at + 1)))
                at += 3
            elif kind == 0x09:
                name, at = self._named(at + 1)
                into.append({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(name, f"&{name};"))
            elif kind == 0x0A:
                _, at = self._named(at + 1)
            elif kind == 0x0B:
                at += 3 + 2 * self._u("<H", at + 1)
            elif kind in (0x0D, 0x0E):
                into.append((self._u("<H", at + 1), kind == 0x0E))
                at += 4
            elif kind == 0x0C:
                parts, values, at = self._instance(at)
                into.append((parts, values))
            else:
                raise Broken(f"token {token:#x}")
        if len(open_) > 1:
            raise Broken("an element without an end")
        return root.parts, at

    def _instance(self, at: int) -> tuple[list, list, int]:
        """A template's parts and a record's values, and their end."""
        to = self._u("<I", at + 6)
        parts, behind = self._template(to)
        at = behind if to == at + 10 else at + 10
        n = self._u("<I", at)
        if 4 * n > CHUNK:
            raise Broken(f"{n} values")
        heads = [struct.unpack_from("<HB", self.data, at + 4 + 4 * i) for i in range(n)]
        at, values = at + 4 + 4 * n, []
        for size, kind in heads:
            if at + size > len(self.data):
                raise Broken("a value beyond the chunk")
            if kind == 0x21:
                values.append(self.parse(at, at + size, False)[0] if size else None)
            else:
                values.append(scalar(kind, self.data[at : at + size]))
            at += size
        return parts, values, at


def _content(parts: list, values: list) -> object:
    """What an element's parts come to: an object of its elements, a value, or text."""
    texts, elements = [], []
    for p in parts:
        if isinstance(p, Element):
            elements.append((p, values))
        elif isinstance(p, str):
            texts.append(p)
        elif isinstance(p[0], list):  # a template within
            elements += [(x, p[1]) for x in p[0] if isinstance(x, Element)]
        else:
            v = values[p[0]] if p[0] < len(values) else None
            if isinstance(v, list) and any(isinstance(x, (Element, tuple)) for x in v):  # binary XML as a value
                for x in v:
                    elements += [(x, [])] if isinstance(x, Element) else [(y, x[1]) for y in x[0] if isinstance(y, Element)]
            elif v is not None:
                texts.append(v)
    if elements:
        return _object(elements)
    return texts[0] if len(texts) == 1 else "".join(map(str, texts)) if texts else None


def _object(elements: list) -> dict:
    out: dict = {}
    for e, values in elements:
        inside = _content(e.parts, values)
        attributes = {k: v for k, parts in e.attributes if (v := _content(parts, values)) is not None}
        name = e.name
        if name == "Data" and "Name" in attributes:
            name = str(attributes.pop("Name"))
        if attributes:
            out[f"{name}_attributes"] = attributes
        if inside is None and attributes:
            continue
        if name in out:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), inside]
        else:
            out[name] = inside
    return out


def _system(event: dict, name: str) -> str | None:
    got = (event.get("Event") or {}).get("System") if isinstance(event.get("Event"), dict) else None
    got = got.get(name) if isinstance(got, dict) else None
    return None if got is None or isinstance(got, (dict, list)) else str(got)


@dataclass
class Row:
    record_id: int | None
    written_ns: int | None
    event: dict | None
    recovered: bool = False
    error: str | None = None


def _record(chunk: Chunk, at: int, recovered: bool) -> tuple[Row | None, int]:
    """The record at a place and its end; None if there is none that holds."""
    data = chunk.data
    if at + 28 > len(data) or data[at : at + 4] != RECORD_MARK:
        return None, at
    size, number, ticks = struct.unpack_from("<IQQ", data, at + 4)
    if size < 28 or at + size > len(data) or struct.unpack_from("<I", data, at + size - 4)[0] != size:
        return None, at
    head = (number, ticks * 100 - EPOCH_NS)
    try:
        parts, _ = chunk.parse(at + 24, at + size - 4, True)
        return Row(*head, _content(parts, []), recovered), at + size
    except (Broken, struct.error, IndexError, RecursionError, OverflowError) as e:
        return Row(*head, None, recovered, f"record {number}: {e}"), at + size


def read_chunk(data: bytes, recover: bool = False, checksums: bool = False) -> Iterator[Row]:
    """The records of a chunk; with recover also those in its free space, or in a chunk without a header."""
    chunk, free = Chunk(data), RECORDS
    if data[:8] == CHUNK_MARK:
        free = min(max(struct.unpack_from("<I", data, 48)[0], RECORDS), len(data))
        if checksums and len(data) >= RECORDS and (zlib.crc32(data[128:RECORDS], zlib.crc32(data[:120])) != struct.unpack_from("<I", data, 124)[0] or zlib.crc32(data[RECORDS:free]) != struct.unpack_from("<I", data, 52)[0]):
            yield Row(None, None, None, False, "checksum of a chunk")
            return
        at = RECORDS
        while at < free:
            row, behind = _record(chunk, at, False)
            if row is None:
                yield Row(None, None, None, False, f"no record at {at}")
                break
            yield row
            at = behind
    elif not recover:
        if data.strip(b"\0"):
            yield Row(None, None, None, False, "a chunk without a header")
        return
    at = free
    while recover and (at := data.find(RECORD_MARK, at)) >= 0:
        row, behind = _record(chunk, at, True)
        if row is not None and row.error is None and isinstance(row.event, dict):
            yield row
        at = max(behind, at + 4)


@dataclass
class Chunks(InputPartition):
    path: str
    first: int
    count: int


class EvtxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("suffix", ".evtx")
        self.only = set(json.loads(options["files"])) if options.get("files") else None
        self.recover, self.checksums = (str(options.get(k, "false")).lower() == "true" for k in ("recover", "checksums"))
        self.wanted: dict[str, set[str]] = {}

    def _files(self) -> list[fs.FileInfo]:
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((f for f in found if f.type == fs.FileType.File and (f is info or f.base_name.lower().endswith(self.glob))), key=lambda f: f.path)

    def partitions(self) -> list[InputPartition]:
        out = []
        for f in self._files():
            if self.only is not None and f.path not in self.only:
                continue
            n = max(1, -(-(f.size - HEAD) // CHUNK))
            out += [Chunks(f.path, k, min(CHUNKS_A_PARTITION, n - k)) for k in range(0, n, CHUNKS_A_PARTITION)]
        return out

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_file(partition.path) as f:
            if f.read(8) != FILE_MARK:
                if partition.first == 0:
                    yield self._batch(partition.path, [Row(None, None, None, False, "not a log file")])
                return
            for k in range(partition.first, partition.first + partition.count):
                f.seek(HEAD + k * CHUNK)
                yield self._batch(partition.path, list(read_chunk(f.read(CHUNK), self.recover, self.checksums)))

    def _batch(self, path: str, rows: list[Row]) -> pa.RecordBatch:
        out = []
        for r in rows:
            ids = {"event_id": _system(r.event, "EventID"), "channel": _system(r.event, "Channel")} if isinstance(r.event, dict) else {"event_id": None, "channel": None}
            if all(ids[k] in v for k, v in self.wanted.items()):
                out.append({"source_file": path, "record_id": r.record_id, "written_ns": r.written_ns, **ids, "event": json.dumps(r.event, ensure_ascii=False) if isinstance(r.event, dict) else None, "recovered": r.recovered, "error": r.error})
        return pa.RecordBatch.from_pylist(out, schema=_ARROW)


class FilteringReader(EvtxReader):
    """The reader for sessions in which Spark hands filters to Python sources; in others it may not have the method."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("event_id", "channel"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f


class EvtxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EvtxReader:
        pushed = str(self.options.get("pushdown", "false")).lower() == "true"
        return (FilteringReader if pushed else EvtxReader)(dict(self.options))


def listing(path: str) -> list[tuple[str, int, int]]:
    """source_file, size and time of change (ns) of all .evtx files below a path."""
    return [(f.path, f.size, f.mtime_ns or 0) for f in EvtxReader({"path": path})._files()]


def log_files(spark: SparkSession, path: str, recover: bool = False, checksums: bool = False, files: list[str] | None = None) -> DataFrame:
    """Rows of SCHEMA of all .evtx files below a path, or of those of `files` alone (as in source_file): others are not opened. Filters on event_id and channel go to the reader where spark.sql.python.filterPushdown.enabled is true."""
    spark.dataSource.register(EvtxSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("evtx").option("recover", recover).option("checksums", checksums).option("pushdown", pushed)
    return (reader if files is None else reader.option("files", json.dumps(files))).load(path)


def read_logs(spark: SparkSession, path: str, recover: bool = False, checksums: bool = False, event_ids: list[str] | None = None, channels: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """Records of all .evtx files below a path; event_ids, channels, files: of these alone."""
    rows = log_files(spark, path, recover, checksums, files).where("error is null")
    for name, wanted in (("event_id", event_ids), ("channel", channels)):
        if wanted is not None:
            rows = rows.where(F.col(name).isin([str(x) for x in wanted]))
    rows = rows.select("source_file", F.parse_json("event").alias("event"), F.col("recovered").alias("_recovered"), F.col("record_id").cast("string").alias("_number"), F.col("written_ns").alias("_written"))
    out = records.with_columns(rows)
    return out.withColumns({
        "recovered": F.col("_recovered"), "record_id": F.coalesce("record_id", "_number"),
        "event_ts": F.coalesce("event_ts", F.timestamp_micros(F.floor(F.col("_written") / 1000))), "event_ts_ns": F.coalesce("event_ts_ns", "_written"),
    }).drop("_recovered", "_number", "_written")
