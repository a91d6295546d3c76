"""Binary logs: the events table written as chunks and read back, values of all types, damage, recovery."""

from __future__ import annotations

import json
import struct

import duckdb
import pytest
from evtx_writer import ChunkWriter, file_bytes, text
from pyspark.sql import functions as F

from tracelake import catalog
from tracelake.engine import Engine
from tracelake.sources import evtx

SF = "/root/testdata/sf0.001"
FIELDS = ("TargetUserName", "SubjectUserName", "CommandLine", "LogonType", "Code")
SYSTEM = ("System", [], [
    ("Provider", [("Name", 0)], []), ("EventID", [("Qualifiers", "0")], [1]), ("Channel", [], [2]), ("Computer", [], [3]), ("EventRecordID", [], [4]),
    ("TimeCreated", [("SystemTime", 5)], []), ("Keywords", [], [-6]),
])
TEMPLATE = ("Event", [("xmlns", "http://schemas.microsoft.com/win/2004/08/events/event")], [SYSTEM, ("EventData", [], [("Data", [("Name", f)], [-(7 + i)]) for i, f in enumerate(FIELDS)])])


def values(r) -> list[tuple[int, bytes]]:
    ticks = (r.event_ts_ns + evtx.EPOCH_NS) // 100
    data = json.loads(r.data_string)["Event"]["EventData"]
    return [
        text(f"prov-{r.channel}"), (0x06, struct.pack("<H", int(r.event_id))), text(r.channel), text(r.computer), (0x0A, struct.pack("<Q", int(r.record_id))), (0x11, struct.pack("<Q", ticks)),
        (0x15, struct.pack("<Q", 0x8020000000000000)), *[text(data[f]) if data.get(f) is not None else (0x00, b"") for f in FIELDS],
    ]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The events of the smallest table, in files by channel."""
    top = tmp_path_factory.mktemp("logs")
    rows = catalog.records(spark, SF).orderBy("event_ts_ns").collect()
    for channel in sorted({r.channel for r in rows}):
        chunks, now = [], ChunkWriter()
        for r in (r for r in rows if r.channel == channel):
            if not now.record(int(r.record_id), r.event_ts_ns, "event", TEMPLATE, values(r)):
                chunks.append(now.bytes())
                now = ChunkWriter()
                assert now.record(int(r.record_id), r.event_ts_ns, "event", TEMPLATE, values(r))
        (top / channel).mkdir()
        (top / channel / f"{channel}.evtx").write_bytes(file_bytes([*chunks, now.bytes()]))
    return str(top)


def test_events_come_back(spark, written, monkeypatch):
    monkeypatch.setattr(evtx, "CHUNKS_A_PARTITION", 1)
    got = evtx.read_logs(spark, written)
    assert evtx.log_files(spark, written).where("error is not null").count() == 0
    shown = got.select("record_id", "event_id", "channel", "computer", "event_ts_ns", *[F.try_variant_get("event", f"$.Event.EventData.{f}", "string").alias(f) for f in FIELDS])
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    want = con.sql(f"WITH {catalog.RECS} SELECT record_id, event_id, channel, computer, ns, target, subject, command, logon_type, code FROM recs").fetchall()
    assert sorted(map(str, (tuple(r) for r in shown.collect()))) == sorted(map(str, want))


def test_rules_over_logs(spark, written):
    engine = Engine(spark, catalog.fields())
    rules = catalog.linked(catalog.rule("r", {"s": {"EventID": 4625, "TargetUserName|startswith": "user1"}}))
    key = lambda df: sorted(map(str, df.select("rule_id", "computer", "event_id", "record_id").collect()))
    assert key(engine.timeline(engine.read_logs(written), rules)) == key(engine.timeline(catalog.records(spark, SF), rules)) != []


def test_filters_reach_the_reader(spark, written):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        all_ = evtx.log_files(spark, written)
        rows = all_.collect()
        some = all_.where("event_id in ('4625', '4624') and channel = 'Security' and record_id > 10")
        assert some.count() == len([r for r in rows if r.event_id in ("4624", "4625") and r.record_id > 10])
        assert evtx.read_logs(spark, written, event_ids=["4625"], channels=["Security"]).count() == len([r for r in rows if r.event_id == "4625"])
        reader = evtx.FilteringReader({"path": written})
        from pyspark.sql.datasource import EqualTo, GreaterThan, In

        left = list(reader.pushFilters([EqualTo(("event_id",), "4625"), In(("event_id",), ("4625", "4624")), GreaterThan(("record_id",), 3)]))
        assert left == [GreaterThan(("record_id",), 3)] and reader.wanted == {"event_id": {"4625"}}
        assert {x for p in reader.partitions() for b in reader.read(p) for x in b.column("event_id").to_pylist()} == {"4625"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_values_and_shapes():
    sid = bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, 544)
    cases = [
        (text("a\0"), "a"), ((0x02, b"\xe9"), "é"), ((0x03, b"\xff"), -1), ((0x08, b"\1\0\0\0"), 1), ((0x09, b"\xfe" + b"\xff" * 7), -2), ((0x0B, struct.pack("<f", 0.5)), 0.5), ((0x0D, b"\1\0\0\0"), True),
        ((0x0E, b"\x01\xab"), "01AB"), ((0x0F, bytes(range(16))), "03020100-0504-0706-0809-0A0B0C0D0E0F"), ((0x11, struct.pack("<Q", 116_444_736_001_234_567)), "1970-01-01T00:00:00.1234567Z"),
        ((0x12, struct.pack("<8H", 2024, 2, 4, 29, 1, 2, 3, 4)), "2024-02-29T01:02:03.004Z"), ((0x13, sid), "S-1-5-32-544"), ((0x14, b"\x10\0\0\0"), "0x10"), ((0x81, "x\0y".encode("utf-16-le")), ["x", "y"]), ((0x88, b"\1\0\0\0\2\0\0\0"), [1, 2]),
    ]
    template = ("Event", [], [("EventData", [], [("Data", [("Name", f"v{i}")], [i]) for i in range(len(cases))])])
    w = ChunkWriter()
    assert w.record(1, 0, "t", template, [c for c, _ in cases])
    # Unnamed data become a list, an element of attributes alone has no value of its own, texts and values join; optional nulls leave an attribute out.
    plain = ("Event", [], [("EventData", [], [("Data", [], ["one"]), ("Data", [], [0]), ("Data", [], [-1]), ("Binary", [("Size", "2"), ("Left", -1)], []), ("Mixed", [], ["n=", 0]), ("Empty", [], [])])])
    assert w.record(2, 0, "p", plain, [text("two"), (0x00, b"")])
    got = list(evtx.read_chunk(w.bytes(), checksums=True))
    assert [r.error for r in got] == [None, None]
    assert got[0].event == {"Event": {"EventData": {f"v{i}": want for i, (_, want) in enumerate(cases)}}}
    assert got[1].event == {"Event": {"EventData": {"Data": ["one", "two", None], "Binary_attributes": {"Size": "2"}, "Mixed": "n=two", "Empty": None}}}


def test_binary_xml_as_value():
    w = ChunkWriter()
    w.record(1, 0, "names", ("Event", [], [("UserData", [], []), ("Inner", [], []), ("Key", [], [])]), [])
    inner = bytearray(b"\x0f\x01\x01\x00")
    w.element(inner, 0, ("Inner", [("Key", "k")], [("Key", [], ["deep"])]), depends=False)
    assert w.record(2, 0, "t", ("Event", [], [("UserData", [], [0])]), [(0x21, bytes(inner + b"\0"))])
    got = list(evtx.read_chunk(w.bytes()))
    assert got[1].event == {"Event": {"UserData": {"Inner_attributes": {"Key": "k"}, "Inner": {"Key": "deep"}}}}


def test_damage_and_recovery(spark, tmp_path):
    """Broken chunks and records cost no others; deleted records and chunks without a header come back with recover alone."""
    w = ChunkWriter()
    template = ("Event", [], [("System", [], [("EventID", [], [0]), ("Channel", [], ["C"])])])
    for k in range(6):
        assert w.record(k + 1, 10**9 * k, "t", template, [(0x06, struct.pack("<H", 100 + k))])
    whole = w.bytes()
    deleted = w.bytes(free=w.numbers[4][1])
    headless = bytes(8) + whole[8:]
    broken = bytearray(whole)
    broken[w.numbers[2][1] + 40] = 0xFF  # in the third record's values
    cut = bytearray(whole)
    cut[w.numbers[3][1]] = 0
    (tmp_path / "a.evtx").write_bytes(file_bytes([whole, deleted, headless, bytes(65536), bytes(broken)]))
    (tmp_path / "b.evtx").write_bytes(b"nothing")
    (tmp_path / "c.EVTX").write_bytes(file_bytes([bytes(cut)])[:-100])
    (tmp_path / "d.txt").write_bytes(b"other")
    (tmp_path / "e.evtx").write_bytes(b"")
    rows = evtx.log_files(spark, str(tmp_path)).collect()
    ids = lambda name, rows_, **f: [r.event_id for r in rows_ if r.source_file.endswith(name) and r.error is None and all(r[k] == v for k, v in f.items())]
    every = [str(100 + k) for k in range(6)]
    assert ids("a.evtx", rows, recovered=False) == every + every[:4] + every[:2] + every[3:] and not any(r.recovered for r in rows)
    assert sorted(r.error.split(":")[0] for r in rows if r.error and r.source_file.endswith("a.evtx")) == ["a chunk without a header", "record 3"]
    assert [r.error for r in rows if r.source_file.endswith("b.evtx") or r.source_file.endswith("e.evtx")] == ["not a log file"] * 2
    assert ids("c.EVTX", rows) == every[:3] and sum(r.error is not None for r in rows if r.source_file.endswith("c.EVTX")) == 1
    more = evtx.log_files(spark, str(tmp_path), recover=True).collect()
    assert ids("a.evtx", more, recovered=False) == ids("a.evtx", rows) and ids("a.evtx", more, recovered=True) == every[4:] + every
    found = evtx.read_logs(spark, str(tmp_path), recover=True)
    assert found.where("recovered").count() == 8 and found.where("event_ts_ns = 4000000000 and recovered").count() == 2
    assert list(evtx.read_chunk(bytes(broken), checksums=True))[0].error == "checksum of a chunk"


def test_files_of_other_channels_stay_unread(spark, written, tmp_path, monkeypatch):
    import os
    import shutil

    from tracelake.sources.file_channels import FileChannels

    logs = str(tmp_path / "logs")
    shutil.copytree(written, logs)
    both = ChunkWriter()
    for k, channel in enumerate(("System", "Security")):
        both.record(k + 1, 0, "t", ("Event", [], [("System", [], [("EventID", [], [0]), ("Channel", [], [1])])]), [(0x06, struct.pack("<H", 4625)), text(channel)])
    (tmp_path / "logs" / "both.evtx").write_bytes(file_bytes([both.bytes()]))
    (tmp_path / "logs" / "none.evtx").write_bytes(b"broken")
    known = FileChannels(spark, str(tmp_path / "side"))
    assert known.update(logs) == 4 and known.update(logs) == 0 and known.channels() == {"Security", "System"}
    rules = catalog.linked(catalog.rule("r", {"s": {"EventID": 4625, "Channel": "Security"}}))
    files = known.files(rules)
    assert [os.path.basename(f) for f in files] == ["Security.evtx", "both.evtx"]
    assert {p.path for p in evtx.EvtxReader({"path": logs, "files": json.dumps(files)}).partitions()} == set(files)
    engine = Engine(spark, catalog.fields())
    key = lambda df: sorted(map(str, df.select("source_file", "record_id").collect()))
    some = engine.read_logs(logs, files=files)
    assert {r.source_file for r in some.select("source_file").distinct().collect()} == set(files)
    assert key(engine.timeline(some, rules)) == key(engine.timeline(engine.read_logs(logs), rules)) != []
    assert known.files([*rules, *catalog.linked(catalog.rule("any", {"s": {"EventID": 1}}))]) is None
    # A changed file is read again, and its old channels go.
    one = ChunkWriter()
    one.record(1, 0, "t", ("Event", [], [("System", [], [("EventID", [], [0]), ("Channel", [], ["Other"])])]), [(0x06, struct.pack("<H", 1))])
    (tmp_path / "logs" / "both.evtx").write_bytes(file_bytes([one.bytes(), one.bytes()]))
    assert known.update(logs) == 1 and [os.path.basename(f) for f in known.files(rules)] == ["Security.evtx"] and "Other" in known.channels()
