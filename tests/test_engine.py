from __future__ import annotations

import json
import os

import duckdb
import pytest

import __spark_entry__
from tracelake import catalog
from tracelake.engine import Engine
from tracelake.functions import columns as C

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(repr(tuple(None if x != x else (float(x) if isinstance(x, float) else x) for x in r)) for r in frame)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = rows_of(tuple(r) for r in df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    cur = duck.execute(f"select {quoted} from ({catalog.oracles()[name]})")
    assert got == rows_of(cur.fetchall())


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracles())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"EventID": 1, "Channel": "S", "Hostname": "h", "@timestamp": "2024-01-01T00:00:00.1234567Z"}\n\nnot json\n')
    (tmp_path / "b.json").write_text('[{"EventID": 2, "Channel": "S"}, {"EventID": 3}]')
    (tmp_path / "c.json").write_text('{"EventID": 4}\n{"EventID": 5}')
    (tmp_path / "d.json").write_text('{"fields": ["EventID", "Channel"], "rows": [["6", "T"], ["7"]]}')
    (tmp_path / "e.json").write_text('{"result": {"EventID": 8, "_time": "2024-01-02T00:00:00Z"}}')
    got = {r["event_id"]: r for r in Engine(spark).read(str(tmp_path)).collect()}
    assert set(got) == set("12345678")
    assert got["1"]["computer"] == "h" and got["1"]["event_ts_ns"] % 1_000_000_000 == 123_456_700
    assert got["6"]["channel"] == "T" and got["8"]["event_ts"] is not None


def test_columns(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("192.168.1.9", "2001:db8::1", "0x1F", "42", "a  b\tc")], "v4 string, v6 string, hex string, n string, s string")
    r = one.select(C.in_cidr(F.col("v4"), "192.168.0.0/16").alias("a"), C.in_cidr(F.col("v6"), "2001:db8::/32").alias("b"), C.in_cidr(F.col("n"), "10.0.0.0/8").alias("c"),
                   C.hex_to_decimal(F.col("hex")).alias("d"), C.unsigned(F.col("n")).alias("e"), C.collapse_spaces(F.col("s")).alias("f"), C.uptime(F.lit(90061)).alias("g"), C.typed_scalar(F.col("n")).alias("h")).first()
    assert (r.a, r.b, r.c, r.d, int(r.e), r.f, r.g, r.h) == (True, True, False, "31", 42, "a b c", "0Y 0M 1d 1h 1m 1s", "42")


def test_timeline_with_profile(spark, tmp_path):
    (tmp_path / "r.yml").write_text(json.dumps(catalog.rule("x", {"s": {"EventID": 4625}}, details="%TargetUserName%")))
    engine = Engine(spark, catalog.fields())
    loaded = engine.rules(str(tmp_path / "r.yml"))
    assert not loaded.errors
    out = engine.timeline(catalog.records(spark, SF), loaded.rules, {"Time": "%Timestamp%", "Level": "%Level%", "Details": "%Details%"})
    assert out.columns == ["Time", "Level", "Details"] and out.first()["Details"].startswith("user")


def test_places(spark):
    from tracelake.operators import render

    want = {
        "8.1.0.9": ("AS1", "X", "a"), "::ffff:8.1.0.9": ("AS1", "X", "a"), "9.9.9.9": ("-", "-", "-"), "2a0e:77::1": ("AS6", "J", "t"), "2A0E:0077:FFFF::": ("AS6", "J", "t"), "2a0e:78::": ("-", "-", "-"),
        "64:ff9b::8.1.0.9": ("AS7", "N", "n"), "2a01::5": ("AS8", "W", "w"), "0.0.0.0": ("Local", "-", "-"), "LOCAL": ("Local", "-", "-"), "::1": ("Local", "-", "-"), "::ffff:127.0.0.1": ("Local", "-", "-"),
        "::ffff:10.0.0.1": ("Private", "-", "-"), "::": ("Private", "-", "-"), "fe80::a1:b2:c3:d4": ("Private", "-", "-"), "ff02::1": ("Private", "-", "-"), "fdaa:bb:cc::dd": ("Private", "-", "-"), "host": ("-", "-", "-"),
    }
    tail = "asn string, country string, city string"
    ranges = spark.createDataFrame([(0x08010000, 0x0801FFFF, "AS1", "X", "a")], f"first long, last long, {tail}")
    last = ":ffff:ffff:ffff:ffff:ffff:ffff"
    ranges6 = spark.createDataFrame([("2a0e:77::", f"2a0e:77{last}", "AS6", "J", "t"), ("64:ff9b::", "64:ff9b::255.255.255.255", "AS7", "N", "n"), ("2a00::", f"2a01:ffff{last}", "AS8", "W", "w")], f"first string, last string, {tail}")
    out = render.places(spark.createDataFrame([(k,) for k in want] * 2, "ip string"), "ip", ranges, "src", ranges6).collect()
    assert len(out) == 2 * len(want) and {r.ip: (r.src_asn, r.src_country, r.src_city) for r in out} == want


def test_profile_kinds(spark, tmp_path):
    from tracelake.operators import render

    tags = ["attack.execution", "attack.t1059.001", "attack.g0007", "attack.s0002", "attack.stealth", "car.2016"]
    (tmp_path / "r.yml").write_text(json.dumps(catalog.rule("x", {"s": {"EventID": 4625}}, tags=tags, modified="2024-02-03")))
    ranges = spark.createDataFrame([(0, 0xFFFFFFFF, "AS1", "X", "a")], "first long, last long, asn string, country string, city string")
    engine = Engine(spark, catalog.fields(), places=render.Places(ranges, ["None", "IpAddress"], [], {"Security": ["4625"]}))
    rules = engine.rules(str(tmp_path / "r.yml")).rules
    names = ("MitreTactics", "MitreTags", "OtherTags", "Status", "RuleCreationDate", "RuleModifiedDate", "RecoveredRecord", "SrcASN", "SrcCountry", "SrcCity", "TgtASN", "TgtCountry", "TgtCity")
    profile = {n: f"%{n}%" for n in names} | {"desc": "fixed"}
    records = catalog.records(spark, SF).withColumn("recovered", C.truth(C.F.col("record_id") == "-1"))
    out = {tuple(r) for r in engine.timeline(records, rules, profile).collect()}
    assert out == {("Exec ¦ Stealth", "T1059.001 ¦ G0007 ¦ S0002", "car.2016", "test", "2024-01-01", "2024-02-03", "", "Private", "-", "-", "", "", "", "fixed")}
    recovered = records.withColumn("recovered", C.F.lit(True))
    assert {r.R for r in engine.timeline(recovered, rules, {"R": "%RecoveredRecord%"}).collect()} == {"Y"}
    with pytest.raises(ValueError):
        engine.timeline(records, rules, {"A": "%NoSuchKind%"})
    with pytest.raises(ValueError):
        Engine(spark, catalog.fields()).timeline(records, rules, {"A": "%SrcASN%"})


def test_required_channels():
    from tracelake.operators.match import prune
    from tracelake.plans.rule import from_doc, required_channels

    sec, sys_, other = {"Channel": "Security"}, {"Channel|endswith": ["System", "Setup"]}, {"EventID": 1}
    want = [
        ({"s": sec}, {"Security"}), ({"s": sec | other}, {"Security"}), ({"s": [sec, sys_]}, {"Security", "System", "Setup"}), ({"s": [sec, other]}, None), ({"s": {"Channel": "*"}}, None),
        ({"s": {"Channel": "Sec?rity"}}, None), ({"s": {"Channel|re": "Sec.*"}}, None), ({"s": {"Channel": ["Security", None]}}, None), ({"k": ["word"]}, None),
        ({"a": sec, "b": other, "condition": "a and b"}, {"Security"}), ({"a": sec, "b": other, "condition": "a or b"}, None), ({"a": sec, "b": other, "condition": "b and not a"}, None),
        ({"s_1": sec, "s_2": sys_, "condition": "1 of s_*"}, {"Security", "System", "Setup"}), ({"a": sec, "condition": "a | count() by Computer >= 3", "timeframe": "1h"}, {"Security"}),
    ]
    for detection, need in want:
        assert required_channels(from_doc(catalog.rule("x", detection))) == need, detection
    rules = [from_doc(catalog.rule("a", {"s": sec})), from_doc(catalog.rule("b", {"s": other})), from_doc(catalog.rule("c", {"s": {"Channel": "*-Sysmon/Operational"}}))]
    assert [r.id for r in prune(rules, {"Microsoft-Windows-Sysmon/Operational"})] == ["b", "c"]


def test_channels_are_pruned_without_loss(spark):
    from tracelake.operators import match

    records = catalog.records(spark, SF)
    docs = [catalog.rule("a", {"s": {"Channel": "system", "LogonType": "3"}}), catalog.rule("b", {"s": {"Channel": "SYS*"}, "condition": "s | count() by Computer >= 2", "timeframe": "6h"})]
    rules = catalog.linked(*docs)
    found = match.detect(records, rules, catalog.fields())
    assert "rlike" in found._jdf.queryExecution().optimizedPlan().toString().lower()
    plain = match.detect(records, catalog.linked(*docs, catalog.rule("c", {"s": {"EventID": -1}}), catalog.rule("d", {"s": {"EventID": -1}, "condition": "s | count() >= 1"})), catalog.fields())
    show = lambda df: sorted(map(repr, df.select("rule_id", "event_ts_ns", "record_id", "agg_text").collect()))
    assert show(found) == show(plain) and {r.rule_id for r in found.select("rule_id").distinct().collect()} == {"a", "b"}


def test_timeline_sorts_what_is_already_matched(spark):
    """The sort's ranges and its rows are both read from one exchange of detections."""
    plan = catalog.timeline(spark, SF)._jdf.queryExecution().executedPlan().toString()
    order = plan.index("rangepartitioning")
    assert plan.index("hashpartitioning(rule_id", order) > order


def test_rules_are_compiled(spark):
    """No predicate stands in a generator or under a function that Spark interprets, and no method is too large for the JVM; a session's own limit stays."""
    from tracelake.operators import match

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    rules = catalog.linked(*[catalog.rule(k, d) for k, (d, _) in catalog.LEAVES.items()])
    found = match.match(catalog.records(spark, SF), rules, catalog.fields())
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    lines = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "user7" in x]
    assert len(lines) == 1 and "Project" in lines[0] and "array_remove" in lines[0] and "array_compact" not in lines[0]
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "9000")
    match.match(catalog.records(spark, SF), rules, catalog.fields())
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "9000"
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")


def test_deep_fields(spark):
    from tracelake.operators import render

    texts = ['{"Event": {"System": {"EventID": 1}, "UserData": {"A": {"B": {"C": {"D": {"E": " deep "}}}}, "L": [{"x": "1", "y": [2, null, "3"]}, "z"], "n": null}}}', '{"Event": {}}', '{"Event": null}', '{"Event": {"EventData": []}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", "parse_json(t) AS event")
    got = {r.i: r.s for r in df.select("i", render.all_fields(C.F.col("event")).alias("s")).collect()}
    # A null item shows nothing, but counts: the place of "3" is the third.
    assert got[0] == "E: deep ¦ L[2]: z ¦ x: 1 ¦ y[1]: 2 ¦ y[3]: 3" and got[1] == got[2] == got[3] == ""


def test_streams_equal_tables(spark, tmp_path):
    """Plain hits of a stream are those of the table; count windows are the table's, as far as the watermark has passed them."""
    from tracelake.operators import match
    from tracelake.streaming import rules as streaming

    slim = catalog.records(spark, SF).drop("event").withColumn("event_ts", C.F.col("event_ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    slim.write.parquet(folder)
    last = slim.agg(C.F.max("event_ts_ns")).first()[0]
    # One late record moves the watermark past all others.
    slim.limit(1).select(*[(C.F.col("event_ts") + C.F.expr("interval 400 days")).alias(c) if c == "event_ts" else (C.F.lit(last) + 400 * 86_400_000_000_000).alias(c) if c == "event_ts_ns" else C.F.col(c) for c in slim.columns]).write.mode("append").parquet(folder)
    rules = catalog.linked(catalog.rule("p", {"s": {"LogonType": "3"}}), catalog.rule("w", catalog.BURST))
    make = lambda df: df.withColumn("event", C.F.parse_json("data_string"))
    stream, table = make(spark.readStream.schema(slim.schema).parquet(folder)), make(slim)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.table(name)

    hits = run(streaming.stream_hits(stream, rules, catalog.fields()).select("rule_id", "record_id", "event_ts_ns"), "hits_seen").where(C.F.col("event_ts_ns") <= last)
    want = match.match(table, rules[:1], catalog.fields())
    assert sorted(r.record_id for r in hits.collect()) == sorted(r.record_id for r in want.select("record_id").collect())
    seen = run(streaming.stream_windows(stream, rules[1], catalog.fields()), "windows_seen").where(C.F.col("start_ns") <= last)
    expect = match.windows(match.match(table, rules[1:], catalog.fields()), rules[1:], catalog.fields())
    show = lambda df: sorted(tuple(r) for r in df.select("key", "count", "start_ns", "end_ns").collect())
    assert show(seen) == show(expect) != []
