"""Leaves to any depth, mapped values, ordered output, repeats across partitions."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import functions as F

from tracelake import catalog
from tracelake.engine import Engine
from tracelake.functions import columns as C
from tracelake.operators import match, render, sinks
from tracelake.sources import records as sources


def plain_leaves(v, name="Event", shown=None):
    if isinstance(v, dict):
        return [x for k, y in v.items() if k not in ("System", "xmlns", "Event_attributes") for x in plain_leaves(y, k)]
    if isinstance(v, list):
        return [x for i, y in enumerate(v) for x in plain_leaves(y, name, f"{name}[{i + 1}]")]
    return [] if v is None else [(shown or name, str(v).lower() if isinstance(v, bool) else str(v).strip())]


def events(spark, rows):
    df = spark.createDataFrame([(i, json.dumps({"Event": x})) for i, x in enumerate(rows)], "i int, j string")
    return df.select("i", F.parse_json("j").alias("event"))


def test_leaves_of_any_depth(spark):
    deep: object = " end "
    for k in range(50):
        deep = {f"k{k}": deep, "n": k} if k % 3 else [deep, None, k]
    r = random.Random(4)

    def value(left):
        k = r.randrange(6)
        if left and k < 2:
            return {r.choice("abc<>`"): value(left - 1) for _ in range(r.randrange(4))}
        if left and k == 2:
            return [value(left - 1) for _ in range(r.randrange(4))]
        return r.choice(["x", " y", 7, -2, True, None, "é<`>"])

    rows = [{"EventData": deep, "System": {"EventID": 1}}, {"EventData": {"a": [[1, 2], [3, {"b": "c"}], "d"]}, "xmlns": "no"}, {}] + [{"EventData": value(9), "UserData": value(3)} for _ in range(200)]
    got = {x.i: sorted((y.name, y.value) for y in x.l) for x in events(spark, rows).select("i", render.leaves(F.col("event")).alias("l")).collect()}
    for i, row in enumerate(rows):
        assert got[i] == sorted(plain_leaves(row)), row
    assert ("k49", "49") not in got[0] and len(got[0]) > 50 and ("a[2]", "2") in got[1] and ("b", "c") in got[1] and ("a[3]", "d") in got[1]
    names = [x.split(": ")[0] for x in events(spark, [{"EventData": {"Data2": "y", "Data": "x", "Data[1]": "z"}}]).select(render.all_fields(F.col("event"))).first()[0].split(" ¦ ")]
    assert names == sorted(names)


def first_ending(text: str, pairs: list[tuple[str, str]]) -> str:
    """From the last hit on, the key that ends first, the longest of those that end there."""
    table: dict = {}
    for k, v in pairs:
        if k:
            table.setdefault(k, v)
    out, start, at = "", 0, 0
    while at < len(text):
        at += 1
        hits = [k for k in table if at - len(k) >= start and text[:at].endswith(k)]
        if hits:
            k = max(hits, key=len)
            out += text[start : at - len(k)] + table[k]
            start = at
    return out + text[start:]


def test_replacements_in_one_pass(spark):
    r = np.random.default_rng(7)
    word = lambda n: "".join(r.choice(list("ab.c"), int(r.integers(1, n))))
    texts = [word(12) for _ in range(60)] + ["", None, "a b", "\n"]
    for _ in range(12):
        pairs = [(word(5), word(4).upper()) for _ in range(r.integers(1, 6))]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [x[0] for x in df.select(C.replace_stream(F.col("t"), pairs)).collect()]
        assert got == [None if t is None else first_ending(t, pairs) for t in texts], pairs
    df = spark.createDataFrame([("a b",), ("Security-System sec",)], "t string")
    assert [x[0] for x in df.select(C.replace_stream(F.col("t"), [("a", "b"), ("b", "c")])).collect()][0] == "b c"
    assert [x[0] for x in df.select(C.replace_longest(F.col("t"), [("sec", "S"), ("SECURITY", "Sec"), ("system", "Sys")])).collect()][1] == "Sec-Sys S"
    assert [x[0] for x in df.select(C.replace_stream(F.col("t"), [("", "x")])).collect()] == ["a b", "Security-System sec"]


def test_repeats_across_partitions(spark):
    r = np.random.default_rng(1)
    rows = [(i, str(r.integers(0, 2)) if i % 7 else None, "-" if i % 5 else "") for i in range(500)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "i int, a string, b string").repartition(9)
        for as_json in (False, True):
            out = render.mark_repeats(df, ["a", "b"], ["i"], as_json)
            got = [tuple(x) for x in out.collect()]
            mark = lambda now, before: "DUP" if now is not None and now == before and not (as_json and now in ("", "-")) else now  # noqa: E731, B023
            assert got == [(i, mark(a, rows[k - 1][1] if k else None), mark(b, rows[k - 1][2] if k else None)) for k, (i, a, b) in enumerate(rows)]
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "windowspecdefinition(_p#" in plan and plan.count("windowspecdefinition(") == plan.count("windowspecdefinition(_p#")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_ties_go_by_what_is_shown(spark):
    r = catalog.records(spark, "/root/testdata/sf0.001").where("event_id = '4625'").limit(40)
    copies = r.withColumn("source_file", F.lit("b.evtx")).unionByName(r.withColumn("source_file", F.lit("a.evtx"))).repartition(5)
    engine = Engine(spark, catalog.fields())
    rules = catalog.linked(catalog.rule("t", {"s": {"EventID": 4625}}, details="%TargetUserName%"))
    out = engine.timeline(copies, rules, {"file": "%EvtxFile%", "id": "%RecordID%", "details": "%Details%"}).collect()
    assert len(out) == 80 and [x.file for x in out] == ["a.evtx", "b.evtx"] * 40 and all(out[k].id == out[k + 1].id for k in range(0, 80, 2))
    marked = engine.timeline(copies, rules, {"file": "%EvtxFile%", "id": "%RecordID%", "details": "%Details%"}, mark="csv").collect()
    assert [x.id for x in marked] == [x.id for x in out] and all(x.details == "DUP" for x in marked[1::2])
    assert sinks.json_line(spark.createDataFrame([("DUP",)], "Details string")).first().value == '{"Details": "DUP"}'


def test_mappings_by_provider_and_list_item(spark):
    mapping = render.Mapping([{"Channel": "C", "EventID": 1, "Provider_Name": ["P", "Q"], "RewriteFieldData": {"Data[2]": [{"1": "one"}], "Data": [{"x": "y"}]}}, {"Channel": "c", "EventID": [1, 2], "HexToDecimal": "num"}])
    # The second mapping of C 1 takes the place of the first.
    assert mapping.fields == {"num": {("hex",): ["c/1", "c/2"]}, "data[2]": {}, "data": {}} or set(mapping.fields) == {"num"}
    df = events(spark, [{"EventData": {"Data": ["x", "1"], "Num": "0x1F"}}]).withColumns({"channel": F.lit("C"), "event_id": F.lit("2"), "provider": F.lit("P")})
    assert df.select(render.all_fields(F.col("event"), mapping, F.col("provider"))).first()[0] == "Data[1]: x ¦ Data[2]: 1 ¦ Num: 31"
    first = render.Mapping([{"Channel": "C", "EventID": 2, "Provider_Name": ["P", "Q"], "RewriteFieldData": {"Data[2]": [{"1": "one"}]}}])
    fields = render.Fields()
    shown = lambda p: df.withColumn("provider", F.lit(p)).select(render.all_fields(F.col("event"), first, F.col("provider")).alias("a"), render.template("%Data[2]%/%Data[9]%", fields, first, F.col("provider")).alias("t")).first()
    assert tuple(shown("P")) == ("Data[1]: x ¦ Data[2]: one ¦ Num: 0x1F", "one/n/a") and tuple(shown("R")) == ("Data[1]: x ¦ Data[2]: 1 ¦ Num: 0x1F", "1/n/a")
    assert match.ORDER[0] == "event_ts_ns"


def test_extra_fields_of_made_details(spark):
    """Details are made once a record, beside the fields, not for each of them; so they may come from Python."""
    rows = spark.sql("""SELECT parse_json('{"Event":{"System":{"x":{"y":{"z":{"deep":1}}}},"EventData":{"A":"1","B":" b ","C":null,"D":{},"E":["1",{"F":"f"}]}}}') AS event, 'b' AS shown""")
    made = F.udf(lambda x: f"A: {x}", "string")
    assert rows.select(render.extra_fields(F.col("event"), made("shown"))).first()[0] == "A: 1 ¦ E[1]: 1 ¦ F: f"


def test_powershell_lines_are_split_once(spark):
    rows = spark.createDataFrame([("400", "Windows PowerShell", '{"Event":{"System":{"EventID":"400"},"EventData":{"Host":"old","Data":["x","y","\\tHost=a\\n\\tUser = u\\nHost=b=c\\nnone"]}}}')], "event_id string, channel string, text string")
    out = sources.powershell_classic(rows.withColumn("event", F.parse_json("text")))
    assert [out.select(C.scalar(F.col("event"), f"Event.EventData.{k}")).first()[0] for k in ("Host", "User")] == ["b=c", "u"]
    assert out._jdf.queryExecution().analyzed().toString().count("split(") == 1
