"""Files of the fixed analyses, read back."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from tracelake import catalog, catalog_forms
from tracelake.functions import columns as C
from tracelake.operators import base64_tokens, match, metrics, reports, search, sinks

SF = "/root/testdata/sf0.001"


def read_csv(folder):
    rows = []
    for f in sorted(folder.glob("part-*")):
        with f.open(newline="", encoding="utf-8") as h:
            own = list(csv.reader(h))
        head, rows = own[0], rows + own[1:]
    return head, rows


def test_logons_in_two_files(spark, tmp_path):
    found = metrics.logons(catalog.records(spark, SF)).cache()
    sinks.write_logons(found, str(tmp_path / "l"))
    head, rows = read_csv(tmp_path / "l-failed.csv")
    assert head[:4] == ["Failed", "First Attempt", "Last Attempt", "Event"] and head[-1] == "Source IP Address" and len(head) == 12
    assert sum(int(r[0]) for r in rows) == found.agg(F.sum("failures")).first()[0] and [int(r[0]) for r in rows] == sorted((int(r[0]) for r in rows), reverse=True)
    head, rows = read_csv(tmp_path / "l-successful.csv")
    assert head[:3] == ["Successful", "First Logon", "Last Logon"] and len(rows) == found.where("successes > 0").count()


def test_search_in_two_forms(spark, tmp_path):
    found = search.search(catalog.records(spark, SF), ["HOST-3"], fields=catalog.fields()).cache()
    sinks.write_search(found, str(tmp_path / "s"), separator="\r\n", short=catalog_forms.SHORT)
    head, rows = read_csv(tmp_path / "s")
    assert head == list(reports.SEARCH) and len(rows) == found.count() and {r[3] for r in rows} == {"Sec", "Sys"} and {r[1] for r in rows} == {"-"}
    assert all("\r\n" in r[6] and "¦" not in r[6] for r in rows)
    sinks.write_search(found, str(tmp_path / "j"), "jsonl")
    lines = [json.loads(x) for f in sorted((tmp_path / "j").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(lines) == len(rows) and list(lines[0]) == list(sinks.SEARCH_KEYS) and isinstance(lines[0]["AllFieldInfo"], dict) and isinstance(lines[0]["Event ID"], int)
    with pytest.raises(ValueError):
        sinks.write_search(found, str(tmp_path / "x"), "xml")


def test_base64_report(spark):
    found = base64_tokens.extract(catalog.records(spark, SF))
    rows = reports.base64(found).collect()
    assert rows and tuple(rows[0].asDict()) == reports.BASE64
    assert all(r["Binary"] == "N" and r["Decoded String"].startswith("payload number") and r["Length"] == str(len(r["Decoded String"])) for r in rows)
    binary = found.limit(1).withColumn("is_binary", F.lit(True))
    assert reports.base64(binary).first()["Decoded String"] == "(Binary Data)"


def test_reports_of_nothing(spark):
    none = catalog.records(spark, SF).where("false")
    assert reports.event_ids(metrics.event_id_counts(none)).count() == 0 and reports.logons(metrics.logons(none)).count() == 0
    assert reports.computers(metrics.computers(none)).count() == 0 and reports.logs(metrics.logs(none)).count() == 0


def test_uptimes_and_sizes(spark):
    # Days are what whole months leave of all seconds: 365 days are 12 months of 30 and 5 days.
    for seconds, want in ((59, "0Y 0M 0d 0h 0m 59s"), (31_536_000, "1Y 0M 5d 0h 0m 0s"), (2_592_000 + 3_661, "0Y 1M 0d 1h 1m 1s")):
        assert spark.range(1).select(C.uptime(F.lit(seconds))).first()[0] == want
    for size, want in ((0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1_572_864, "1.5 MiB"), (5 << 30, "5.0 GiB")):
        assert spark.range(1).select(C.size_text(F.lit(size).cast("bigint"))).first()[0] == want


def test_html_report_holds_every_row(spark, tmp_path):
    records = catalog.records(spark, SF)
    rules = catalog.linked(catalog.rule("a<b>", {"s": {"EventID": 4625}}, tags=["attack.execution"]))
    sections = sinks.timeline_report(match.detect(records, rules, catalog.fields()), records, {"attack.execution": "Exec"})
    many = spark.range(2_500).select(F.concat(F.lit("<v&"), F.col("id").cast("string")).alias("a&b"))
    path = tmp_path / "r.html"
    sinks.write_html_report(sections | {"Many": {"All": many, "None": many.where("false")}, "Empty": {}}, str(path), "T & U")
    page = path.read_text()
    assert page.index("General Overview") < page.index("Results Summary") < page.index("Many") and "<title>T &amp; U</title>" in page
    assert page.count("<td>&lt;v&amp;") == 2_500 and "<th>a&amp;b</th>" in page and page.count("Nothing was found.") == 2
    assert f"<p>{records.count():,}</p>" in page and "Exec" in page and "Rule a&lt;b&gt;" in page
