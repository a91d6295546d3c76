"""Results as files: CSV, JSON lines, pretty JSON, HTML, keyword lists."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import scratch
from tracelake.functions import columns as C

from . import metrics, reports, summary
from .render import Abbreviations

#: Columns that become objects of their `key: value` parts in JSON.
NESTED = ("Details", "ExtraFieldInfo", "AllFieldInfo")
LISTED = ("MitreTactics", "MitreTags", "OtherTags")
# The order of keys in a search's JSON.
SEARCH_KEYS = ("Timestamp", "Hostname", "Channel", "Event ID", "Record ID", "EventTitle", "AllFieldInfo", "EvtxFile")


def csv_ready(rows: DataFrame, separator: str | None = None, authors: str = "RuleAuthor") -> DataFrame:
    """Text columns without control characters; with a separator (CRLF or tab) the parts of a column stand apart."""
    cols = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string":
            c = C.collapse_spaces(c)
            if separator:
                c = F.replace(c, F.lit(C.SEPARATOR), F.lit(separator))
                if name == authors:
                    c = F.regexp_replace(c, r"\s*[,/;]\s*", separator)
        cols.append(c.alias(name))
    return rows.select(*cols)


def write_csv(rows: DataFrame, path: str, separator: str | None = None, one_file: bool = False) -> None:
    out = csv_ready(rows, separator)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def nested(v: Column) -> Column:
    """`a: 1 ¦ b: x` as a JSON object in its order; a key that comes again has a list; a text without keys stays text."""
    pairs = F.transform(F.split(v, C.SEPARATOR), lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)).alias("k"), F.btrim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))

    def one(k: Column) -> Column:
        mine = F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])
        texts = F.transform(mine, C.typed_scalar)
        return F.concat(_quoted(k), F.lit(": "), F.when(F.size(mine) == 1, F.get(texts, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(F.transform(mine, _quoted), ", "), F.lit("]"))))

    body = F.concat(F.lit("{"), F.array_join(F.transform(keys, one), ", "), F.lit("}"))
    return F.when(v.contains(":"), body).otherwise(_quoted(F.coalesce(v, F.lit(""))))


def _quoted(v: Column) -> Column:
    """A JSON string."""
    text = F.to_json(F.array(v))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def json_line(rows: DataFrame) -> DataFrame:
    """value: a row as one JSON object, its columns in their order."""
    parts = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        if name in NESTED:
            text = nested(c)
        elif name in LISTED:
            text = F.concat(F.lit("["), F.array_join(F.transform(F.filter(F.split(c, C.SEPARATOR), lambda x: x != ""), _quoted), ", "), F.lit("]"))
        elif kind == "string":
            text = C.typed_scalar(c)
        else:
            text = F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
        parts.append(F.concat(F.lit(json.dumps(name) + ": "), F.coalesce(text, F.lit("null"))))
    return rows.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))


def write_jsonl(rows: DataFrame, path: str, one_file: bool = False) -> None:
    out = json_line(rows)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def write_pretty_json(rows: DataFrame, path: str) -> None:
    """One file of objects with an indent of four, for reading: row by row through the driver."""
    with Path(path).open("w", encoding="utf-8") as f:
        for r in json_line(rows).toLocalIterator():
            f.write(json.dumps(json.loads(r["value"]), indent=4, ensure_ascii=False) + "\n")


def write_keywords(pairs: DataFrame, path: str) -> None:
    """A folder of values for each category."""
    pairs.select("category", F.col("value")).write.mode("overwrite").partitionBy("category").text(path)


def write_logons(found: DataFrame, path: str, style: str = "default") -> None:
    """Successful and failed logons of metrics.logons, each a CSV of their own under its fixed header."""
    write_csv(reports.logons(found, style=style), f"{path}-successful.csv")
    write_csv(reports.logons(found, failed=True, style=style), f"{path}-failed.csv")


def write_search(found: DataFrame, path: str, form: str = "csv", titles: DataFrame | None = None, short: Abbreviations = reports.NONE, separator: str = C.SEPARATOR) -> None:
    """Hits of a search as CSV or JSON lines. JSON has its keys in an order of its own, and all fields as an object."""
    if form not in ("csv", "jsonl"):
        raise ValueError(f"no form {form}")
    if form == "csv":
        # The separator is put in behind the collapsing of spaces, which would take it away.
        shown = reports.search(found, titles, short, separator)
        shown.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        json_line(reports.search(found, titles, short).select(*[f"`{c}`" for c in SEARCH_KEYS])).write.mode("overwrite").text(path)


def html_rows(df: DataFrame) -> DataFrame:
    """value: each row as a row of an HTML table, in df's order."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.concat(F.lit("<td>"), escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def write_html_report(sections: dict[str, dict[str, DataFrame | str]], path: str, title: str) -> None:
    """One HTML page of sections, each of tables and texts by name; a section or table without rows says so.

    Tables are aggregates that were made by Spark; their rows are made there too and come to the driver one partition at a time, all of them.
    """
    head = html.escape(title)
    with Path(path).open("w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{head}</title></head><body><h1>{head}</h1>")
        for section, parts in sections.items():
            f.write(f"<h2>{html.escape(section)}</h2>")
            if not parts:
                f.write("<p>Nothing was found.</p>")
            for name, part in parts.items():
                f.write(f"<h3>{html.escape(name)}</h3>")
                if isinstance(part, str):
                    f.write(f"<p>{html.escape(part)}</p>")
                    continue
                none = True
                for row in html_rows(part).toLocalIterator():
                    if none:
                        f.write("<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in part.columns) + "</tr>")
                        none = False
                    f.write(row["value"])
                f.write("<p>Nothing was found.</p>" if none else "</table>")
        f.write("</body></html>")


def timeline_report(detections: DataFrame, records: DataFrame, tactics: dict[str, str]) -> dict[str, dict[str, DataFrame | str]]:
    """The two sections of a timeline's report: an overview of the records, and what the rules found, by level, day, computer, rule and tactic."""
    # All of these read the detections; they are written once, without the events.
    found = scratch.written(detections.drop("event"), "reported")
    total = records.count()
    span = metrics.time_span(records).select(C.format_time(F.col("first_time")).alias("First"), C.format_time(F.col("last_time")).alias("Last"))
    overview = {"Records": f"{total:,}", "Time span": span, "Data reduction": summary.data_reduction(found, total)}
    results = {
        "Detections by level": summary.by_level(found), "Days with most detections": summary.busiest_date(found), "Computers with most rules": summary.top_computers(found),
        "Rules with most detections": summary.top_rules(found), "Tactics by computer": summary.tactics(found, tactics), "Rule authors": summary.authors(found),
    }
    return {"General Overview": overview, "Results Summary": results}
