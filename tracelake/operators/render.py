"""What a detection shows: profiles, details, all fields, abbreviations, levels, mapped values, places."""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake import scratch
from tracelake.functions import columns as C
from tracelake.plans.rule import LEVEL_ABBREVIATIONS, LEVELS
from tracelake.plans.selection import Fields
from tracelake.sources import records

_ALIAS = re.compile(r"%([^%\s]+?)(?:\[(\d+)\])?%")
#: Levels below Event that the plan flattens; it has no recursion, so each level is written out.
DEPTH = 4
#: Tags and what is shown of them.
TACTICS = {
    "attack.reconnaissance": "Recon", "attack.resource-development": "ResDev", "attack.initial-access": "InitAccess", "attack.execution": "Exec", "attack.persistence": "Persis",
    "attack.privilege-escalation": "PrivEsc", "attack.stealth": "Stealth", "attack.defense-evasion": "Stealth", "attack.defense-impairment": "DefImpair", "attack.credential-access": "CredAccess",
    "attack.discovery": "Disc", "attack.lateral-movement": "LatMov", "attack.collection": "Collect", "attack.command-and-control": "C2", "attack.exfiltration": "Exfil", "attack.impact": "Impact",
}


_ENTRY = "array<struct<name:string,value:string>>"
_LEFT_OUT = ("System", "xmlns", "Event_attributes")


def deeper(v: Column, levels: int) -> Column:
    """Whether objects and lists are nested deeper than so many levels, or may be: lists of mixed items do not tell."""

    def test(schema: Column) -> Column:
        rest = F.regexp_replace(schema, "`(?:[^`]|``)*+`", "")
        for _ in range(levels):
            rest = F.regexp_replace(rest, "<[^<>]*+>", "")
        return C.truth(rest.contains("<") | schema.contains("VARIANT"))

    # The schema of a whole record costs more than its fields: it is made once.
    return C.let(F.schema_of_variant(v), test)


def walk(node: object, name: str = "Event") -> list[tuple[str, str]]:
    """leaves() of parsed JSON whose numbers are texts, to any depth."""
    out, ahead = [], [(node, name, name)]
    while ahead:
        v, own, shown = ahead.pop()
        if isinstance(v, dict):
            ahead += [(x, k, k) for k, x in v.items() if k not in _LEFT_OUT]
        elif isinstance(v, list):
            ahead += [(x, own, f"{own}[{i}]") for i, x in enumerate(v, 1)]
        elif v is not None:
            out.append((shown, ("true" if v else "false") if isinstance(v, bool) else v.strip(C.SPACE)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])))
def _walked(texts: pd.Series) -> pd.Series:
    """Of the records alone that are too deep for a plan."""
    parsed = lambda t: [{"name": k, "value": v} for k, v in walk(json.loads(t, parse_int=str, parse_float=str, parse_constant=str))]
    return texts.map(lambda t: parsed(t) if t is not None else None)


def leaves(event: Column, path: str = "$.Event", depth: int = DEPTH) -> Column:
    """(name, value) of the scalar leaves below a path, System and xmlns left out, items of lists by number. The plan goes down `depth` levels; records that are deeper are walked in Python."""
    Child = "array<struct<key:string,shown:string,value:variant>>"

    def down(v: Column, name: Column, shown: Column, left: int) -> Column:
        void = F.when(F.is_variant_null(v), F.array().cast(_ENTRY))
        here = F.coalesce(void, F.array(F.struct(shown.alias("name"), C.trim_unicode(F.try_variant_get(v, "$", "string")).alias("value"))))
        if left == 0:  # no objects or lists come here: their records are walked
            return here
        # Objects alone are maps and lists alone arrays, so neither is told by a schema of all that is below.
        fields = F.transform(F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: ~e["key"].isin(*_LEFT_OUT)), lambda e: F.struct(e["key"].alias("key"), e["key"].alias("shown"), e["value"].alias("value")))
        # An item goes by its list's name and its place, also where lists are in lists.
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(name.alias("key"), F.concat(name, F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("shown"), x.alias("value")))
        # Fields and items are one list of children, so that the expression grows with the depth and not with its power.
        children = F.coalesce(fields.cast(Child), items.cast(Child))
        return F.coalesce(F.flatten(F.transform(children, lambda e: down(e["value"], e["key"], e["shown"], left - 1))), here)

    v = F.try_variant_get(event, path, "variant")
    # Only records that are too deep have a text to walk, and only these come back from it with a list.
    return F.coalesce(_walked(F.when(deeper(v, depth), F.to_json(v))), down(v, F.lit("Event"), F.lit("Event"), depth), F.array().cast(_ENTRY))


def shown_leaves(event: Column, mapping: Mapping | None = None, provider: Column | None = None) -> Column:
    """(name, value) of the leaves that have a value, each once, by name and value as they are in the record; mapped then."""
    found = F.array_sort(F.array_distinct(F.filter(leaves(event), lambda x: x["value"].isNotNull() & (x["value"] != ""))))
    return mapping.leaves(found, provider) if mapping else found


def all_fields(event: Column, mapping: Mapping | None = None, provider: Column | None = None) -> Column:
    """`name: value` of all leaves, each once, sorted."""
    return F.array_join(F.transform(shown_leaves(event, mapping, provider), lambda x: F.concat(x["name"], F.lit(": "), x["value"])), C.SEPARATOR)


def extra_fields(event: Column, details: Column, mapping: Mapping | None = None, provider: Column | None = None) -> Column:
    """All fields whose values the details do not show."""
    shown = F.transform(F.split(details, C.SEPARATOR.strip()), lambda x: F.btrim(F.substr(x, F.greatest(F.instr(x, ":"), F.lit(0)) + 1)))
    both = F.struct(shown_leaves(event, mapping, provider).alias("leaves"), shown.alias("shown"))
    rest = C.let(both, lambda b: F.filter(b["leaves"], lambda x: ~F.array_contains(b["shown"], x["value"])))
    return F.array_join(F.array_sort(F.transform(rest, lambda x: F.concat(x["name"], F.lit(": "), x["value"]))), C.SEPARATOR)


def template(text: str, fields: Fields, mapping: Mapping | None = None, provider: Column | None = None) -> Column:
    """A details template: %name% is a field's value, %name[2]% an element of a list; what is not there is n/a. Values are mapped by the name of the field that an alias stands for."""
    parts, at = [], 0
    for m in _ALIAS.finditer(text):
        parts.append(F.lit(text[at : m.start()]))
        if m[2]:
            v, name = F.get(fields.array(m[1]), F.lit(int(m[2]) - 1)), f"{m[1]}[{m[2]}]"
        else:
            v, name = fields.value(m[1]), fields.path(m[1]).rpartition(".")[2]
        parts.append(F.coalesce(mapping.value(v, name, provider) if mapping else v, F.lit("n/a")))
        at = m.end()
    parts.append(F.lit(text[at:]))
    return C.collapse_spaces(F.concat(*parts))


def details(detections: DataFrame, fields: Fields, rules: list, defaults: dict[str, str] | None = None, mapping: Mapping | None = None) -> DataFrame:
    """detections with details: the rule's template, else the provider's and id's, else all fields, values mapped; counts show their own text."""
    provider = provider_of(detections)
    # Flat choices, a branch for each different template: their depth does not grow with the rules.
    by_text: dict[str, list[str]] = {}
    for r in rules:
        if r.doc.get("details"):
            by_text.setdefault(str(r.doc["details"]), []).append(r.id)
    out = fallback = F.when(F.lit(False), F.lit(None).cast("string"))
    for text, ids in by_text.items():
        out = out.when(F.col("rule_id").isin(ids), template(text, fields, mapping, provider))
    by_text = {}
    for key, text in (defaults or {}).items():
        by_text.setdefault(text, []).append(key)
    for text, keys in by_text.items():
        fallback = fallback.when(F.concat_ws("_", provider, F.col("event_id")).isin(keys), template(text, fields, mapping, provider))
    return detections.withColumn("details", F.coalesce("agg_text", out, fallback, all_fields(F.col("event"), mapping, provider)))


def abbreviate(v: Column, full: dict[str, str], generic: dict[str, str] | None = None, any_case: bool = True) -> Column:
    """A whole name's abbreviation, or else the name, with its parts abbreviated; any_case: whole names are known in any case."""
    if full:
        known = F.create_map(*[F.lit(x) for k, a in full.items() for x in (k.lower() if any_case else k, a)])
        v = F.coalesce(F.try_element_at(known, F.lower(v) if any_case else v), v)
    return C.replace_longest(v, list((generic or {}).items()))


@dataclass
class Abbreviations:
    """Short forms in place of whole channels (in any case) and providers (as they are), and of parts of both."""

    channels: dict[str, str]
    providers: dict[str, str]
    generic: dict[str, str]

    def channel(self, v: Column) -> Column:
        """Of each of several channels, too."""
        return F.array_join(F.transform(F.split(v, C.SEPARATOR), lambda c: abbreviate(c, self.channels, self.generic)), C.SEPARATOR)

    def provider(self, v: Column) -> Column:
        return abbreviate(v, self.providers, self.generic, any_case=False)


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank + 1)


def level_short(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVEL_ABBREVIATIONS]), rank + 1)


def uplift(rank: Column, computer: Column, critical: list[str]) -> Column:
    """One level more on critical systems; informational stays, and so does the highest."""
    return F.when(C.truth(computer.isin(critical)) & (rank > 1), F.least(rank + 1, F.lit(len(LEVELS) - 1))).otherwise(rank)


def tag_groups(tags: Column, tactics: dict[str, str] = TACTICS) -> dict[str, Column]:
    """Tactics by their short names, techniques, groups and software, and other tags of a rule."""
    short = F.create_map(*[F.lit(x) for pair in tactics.items() for x in pair])
    shown = F.transform(tags, lambda t: F.coalesce(F.try_element_at(short, t), t))
    tactic = lambda t: t.isin(sorted(set(tactics.values())))
    listed = lambda t: t.rlike(r"^attack\.[tgs]")
    return {
        "tactics": F.filter(shown, tactic),
        "techniques": F.transform(F.filter(shown, lambda t: ~tactic(t) & listed(t)), lambda t: C.title_first(F.replace(t, F.lit("attack."), F.lit("")))),
        "other": F.filter(shown, lambda t: ~tactic(t) & ~listed(t)),
    }


def read_mappings(folder: str) -> list[dict]:
    """Field mappings: Channel, EventID, RewriteFieldData, HexToDecimal and maybe Provider_Name."""
    out = []
    for p in sorted(Path(folder).rglob("*.y*ml")):
        out += [d for d in yaml.safe_load_all(p.read_text(encoding="utf-8")) if d and "Channel" in d and "EventID" in d]
    return out


def _listed(x) -> list[str]:
    return [str(y) for y in (x if isinstance(x, list) else [] if x is None else [x])]


class Mapping:
    """Fields' values rewritten by their record's channel and id: codes to words (for some providers alone, if they are named), hexadecimal numbers to decimal ones.

    Field names and channels are compared without regard to case. A later mapping of a channel and id takes the place of an earlier one.
    """

    def __init__(self, docs: list[dict]):
        entries: dict[str, dict[str, tuple]] = {}
        for m in docs:
            kinds = {}
            for name, codes in (m.get("RewriteFieldData") or {}).items():
                pairs = tuple((str(k), str(x)) for item in codes if isinstance(item, dict) for k, x in item.items())
                kinds[str(name).lower()] = (pairs, tuple(_listed(m.get("Provider_Name"))))
            kinds |= {name.lower(): ("hex",) for name in _listed(m.get("HexToDecimal"))}
            for id_ in _listed(m["EventID"]):
                entries[f"{str(m['Channel']).lower()}/{id_}"] = kinds
        #: field -> how it is rewritten -> the channels and ids.
        self.fields: dict[str, dict[tuple, list[str]]] = {}
        for key, kinds in entries.items():
            for name, how in kinds.items():
                self.fields.setdefault(name, {}).setdefault(how, []).append(key)
        self.keys = sorted(k for k, kinds in entries.items() if kinds)

    def _key(self) -> Column:
        return F.concat(F.lower("channel"), F.lit("/"), F.col("event_id"))

    def value(self, v: Column, name: str, provider: Column) -> Column:
        """The value of a field of that name."""
        return self._through(v, self.fields.get(name.lower(), {}), provider)

    def _through(self, v: Column, hows: dict[tuple, list[str]], provider: Column) -> Column:
        out = F.when(F.lit(False), v)
        for how, keys in hows.items():
            test = self._key().isin(keys)
            if how == ("hex",):
                out = out.when(test, C.hex_to_decimal(v))
            else:
                out = out.when(test & provider.isin(list(how[1])) if how[1] else test, C.replace_stream(v, list(how[0])))
        return out.otherwise(v) if hows else v

    def leaves(self, found: Column, provider: Column) -> Column:
        """(name, value) pairs with mapped values."""
        if not self.keys:
            return found

        def one(x: Column) -> Column:
            value = F.when(F.lit(False), x["value"])
            for name, hows in self.fields.items():
                value = value.when(F.lower(x["name"]) == name, self._through(x["value"], hows, provider))
            return F.struct(x["name"].alias("name"), value.otherwise(x["value"]).alias("value"))

        return F.when(C.truth(self._key().isin(self.keys)), F.transform(found, one)).otherwise(found)


def provider_of(rows: DataFrame) -> Column:
    return F.col("provider") if "provider" in rows.columns else C.scalar(F.col("event"), "Event.System.Provider_attributes.Name")


def mapped(v: Column, name: str, mappings: list[dict]) -> Column:
    """A field's value under the mappings of its record's channel, id and provider, in rows with those columns."""
    return Mapping(mappings).value(v, name, F.col("provider"))


#: A table of prefixes is broadcast up to so many rows, counted first.
PREFIX_ROWS = 500_000


def prefixes(ranges: DataFrame, ranges6: DataFrame | None = None) -> DataFrame:
    """The networks that address ranges are made of: key (4 or 6, and the bits of the prefix), bits, size (of the whole range, as a sortable text), asn, country, city."""
    kinds = "key string, bits int, size string, asn string, country string, city string"
    columns = ("asn", "country", "city")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                first, last = (ipaddress.ip_address(r[k] if isinstance(r[k], int) else r[k].strip()) for k in ("first", "last"))
                width, size = (32 if first.version == 4 else 128), f"{int(last) - int(first):039d}"
                for n in ipaddress.summarize_address_range(first, last):
                    rows.append({"key": f"{first.version}:" + format(int(n.network_address), f"0{width}b")[: n.prefixlen], "bits": n.prefixlen, "size": size, **{c: r[c] for c in columns}})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("bits", pa.int32()), ("size", pa.string()), *[(c, pa.string()) for c in columns]]))

    four = ranges.select(F.col("first").cast("bigint"), F.col("last").cast("bigint"), *columns).mapInArrow(cut, kinds)
    return four if ranges6 is None else four.unionByName(ranges6.select("first", "last", *columns).mapInArrow(cut, kinds))


def places(rows: DataFrame, ip: str, ranges: DataFrame, prefix: str, ranges6: DataFrame | None = None) -> DataFrame:
    """rows with the owner, country and city of an address: `ranges` has first, last (numbers), asn, country, city; `ranges6` the same of IPv6, with first and last as addresses.

    Ranges may lie in one another: the smallest one counts. They are cut into networks, and each distinct address is looked up once, by equality with the networks of every prefix
    length that there is; so no part of the addresses meets more than its own networks. IPv4-mapped ones are IPv4, private ones are named as such.
    """
    networks = scratch.written(prefixes(ranges, ranges6), "prefixes")
    lengths = [(r["version"], r["bits"]) for r in networks.select(F.left("key", F.lit(1)).alias("version"), "bits").distinct().collect()]  # at most 162
    small = networks.limit(PREFIX_ROWS + 1).count() <= PREFIX_ROWS
    # Rows are read for their addresses and for the join, so what makes them runs once; addresses are few bytes and much work, so they are dealt by number.
    rows = scratch.written(rows, "placed")
    own = rows.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().repartition(records.tasks(rows.sparkSession), "_ip").withColumn("_a", C.plain_address(F.col("_ip")))
    own = own.withColumns({"_k": C.private_kind(F.col("_a")), "_4": F.lpad(F.conv(C.ipv4(F.col("_a")).cast("string"), 10, 2), 32, "0"), "_6": C.ipv6_hex(F.col("_a"))})
    half = lambda at: F.lpad(F.conv(F.substr("_6", F.lit(at), F.lit(16)), 16, 2), 64, "0")
    own = scratch.written(own.withColumn("_6", F.concat(half(1), half(17))), "addresses")
    keys = [F.when(F.col(f"_{v}").isNotNull(), F.concat(F.lit(f"{v}:"), F.left(f"_{v}", F.lit(n)))) for v, n in lengths]
    tried = own.where("_k is null").select("_ip", F.explode(F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")).alias("key"))
    met = tried.join(F.broadcast(networks) if small else networks, "key")
    best = met.groupBy("_ip").agg(F.min(F.struct("size", "asn", "country", "city")).alias("_best")).select(F.col("_ip").alias("_found"), "_best")
    dash = F.lit("-")
    found = own.select("_ip", "_k").join(best, F.col("_ip") == F.col("_found"), "left")
    found = found.select("_ip", F.coalesce("_k", "_best.asn", dash).alias(f"{prefix}_asn"), *[F.coalesce(f"_best.{c}", dash).alias(f"{prefix}_{c}") for c in ("country", "city")])
    return rows.join(scratch.small(scratch.written(found, "places")), F.col(ip) == F.col("_ip"), "left").drop("_ip")


@dataclass
class Places:
    """What the place columns need: ranges as in places(), the fields that hold the addresses (the first present counts), and the ids of each channel that are looked up."""

    ranges: DataFrame
    source: list[str]
    target: list[str]
    events: dict[str, list[str]]
    ranges6: DataFrame | None = None


def place_kinds(profile: dict[str, str]) -> set[str]:
    """Src and Tgt, as far as a profile asks for their places."""
    return {m[1] for what in profile.values() if (m := re.fullmatch(r"%(Src|Tgt)(ASN|Country|City)%", str(what)))}


def with_places(detections: DataFrame, sides: set[str], known: Places | None, fields: Fields) -> DataFrame:
    """detections with the places of their source and target addresses as _src_asn and so on; null where none is looked up."""
    if sides and known is None:
        raise ValueError("the profile asks for places, but no address ranges are given")
    for side in sorted(sides):
        test = F.lit(False)
        for channel, ids in known.events.items():
            test = test | (F.col("channel") == channel) & F.col("event_id").isin([str(x) for x in ids])
        names = known.source if side == "Src" else known.target
        ip = F.coalesce(*[fields.value(n) for n in names]) if names else F.lit(None).cast("string")
        low = f"_{side.lower()}"
        detections = places(detections.withColumn(f"{low}_ip", F.when(C.truth(test), ip)), f"{low}_ip", known.ranges, low, known.ranges6)
    return detections


def profile_columns(detections: DataFrame, profile: dict[str, str], style: str = "default", mapping: Mapping | None = None, short: Abbreviations | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The profile's columns in its order: alias -> what, by %Kind% or a fixed text; place columns are those of with_places. keep: columns that stay, behind them."""
    provider = provider_of(detections)
    groups = tag_groups(F.col("tags"))
    joined = lambda c: F.array_join(c, C.SEPARATOR)
    kinds = {
        "Timestamp": C.format_time(F.col("event_ts"), style), "Computer": F.col("computer"), "Channel": short.channel(F.col("channel")) if short else F.col("channel"), "Level": level_short(F.col("level_rank")), "EventID": F.col("event_id"),
        "RecordID": F.col("record_id"), "RuleTitle": F.col("title"), "RuleFile": F.element_at(F.split("rule_file", "/"), -1), "RuleAuthor": F.col("author"), "RuleID": F.col("rule_id"),
        "EvtxFile": F.col("source_file"), "Details": F.col("details") if "details" in detections.columns else F.col("agg_text"), "AllFieldInfo": all_fields(F.col("event"), mapping, provider),
        "ExtraFieldInfo": extra_fields(F.col("event"), F.col("details"), mapping, provider) if "details" in detections.columns else F.lit(""), "Provider": short.provider(provider) if short else provider,
        "RenderedMessage": F.btrim(F.replace(F.replace(C.scalar(F.col("event"), "Event.RenderingInfo.Message"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))), "MitreTactics": joined(groups["tactics"]), "MitreTags": joined(groups["techniques"]), "OtherTags": joined(groups["other"]),
        "Status": F.col("status"), "RuleCreationDate": F.col("rule_date"), "RuleModifiedDate": F.coalesce("rule_modified", F.lit("")), "RecoveredRecord": F.when(C.truth(F.col("recovered")), "Y").otherwise(""),
    }
    for side in ("Src", "Tgt"):
        for kind in ("ASN", "Country", "City"):
            if (have := f"_{side}_{kind}".lower()) in detections.columns:
                kinds[side + kind] = F.coalesce(have, F.lit(""))
    cols = []
    # Named at the end: in one select, a name of the profile could hide a column of the detections.
    for name, what in profile.items():
        m = re.fullmatch(r"%(\w+)%", str(what))
        if m and m[1] not in kinds:
            raise ValueError(f"column {name}: {what} is unknown")
        cols.append((F.coalesce(kinds[m[1]].cast("string"), F.lit("-")) if m else F.lit(str(what))).alias(f"_{len(cols)}"))
    return detections.select(*cols, *keep).toDF(*profile, *keep)


def mark_repeats(rows: DataFrame, columns: list[str], order: list[str], as_json: bool = False) -> DataFrame:
    """DUP in place of a value that the row before has too, in the order of the whole output. as_json: empty details are not marked, as objects have them."""
    return mark_sorted(rows.orderBy(*order), columns, as_json)


def mark_sorted(rows: DataFrame, columns: list[str], as_json: bool = False) -> DataFrame:
    """mark_repeats of rows that are in order, and stay so. A partition's first row is compared with the last one of the partition before, so no task has the whole."""
    names = rows.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    held = scratch.written(rows.select(row.alias("_row"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "in-order")
    value = lambda c: F.col("_row").getField(c)
    own = F.struct(*[value(c).alias(f"c{k}") for k, c in enumerate(columns)])
    # A row for each partition: their last rows, each handed on to the next.
    ends = held.groupBy("_p").agg(F.max_by(own, "_i").alias("end")).agg(F.array_sort(F.collect_list(F.struct("_p", "end"))).alias("ends"))
    handed = F.transform("ends", lambda x, i: F.struct(x["_p"].alias("_q"), F.get(F.col("ends"), i - 1)["end"].alias("_handed")))
    handed = ends.select(F.inline(handed))
    before = held.withColumn("_before", F.lag(own).over(Window.partitionBy("_p").orderBy("_i")))
    before = before.join(F.broadcast(handed), F.col("_p") == F.col("_q")).withColumn("_before", F.coalesce("_before", "_handed"))
    out = []
    for c in names:
        v = value(c)
        if c in columns:
            same = v == F.col("_before").getField(f"c{columns.index(c)}")
            v = F.when(C.truth(same & ~v.isin("", "-") if as_json else same), F.lit("DUP")).otherwise(v)
        out.append(v.alias(c))
    return before.orderBy("_i").select(*out)


#: Kinds of columns that repeats are marked in.
MARKED = ("%Details%", "%AllFieldInfo%", "%ExtraFieldInfo%")
