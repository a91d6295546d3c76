"""The engine's commands in one place: timeline, search, metrics, logons, base64, pivot, critical systems, rule tools."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import base64_tokens, filters, match, metrics, render, search, summary
from tracelake.plans import rule as rules_
from tracelake.plans.rule import Loaded, Rule
from tracelake.plans.selection import Fields
from tracelake.sources import evtx
from tracelake.sources import records as sources


@dataclass
class Engine:
    spark: SparkSession
    fields: Fields = field(default_factory=Fields)
    default_details: dict[str, str] = field(default_factory=dict)
    critical: list[str] = field(default_factory=list)
    places: render.Places | None = None
    mapping: render.Mapping | None = None
    abbreviations: render.Abbreviations | None = None

    def read(self, path: str) -> DataFrame:
        return sources.powershell_classic(sources.read_records(self.spark, path))

    def read_logs(self, path: str, recover: bool = False, checksums: bool = False, files: list[str] | None = None) -> DataFrame:
        """Records of binary logs; with recover also those found in free space. files: of these alone, as FileChannels tells them."""
        return sources.powershell_classic(evtx.read_logs(self.spark, path, recover, checksums, files=files))

    def rules(self, path: str, placeholders: dict[str, list[str]] | None = None, levels: dict[str, str] | None = None, **options) -> Loaded:
        """Rules of a folder, checked, chosen, expanded, tuned and linked; what was left out and why comes with them."""
        loaded = rules_.read_rules(path)
        good = []
        for r in loaded.rules:
            if wrong := rules_.check(r.doc):
                loaded.errors.append((r.path, "; ".join(wrong)))
            else:
                good.append(r)
        chosen = rules_.choose(good, **options)
        expanded = rules_.expand(chosen.rules, placeholders or {})
        linked = rules_.link(rules_.tune_levels(expanded.rules, levels or {}))
        return Loaded(linked.rules, loaded.errors + expanded.errors + linked.errors, chosen.left_out + expanded.left_out)

    def timeline(self, records: DataFrame, rules: list[Rule], profile: dict[str, str] | None = None, duplicates: bool = True, ordered: bool = True, style: str = "default", channels: set[str] | None = None, mark: str | None = None) -> DataFrame:
        """Detections with details; in the timeline's order and under a profile's columns if asked for.

        channels: all that the records have, where that is known; rules of others are then not compiled. mark: "csv" or "json", DUP in place of details, fields and
        extra fields that the row before has too, as that output does.
        """
        if mark and not (profile and ordered):
            raise ValueError("repeats are marked in the columns of a profile, in order")
        if channels is not None:
            rules = match.prune(rules, channels)
        found = render.details(match.detect(records, rules, self.fields), self.fields, rules, self.default_details, self.mapping)
        found = found.withColumn("level_rank", render.uplift(found["level_rank"], found["computer"], self.critical))
        if not duplicates:
            found = match.without_duplicates(found)
        if profile:
            found = render.with_places(found, render.place_kinds(profile), self.places, self.fields)
        if not profile:
            return match.in_order(found) if ordered else found
        # What is shown is made before the sort, which then need not carry the events.
        found = found.withColumn("_keys", F.struct(*match.ORDER))
        shown = render.profile_columns(found, profile, style, self.mapping, self.abbreviations, keep=("_keys",))
        if ordered:
            shown = match.in_order(shown, "_keys")
        if mark:
            shown = render.mark_sorted(shown, [c for c, what in profile.items() if what in render.MARKED], mark == "json")
        return shown.drop("_keys")

    def search(self, records: DataFrame, *args, **options) -> DataFrame:
        return search.search(records, *args, fields=self.fields, **options)

    def eid_metrics(self, records: DataFrame, titles: DataFrame | None = None) -> DataFrame:
        return metrics.event_id_counts(records, titles)

    def logon_summary(self, records: DataFrame) -> DataFrame:
        return metrics.logons(records)

    def computer_metrics(self, records: DataFrame, versions: DataFrame | None = None) -> DataFrame:
        return metrics.computers(records, versions)

    def log_metrics(self, records: DataFrame) -> DataFrame:
        return metrics.logs(records)

    def extract_base64(self, records: DataFrame) -> DataFrame:
        return base64_tokens.extract(records)

    def pivot_keywords(self, records: DataFrame, rules: list[Rule], categories: dict[str, list[str]]) -> DataFrame:
        return summary.pivot_keywords(match.match(records, rules, self.fields), categories, self.fields)

    def critical_systems(self, records: DataFrame) -> DataFrame:
        return metrics.critical_systems(records)

    def placeholders(self, rules: list[Rule]) -> list[str]:
        return sorted(rules_.placeholders(rules))

    @staticmethod
    def level_statistics(loaded: Loaded) -> dict:
        return rules_.load_statistics(loaded)


__all__ = ["Engine", "filters"]
