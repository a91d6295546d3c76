"""Rules: loading, checking, choosing, placeholders and correlations. All of it is work of the driver on small YAML trees."""

from __future__ import annotations

import copy
import csv
import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml
from pyspark.sql import Column

from . import condition as cond
from .selection import Fields, RuleError, selection

LEVELS = ("undefined", "informational", "low", "medium", "high", "critical", "emergency")
LEVEL_ABBREVIATIONS = ("undef", "info", "low", "med", "high", "crit", "emer")
STATUSES = ("stable", "test", "experimental", "deprecated", "unsupported")
REQUIRED = ("author", "title", "level", "status", "date", "id")
_SPAN = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def span_seconds(text: object) -> int:
    """<number><s|m|h|d> in seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", str(text))
    if not m:
        raise RuleError(f"a time span like 15m is needed, not {text!r}")
    return int(m[1]) * _SPAN[m[2]]


def level_rank(level: object) -> int:
    text = str(level or "").lower()
    return LEVELS.index(text) if text in LEVELS else 0


@dataclass
class Rule:
    doc: dict
    path: str = ""
    count: cond.Count | None = None
    frame: int | None = None
    kind: str = "plain"  # plain, event_count, value_count, temporal, temporal_ordered
    refs: tuple[str, ...] = ()
    hidden: bool = False  # matched for a correlation, not reported
    parts: tuple[Rule, ...] = ()  # rules whose matches this one counts

    @property
    def id(self) -> str:
        return str(self.doc.get("id", ""))

    @property
    def title(self) -> str:
        return str(self.doc.get("title", ""))

    @property
    def level(self) -> str:
        return LEVELS[level_rank(self.doc.get("level"))]

    @property
    def rank(self) -> int:
        return level_rank(self.doc.get("level"))

    @property
    def tags(self) -> list[str]:
        return [str(t) for t in self.doc.get("tags") or []]

    @property
    def names(self) -> set[str]:
        return {str(self.doc[k]) for k in ("id", "title", "name") if self.doc.get(k)}

    def matcher(self, f: Fields) -> Column:
        """The rule's condition as one boolean column."""
        if self.parts:
            tests = [p.matcher(f) for p in self.parts]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out
        detection = self.doc.get("detection") or {}
        made = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}
        if not made:
            raise RuleError("no selection")
        text = detection.get("condition")
        if text is None:
            if len(made) != 1:
                raise RuleError("a condition is needed with several selections")
            text = next(iter(made))
        columns: dict[str, Column] = {}

        def build(node: object) -> Column:
            if isinstance(node, cond.Name):
                if node.text not in columns:
                    columns[node.text] = selection(made[node.text], f)
                return columns[node.text]
            if isinstance(node, cond.Not):
                return ~build(node.of)
            parts = [build(p) for p in node.parts]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if node.all else (out | p)
            return out

        return build(cond.parse(cond.split_pipe(str(text))[0], list(made)))


def check(doc: dict) -> list[str]:
    """What is wrong with a rule's own fields."""
    if not isinstance(doc, dict):
        return ["not a mapping"]
    need = REQUIRED + (() if "correlation" in doc else ("logsource", "detection"))
    out = [f"{k} is missing" for k in need if doc.get(k) in (None, "")]
    if doc.get("level") and str(doc["level"]).lower() not in LEVELS:
        out.append(f"level {doc['level']} is unknown")
    if doc.get("status") and str(doc["status"]).lower() not in STATUSES:
        out.append(f"status {doc['status']} is unknown")
    return out


def from_doc(doc: dict, path: str = "") -> Rule:
    rule = Rule(doc, path)
    if "correlation" in doc:
        rule.kind = str(doc["correlation"].get("type"))
        rule.refs = tuple(str(x) for x in doc["correlation"].get("rules") or ())
        return rule
    detection = doc.get("detection") or {}
    _, tail = cond.split_pipe(str(detection.get("condition", "")))
    if tail is not None:
        rule.count = cond.parse_count(tail)
    if detection.get("timeframe") is not None:
        rule.frame = span_seconds(detection["timeframe"])
    return rule


@dataclass
class Loaded:
    rules: list[Rule] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    left_out: Counter = field(default_factory=Counter)


def read_rules(path: str) -> Loaded:
    """All rules of a file or folder; every document of every .yml; .git is skipped."""
    out = Loaded()
    top = Path(path)
    files = [top] if top.is_file() else sorted(p for p in top.rglob("*.y*ml") if ".git" not in p.parts)
    for f in files:
        try:
            docs = list(yaml.safe_load_all(f.read_text(encoding="utf-8")))
        except (yaml.YAMLError, UnicodeDecodeError) as e:
            out.errors.append((str(f), f"cannot be read: {e}"))
            continue
        for doc in docs:
            if doc is None:
                continue
            try:
                out.rules.append(from_doc(doc, str(f)))
            except (RuleError, cond.ConditionError, AttributeError) as e:
                out.errors.append((str(f), str(e)))
    return out


def read_ids(path: str) -> set[str]:
    """Ids of a list file, one a line; # begins a comment."""
    lines = (x.split("#")[0].strip() for x in Path(path).read_text(encoding="utf-8").splitlines())
    return {x.split()[0] for x in lines if x}


def read_pairs(path: str) -> dict[str, str]:
    """A two-column CSV; the rest of a row belongs to the second column."""
    with open(path, newline="", encoding="utf-8") as f:
        return {r[0].strip(): ",".join(r[1:]).strip() for r in csv.reader(f) if len(r) > 1}


def choose(rules: Iterable[Rule], *, min_level: str | None = None, exact_level: str | None = None, include_status: Iterable[str] = (), exclude_status: Iterable[str] = (),
           include_category: Iterable[str] = (), exclude_category: Iterable[str] = (), include_tag: Iterable[str] = (), exclude_tag: Iterable[str] = (),
           exclude_ids: Iterable[str] = (), noisy_ids: Iterable[str] = (), proven_ids: Iterable[str] = (), enable_noisy: bool = False,
           enable_deprecated: bool = False, enable_unsupported: bool = False) -> Loaded:
    """The rules that options let through, and counts of why others were left out."""
    sets = [set(map(str.lower, x)) for x in (include_status, exclude_status, include_category, exclude_category, include_tag, exclude_tag)]
    in_status, out_status, in_category, out_category, in_tag, out_tag = sets
    excluded, noisy, proven = set(exclude_ids), set(noisy_ids), set(proven_ids)
    out = Loaded()
    for r in rules:
        status = str(r.doc.get("status") or "").lower()
        category = str((r.doc.get("logsource") or {}).get("category") or "").lower()
        tags = {t.lower() for t in r.tags}
        why = None
        if r.id in excluded:
            why = "excluded"
        elif r.id in noisy and not enable_noisy:
            why = "noisy"
        elif proven and r.id not in proven:
            why = "not proven"
        elif min_level and r.rank < level_rank(min_level):
            why = "level"
        elif exact_level and r.rank != level_rank(exact_level):
            why = "level"
        elif status == "deprecated" and not enable_deprecated and status not in in_status:
            why = "deprecated"
        elif status == "unsupported" and not enable_unsupported and status not in in_status:
            why = "unsupported"
        elif in_status and "*" not in in_status and status not in in_status or status in out_status:
            why = "status"
        elif in_category and category not in in_category or category and category in out_category:
            why = "category"
        elif in_tag and not tags & in_tag or tags & out_tag:
            why = "tag"
        if why:
            out.left_out[why] += 1
        else:
            out.rules.append(r)
    return out


def load_statistics(loaded: Loaded) -> dict[str, Counter]:
    """Counts of rules by level, status and kind, and of errors."""
    return {
        "level": Counter(r.level for r in loaded.rules), "status": Counter(str(r.doc.get("status") or "undefined") for r in loaded.rules),
        "kind": Counter(r.kind for r in loaded.rules), "left out": Counter(loaded.left_out), "errors": Counter({"errors": len(loaded.errors)}),
    }


def tune_levels(rules: Iterable[Rule], levels: dict[str, str]) -> list[Rule]:
    """Rules with other levels by id; the files stay as they are."""
    bad = {x for x in levels.values() if str(x).lower() not in LEVELS}
    if bad:
        raise RuleError(f"level {sorted(bad)[0]} is unknown")
    return [replace(r, doc={**r.doc, "level": levels[r.id]}) if r.id in levels else r for r in rules]


_PLACEHOLDER = re.compile(r"%([^%\s]+)%")


def read_placeholders(folder: str) -> dict[str, list[str]]:
    """name -> values from name.txt files."""
    return {p.stem: [x.strip() for x in p.read_text(encoding="utf-8").splitlines() if x.strip()] for p in sorted(Path(folder).glob("*.txt"))}


def placeholders(rules: Iterable[Rule]) -> set[str]:
    """The placeholders that |expand fields ask for."""
    found: set[str] = set()

    def walk(node: object, expand: bool) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, expand or "expand" in str(k).split("|")[1:])
        elif isinstance(node, list):
            for x in node:
                walk(x, expand)
        elif expand and isinstance(node, str):
            found.update(_PLACEHOLDER.findall(node))

    for r in rules:
        walk(r.doc.get("detection") or {}, False)
    return found


def expand(rules: Iterable[Rule], values: dict[str, list[str]]) -> Loaded:
    """|expand strings become lists of their placeholders' values; a rule with an undefined one is left out."""

    def walk(node: object, on: bool) -> object:
        if isinstance(node, dict):
            out = {}
            for k, v in node.items():
                name, *mods = str(k).split("|")
                has = "expand" in mods
                out["|".join([name, *(m for m in mods if m != "expand")]) if has else k] = walk(v, on or has)
            return out
        if isinstance(node, list):
            flat = []
            for x in node:
                y = walk(x, on)
                flat += y if on and isinstance(y, list) else [y]
            return flat
        if on and isinstance(node, str) and (names := _PLACEHOLDER.findall(node)):
            texts = [node]
            for name in names:
                texts = [t.replace(f"%{name}%", v) for t in texts for v in values[name]]
            return texts
        return node

    out = Loaded()
    for r in rules:
        needed = placeholders([r])
        if not needed:
            out.rules.append(r)
        elif missing := [n for n in needed if not values.get(n)]:
            out.left_out["placeholder"] += 1
            out.errors.append((r.path, f"%{sorted(missing)[0]}% has no values"))
        else:
            out.rules.append(replace(r, doc={**r.doc, "detection": walk(r.doc["detection"], False)}))
    return out


_OPS = {"eq": "==", "gte": ">=", "lte": "<=", "gt": ">", "lt": "<"}


def _referenced(refs: Iterable[str], rules: list[Rule]) -> list[Rule]:
    out = []
    for ref in refs:
        found = [r for r in rules if ref in r.names]
        if not found:
            raise RuleError(f"rule {ref} is not known")
        out.append(found[0])
    return out


def link(rules: Iterable[Rule]) -> Loaded:
    """Correlations resolved: counts become rules over the union of what they refer to; temporal ones get a hidden
    count of one or more for each rule that they refer to. Rules that a correlation refers to are reported only if it generates them."""
    rules = list(rules)
    out = Loaded(errors=[])
    plain = [r for r in rules if r.kind == "plain"]
    made: list[Rule] = []
    silent: set[int] = set()
    for r in (r for r in rules if r.kind in ("event_count", "value_count")):
        try:
            c = r.doc["correlation"]
            for k in ("rules", "timespan", "group-by", "condition"):
                if not c.get(k):
                    raise RuleError(f"{k} is missing in a correlation")
            parts = _referenced(r.refs, plain)
            op = next((k for k in c["condition"] if k in _OPS), None)
            if op is None:
                raise RuleError("a correlation needs eq, gte, lte, gt or lt")
            what = c["condition"].get("field")
            if r.kind == "value_count" and not what:
                raise RuleError("value_count needs a field")
            count = cond.Count(_OPS[op], int(c["condition"][op]), str(what) if r.kind == "value_count" else None, tuple(map(str, c["group-by"])))
            made.append(replace(r, count=count, frame=span_seconds(c["timespan"]), parts=tuple(parts)))
            if not c.get("generate"):
                silent.update(id(p) for p in parts)
        except (RuleError, KeyError, TypeError, ValueError) as e:
            out.errors.append((r.path, str(e)))
    for r in (r for r in rules if r.kind in ("temporal", "temporal_ordered")):
        try:
            c = r.doc["correlation"]
            for k in ("rules", "timespan"):
                if not c.get(k):
                    raise RuleError(f"{k} is missing in a correlation")
            frame = span_seconds(c["timespan"])
            clones = []
            for p in _referenced(r.refs, plain + made):
                own = f"{r.id}:{len(clones)}:{uuid.uuid5(uuid.NAMESPACE_URL, p.id)}"
                doc = copy.deepcopy(p.doc) | {"id": own}
                if p.count is not None:
                    clone = replace(p, doc=doc, hidden=True)
                else:
                    clone = replace(p, doc=doc, hidden=True, frame=frame, count=cond.Count(">=", 1, None, tuple(map(str, c.get("group-by") or ()))))
                clones.append(clone)
                if not c.get("generate"):
                    silent.add(id(p))
            out.rules += clones
            made.append(replace(r, frame=frame, refs=tuple(x.id for x in clones)))
        except (RuleError, KeyError, TypeError, ValueError) as e:
            out.errors.append((r.path, str(e)))
    out.rules = [r for r in plain + made if id(r) not in silent] + out.rules
    for r in rules:
        if r.kind not in ("plain", "event_count", "value_count", "temporal", "temporal_ordered"):
            out.errors.append((r.path, f"correlation type {r.kind} is unknown"))
    return out


def required_channels(rule: Rule) -> set[str] | None:
    """Texts of which a record's channel must contain one for the rule to match, or None if it may match any channel.

    Of an `and` one side's demand is enough, an `or` has one only if all its sides have, a `not` has none; so no
    record that the rule matches is ever left out.
    """
    if rule.parts:
        needs = [required_channels(p) for p in rule.parts]
        return None if any(n is None for n in needs) else set().union(*needs)
    if rule.kind != "plain":
        return None
    detection = rule.doc.get("detection") or {}
    made = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}

    def named(key: object, value: object) -> set[str] | None:
        name, *modifiers = str(key).split("|")
        if name != "Channel" or not set(modifiers) <= {"contains", "startswith", "endswith"}:
            return None
        texts = {str(x).strip("*") for x in (value if isinstance(value, list) else [value]) if isinstance(x, str)}
        plain = len(texts) == len(value if isinstance(value, list) else [value]) and all(t and not set(t) & set("*?\\") for t in texts)
        return texts if plain else None

    def of(node: object) -> set[str] | None:
        if isinstance(node, cond.Name):
            return of_selection(made[node.text])
        if isinstance(node, cond.Not):
            return None
        needs = [of(p) for p in node.parts]
        return all_of(needs) if node.all else any_of(needs)

    def of_selection(v: object) -> set[str] | None:
        if isinstance(v, dict):
            return all_of([named(k, x) for k, x in v.items()])
        return any_of([of_selection(x) for x in v]) if isinstance(v, list) else None

    all_of = lambda needs: min((n for n in needs if n is not None), key=len, default=None)
    any_of = lambda needs: None if not needs or any(n is None for n in needs) else set().union(*needs)
    text = detection.get("condition")
    return of(cond.parse(cond.split_pipe(str(text))[0], list(made))) if text is not None else any_of([of_selection(v) for v in made.values()])
