"""Texts that a record must hold for a rule to match, and an automaton that looks for those of thousands of rules at once.

A rule asks for one of some literals where its selections compare fields with texts: of an `and` one side is enough, an `or` asks for one of all its sides, a `not` for
nothing. A literal is a plain piece of a value in lower case, as it stands in the record's JSON: no quotes, slashes or escapes, with a letter in it, no number. So no
record that the rule matches is ever left out; that a literal is there says nothing more.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.plans import condition as cond
from tracelake.plans.rule import Rule
from tracelake.plans.selection import Fields, wild

#: Shorter pieces are in nearly every record.
SHORTEST = 3
_PIECE = re.compile(r"[ !#-.0-\[\]-~]+")
_NUMBER = re.compile(r"[-+0-9.e ]*\Z")
#: Letters beyond ASCII that case-insensitive comparison takes for ASCII ones.
FOLDED = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})
#: Fields that records have as columns of their own; their JSON may lack them.
TYPED = frozenset({"Event.System.EventID", "Event.System.Channel", "Event.System.Computer"})

Need = frozenset[str] | None


def _of_text(text: str) -> Need:
    found = [p.lower() for part in wild(text) if isinstance(part, str) for p in _PIECE.findall(part)]
    good = [p for p in found if len(p) >= SHORTEST and not _NUMBER.match(p)]
    return frozenset({max(good, key=len)}) if good else None


def _either(needs: list[Need]) -> Need:
    return None if not needs or any(n is None for n in needs) else frozenset().union(*needs)


def by_length(need: frozenset[str]) -> tuple:
    """A guess at how many records hold one of the literals: fewer, the longer they are."""
    return -min(map(len, need)), len(need)


def needed(rule: Rule, fields: Fields, cost: Callable[[frozenset[str]], object] = by_length, seen: set[str] | None = None) -> Need:
    """Literals of which a record must hold one, or None if the rule may match without any. Of an `and` the side of the least cost counts. seen: gets all literals that could be asked for."""
    if rule.parts:
        return _either([needed(p, fields, cost, seen) for p in rule.parts])
    if rule.kind != "plain":
        return None
    detection = rule.doc.get("detection") or {}
    made = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}

    def leaf(key: str, value: object) -> Need:
        name, *mods = key.split("|")
        if not isinstance(value, str) or not set(mods) <= {"contains", "startswith", "endswith", "cased", "all"}:
            return None
        need = None if name and fields.path(name) in TYPED else _of_text(value)
        if seen is not None and need:
            seen.update(need)
        return need

    def _both(needs: list[Need]) -> Need:
        return min((n for n in needs if n), key=cost, default=None)

    def selection(v: object, key: str = "") -> Need:
        if isinstance(v, dict):
            if key and set(v) & {"min_length", "regexes", "allowlist", "value"}:
                return leaf(key, v.get("value"))
            return _both([selection(x, f"{key}.{k}" if key and not key.startswith("|") else str(k)) for k, x in v.items()])
        if isinstance(v, list):
            return (_both if "all" in key.split("|")[1:] else _either)([selection(x, key) for x in v])
        return leaf(key, v)

    def of(node: object) -> Need:
        if isinstance(node, cond.Name):
            return selection(made[node.text])
        if isinstance(node, cond.Not):
            return None
        return (_both if node.all else _either)([of(p) for p in node.parts])

    text = detection.get("condition")
    return of(cond.parse(cond.split_pipe(str(text))[0], list(made))) if text is not None else _either([selection(v) for v in made.values()])


def finder(needs: list[frozenset[str]], chunk: int) -> Callable[[Column], Column]:
    """Of a text column: rules (the places of the demands that it meets) and chunks (their places by `chunk`)."""
    owners: dict[str, list[int]] = {}
    for i, need in enumerate(needs):
        for literal in need:
            owners.setdefault(literal, []).append(i)
    made: list = []  # a worker's automaton: built once, never sent

    def automaton():
        import ahocorasick

        if not made:
            a = ahocorasick.Automaton()
            for literal, rules in owners.items():
                a.add_word(literal, rules)
            a.make_automaton()
            made.append(a)
        return made[0]

    # Called non-deterministic so that the planner neither repeats it for a filter nor for a field of its result.
    @F.pandas_udf("struct<rules:array<int>,chunks:array<int>>")
    def find(texts: pd.Series) -> pd.DataFrame:
        a, out = automaton(), []
        for text in texts:
            met: set[int] = set()
            for hit in {id(rules): rules for _, rules in a.iter(text.translate(FOLDED).lower())}.values() if text else ():
                met.update(hit)
            out.append(sorted(met))
        return pd.DataFrame({"rules": out, "chunks": [sorted({i // chunk for i in x}) for x in out]})

    return find.asNondeterministic()


def count(records: DataFrame, texts: list[str]) -> dict[str, int]:
    """How many records hold each of the texts, of those that some record holds: as many numbers as there are texts."""
    met = records.select(F.explode(finder([frozenset({x}) for x in texts], len(texts))(F.col("data_string"))["rules"]).alias("place"))
    return {texts[r["place"]]: r["count"] for r in met.groupBy("place").count().collect()}


def available() -> bool:
    """Whether there is an automaton here; the plan does without where there is none."""
    return find_spec("ahocorasick") is not None
