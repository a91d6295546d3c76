"""The literal prefilter: what rules ask for, and that matches are the same with it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracelake import catalog
from tracelake.operators import match
from tracelake.plans import literals
from tracelake.plans.rule import from_doc
from tracelake.plans.selection import Fields


@pytest.mark.parametrize("detection, want", [
    ({"s": {"A|contains": "PowerShell.exe"}}, {"powershell.exe"}),
    ({"s": {"A": r"C:\Windows\\*\evil?tool"}}, {"windows"}),
    ({"s": {"A": r"C:\Windows\*\evil?tool"}}, {"windows*"}),
    ({"s": {"A": ["first*", "*second"]}}, {"first", "second"}),
    ({"s": {"A|contains|all": ["abc", "longer one"]}}, {"longer one"}),
    ({"s": {"A|contains": ["good", "1234"]}}, None),
    ({"s": {"A|re": "secret.*"}}, None),
    ({"s": {"A|neq": "secret"}}, None),
    ({"s": {"A|contains|windash": "-secret"}}, None),
    ({"s": {"A": {"min_length": 3, "value": "wanted*"}}}, {"wanted"}),
    ({"s": {"EventID": 4624, "Channel": "Security", "B|startswith": "é unlocked"}}, {" unlocked"}),
    ({"k": ["*keyword one*", "other"]}, {"keyword one", "other"}),
    ({"k": {"|all": ["keyword one", "other"]}}, {"keyword one"}),
    ({"a": {"A": "alpha"}, "b": {"B": "beta"}, "condition": "a and not b"}, {"alpha"}),
    ({"a": {"A": "alpha"}, "b": {"B": "beta"}, "condition": "a or not b"}, None),
    ({"a": {"A": "alpha"}, "b": {"B": "beta"}, "condition": "1 of *"}, None),
    ({"s_a": {"A": "alpha"}, "s_b": {"B": "beta"}, "condition": "1 of s_*"}, {"alpha", "beta"}),
    ({"s": [{"A": "alpha", "B": "be"}, {"A": "gamma*delta"}]}, {"alpha", "gamma"}),
    ({"s": {"A": "1e5"}}, None),
    ({"s": {"A": None}}, None),
])
def test_needed(detection, want):
    doc = catalog.rule("r", detection)
    try:
        got = literals.needed(from_doc(doc), Fields(aliases=catalog.ALIASES))
    except Exception:
        assert want is None  # a condition that does not parse is told where the rule is compiled
        return
    assert (set(got) if got else got) == want


def test_same_matches(spark, monkeypatch):
    r = catalog.records(spark, "/root/testdata/sf0.001")
    own = lambda: Fields(aliases=dict(catalog.ALIASES), files=lambda name: catalog.RULE_FILES[name])
    rules = catalog.linked(*[catalog.rule(k, d, "low") for k, (d, _) in {**catalog.LEAVES, **catalog.FORMS}.items()])
    key = lambda df: sorted(map(str, df.select("rule_id", "record_id").collect()))
    want = key(match.match(r, rules, own()))
    assert sum(literals.needed(x, own()) is not None for x in rules) > 10
    monkeypatch.setattr(match, "PREFILTER_RULES", 3)
    monkeypatch.setattr(match, "PREFILTER_CHUNK", 4)
    plan = match.match(r, rules, own())
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString() and key(plan) == want


def test_letters_that_fold_to_ascii(spark, monkeypatch):
    """What case-insensitive comparison takes for ASCII letters is found too."""
    rows = [(str(i), x) for i, x in enumerate(["MASK", "maſK", "mask", "mas", "Kıss me", "kiss ME"])]
    r = spark.createDataFrame(rows, "record_id string, a string").select("record_id", F.to_variant_object(F.struct(F.struct(F.struct(F.col("a").alias("A")).alias("EventData")).alias("Event"))).alias("event"))
    r = r.withColumns({"data_string": F.to_json("event"), "event_id": F.lit("1"), "channel": F.lit("c"), "computer": F.lit("h")})
    rules = catalog.linked(*[catalog.rule(f"{w}{k}", {"s": {"A": w}}) for k in range(2) for w in ("m*ask?", "ma*sk*", "mask", "*kiss*e")])
    key = lambda: sorted(map(str, match.match(r, rules, Fields()).select("rule_id", "record_id").collect()))
    want = key()
    assert len(want) > 6
    monkeypatch.setattr(match, "PREFILTER_RULES", 2)
    assert key() == want
