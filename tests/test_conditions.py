from __future__ import annotations

import pytest

from tracelake.operators.match import greedy_windows
from tracelake.plans import condition as c
from tracelake.plans.rule import choose, expand, from_doc, link, span_seconds
from tracelake.plans.selection import RuleError, base64_offsets, wild


def test_precedence_and_parentheses():
    assert c.parse("a or b and not c", ["a", "b", "c"]) == c.Both((c.Name("a"), c.Both((c.Name("b"), c.Not(c.Name("c"))), True)), False)
    assert c.parse("(a or b) and c", ["a", "b", "c"]) == c.Both((c.Both((c.Name("a"), c.Name("b")), False), c.Name("c")), True)


def test_all_and_one_of():
    assert c.parse("all of s_*", ["s_1", "s_2", "x"]) == c.Both((c.Name("s_1"), c.Name("s_2")), True)
    assert c.parse("1 of s_*", ["s_1", "s_2", "x"]) == c.Both((c.Name("s_1"), c.Name("s_2")), False)


@pytest.mark.parametrize("text", ["a and", "(a", "a b", "not not a", "a & b", "1 of them", ""])
def test_bad_conditions(text):
    with pytest.raises(c.ConditionError):
        c.parse(text, ["a", "b"])


def test_count():
    assert c.parse_count(" count(User) by A, B >= 3") == c.Count(">=", 3, "User", ("A", "B"))
    assert c.parse_count("count() > 10") == c.Count(">", 10)
    for bad in ("", "sum(x) > 1", "count()", "count() > x", "count() > 3 more"):
        with pytest.raises(c.ConditionError):
            c.parse_count(bad)


def test_wildcards():
    assert wild("a*b?c") == ["a", None, "b", True, "c"]
    assert wild(r"a\*b") == ["a*b"]
    assert wild(r"a\\*") == ["a\\", None]


def test_spans_and_base64():
    assert span_seconds("15m") == 900
    with pytest.raises(RuleError):
        span_seconds("15")
    import base64

    for shift in range(3):
        text = base64.b64encode(b"x" * shift + b"foobar" + b"yz").decode()
        assert any(form in text for form in base64_offsets(b"foobar"))


def test_windows_reset_after_a_hit():
    s = 1_000_000_000
    assert greedy_windows([i * s for i in range(10)], 100, ">=", 3) == [(0, 10, 10)]
    assert greedy_windows([0, 10 * s, 20 * s, 30 * s], 10, ">=", 2) == [(0, 2, 2), (2, 4, 2)]
    assert greedy_windows([0, 5 * s], 1, "<=", 1) == [(0, 1, 1), (1, 2, 1)]
    assert greedy_windows([0, s, 2 * s], 5, ">=", 2, ["a", "a", "b"]) == [(0, 3, 2)]


def doc(id_, **more):
    return {"id": id_, "title": id_, "level": "low", "status": "test", "author": "a", "date": "d", "logsource": {"category": "x"}, "detection": {"s": {"A": "b"}}, **more}


def test_choice_placeholders_and_links():
    rules = [from_doc(doc("1")), from_doc(doc("2", level="high", status="deprecated")), from_doc(doc("3", tags=["t.x"]))]
    got = choose(rules, include_tag=["T.X"])
    assert [r.id for r in got.rules] == ["3"] and got.left_out == {"tag": 1, "deprecated": 1}
    e = expand([from_doc(doc("4", detection={"s": {"User|expand": "%Admins%"}}))], {"Admins": ["x", "y"]})
    assert e.rules[0].doc["detection"]["s"] == {"User": ["x", "y"]}
    assert expand([from_doc(doc("5", detection={"s": {"User|expand": "%No%"}}))], {}).rules == []
    corr = {"id": "c", "title": "c", "level": "high", "correlation": {"type": "event_count", "rules": ["1"], "timespan": "5m", "group-by": ["Computer"], "condition": {"gte": 2}}}
    out = link([from_doc(doc("1")), from_doc(corr)])
    assert [r.id for r in out.rules] == ["c"] and out.rules[0].count == c.Count(">=", 2, None, ("Computer",))
    broken = link([from_doc({**corr, "correlation": {**corr["correlation"], "rules": ["none"]}})])
    assert broken.errors
