"""The condition grammar: selections, and, or, not, parentheses, `all of x*` and `1 of x*`; behind a pipe the count."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"[()]|\s+|\w+")
_COUNT = re.compile(r"\s*count\s*\(\s*([^)]*?)\s*\)\s*(?:by\s+(.+?)\s*)?(==|>=|<=|>|<)\s*(\S+)\s*(.*)$", re.S)


class ConditionError(ValueError):
    pass


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    """and (all=True) or or (all=False) of parts."""

    parts: tuple
    all: bool


@dataclass(frozen=True)
class Count:
    """count(field) by keys, compared with a number."""

    op: str
    number: int
    field: str | None = None
    by: tuple[str, ...] = ()


def split_pipe(text: str) -> tuple[str, str | None]:
    head, bar, tail = text.partition("|")
    return head.strip(), tail if bar else None


def parse_count(text: str) -> Count:
    if not text.strip():
        raise ConditionError("nothing stands behind the pipe")
    if not text.strip().startswith("count"):
        raise ConditionError("only count can follow the pipe")
    m = _COUNT.match(text)
    if not m:
        raise ConditionError("count needs a comparison and a number, like '> 3'")
    field, by, op, number, more = m.groups()
    if more.strip():
        raise ConditionError("unnecessary words behind the number")
    try:
        value = int(number)
    except ValueError:
        raise ConditionError("the comparison needs a number") from None
    keys = tuple(k.strip() for k in by.split(",")) if by else ()
    return Count(op, value, field or None, keys)


def _expand(text: str, names: list[str]) -> str:
    def one(m: re.Match) -> str:
        found = [n for n in names if n.startswith(m[2])]
        if not found:
            return m[0]
        return "(" + (" and " if m[1].lower() == "all" else " or ").join(found) + ")"

    return re.sub(r"(all|1) of ([^\s*()]+)\*", one, text)


def parse(text: str, names: list[str]) -> object:
    """The tree of a condition over selections of these names."""
    text = _expand(text, names)
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConditionError(f"unknown character {text[at]!r}")
        if not m[0].isspace():
            tokens.append(m[0])
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos] if pos < len(tokens) else None

    def many(word: str, below, all_: bool) -> object:
        nonlocal pos
        parts = [below()]
        while (t := peek()) and t.lower() == word:
            pos += 1
            parts.append(below())
        return parts[0] if len(parts) == 1 else Both(tuple(parts), all_)

    def disjunction() -> object:
        return many("or", conjunction, False)

    def conjunction() -> object:
        return many("and", operand, True)

    def operand() -> object:
        nonlocal pos
        t = peek()
        if t is None:
            raise ConditionError("a selection is missing")
        pos += 1
        if t.lower() == "not":
            if (peek() or "").lower() == "not":
                raise ConditionError("not follows not")
            return Not(operand())
        if t == "(":
            inside = disjunction()
            if peek() != ")":
                raise ConditionError("a closing parenthesis is missing")
            pos += 1
            return inside
        if t == ")" or t.lower() in ("and", "or"):
            raise ConditionError(f"{t} stands where a selection should")
        if t not in names:
            raise ConditionError(f"{t} is no selection")
        return Name(t)

    tree = disjunction()
    if pos < len(tokens):
        raise ConditionError(f"{tokens[pos]} is not expected")
    return tree
