"""Selections of a rule as boolean columns: field modifiers, wildcards, lists and maps."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import columns as C

#: The modifiers that a rule may use.
MODIFIERS = frozenset(
    "startswith endswith contains re i m s exists cidr windash fieldref equalsfield endswithfield base64 base64offset "
    "all cased gt lt gte lte utf16 utf16le utf16be wide neq expand".split()
)
WINDASH = "-–—―"


class RuleError(ValueError):
    pass


@dataclass
class Fields:
    """Where keys are: aliases, and the columns that a plan has already made of paths."""

    aliases: dict[str, str] = field(default_factory=dict)
    files: Callable[[str], list[str]] | None = None
    windash: str = WINDASH
    strict_cased: bool = False
    asked: dict[str, None] = field(default_factory=dict)
    ready: dict[str, Column] = field(default_factory=dict)
    arrays: dict[str, Column] = field(default_factory=dict)
    #: Paths become columns of these names as they are asked for, which a plan then makes.
    numbered: str | None = None

    def path(self, key: str) -> str:
        if key in self.aliases:
            return self.aliases[key]
        return key if "." in key else f"Event.EventData.{key}"

    def value(self, key: str) -> Column:
        path = self.path(key)
        self.asked[path] = None
        if path not in self.ready and self.numbered:
            self.ready[path] = F.col(f"{self.numbered}{len(self.asked) - 1}")
        return self.ready[path] if path in self.ready else C.scalar(F.col("event"), path)

    def array(self, key: str) -> Column:
        path = self.path(key)
        return self.arrays[path] if path in self.arrays else C.array_of(F.col("event"), path)


def literal(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def wild(text: str) -> list[str | None | bool]:
    """A value in parts: text, None for * and True for ?. A backslash frees the next wildcard; two before one are one."""
    out: list = []
    plain = ""
    i = 0
    while i < len(text):
        two = text[i : i + 2]
        if two in ("\\*", "\\?"):
            plain += two[1]
            i += 2
        elif two == "\\\\" and text[i + 2 : i + 3] in ("*", "?"):
            plain += "\\"
            i += 2
            out += [plain, None if text[i] == "*" else True]
            plain = ""
            i += 1
        elif text[i] in "*?":
            out += [plain, None if text[i] == "*" else True]
            plain = ""
            i += 1
        elif two == "\\\\":
            plain += "\\"
            i += 2
        else:
            plain += text[i]
            i += 1
    return [x for x in [*out, plain] if x != ""]


def wild_regex(parts: list, whole: bool = True, cased: bool = False) -> str:
    body = "".join("[\\s\\S]*" if x is None else "[^\\n]" if x is True else C.quote(x) for x in parts)
    return ("" if cased else "(?iu)") + (f"^(?:{body})\\z" if whole else body)


def matches_wild(v: Column, text: str, cased: bool = False) -> Column:
    """Whole-value match of a wildcard pattern, by the cheapest test that does."""
    parts = wild(text)
    plain = [x for x in parts if isinstance(x, str)]
    if not parts:
        return C.truth(v == "")
    if len(plain) == len(parts):
        return C.truth(v == plain[0]) if cased else C.ascii_equals(v, plain[0])
    if True not in parts and len(plain) == 1 and len(parts) <= 3:
        p = plain[0] if cased else plain[0].lower()
        w = v if cased else F.lower(v)
        test = w.startswith(p) if parts[0] is not None else w.endswith(p) if parts[-1] is not None else w.contains(p)
        return C.truth(test)
    if parts == [None]:
        return v.isNotNull()
    return C.truth(v.rlike(wild_regex(parts, cased=cased)))


def java_regex(pattern: str, flags: str = "") -> str:
    """A pattern of a linear-time dialect for Java: Unicode classes, only \\n ends lines, $ is the very end."""
    if re.search(r"\(\?(<?[=!])|\\[1-9]", pattern):
        raise RuleError("look-around and back-references are not allowed")
    out, i, in_class = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out += pattern[i : i + 2]
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out += "\\z" if c == "$" and not in_class and "m" not in flags else c
        i += 1
    return f"(?dU{flags.replace('i', 'iu')})" + out


def base64_offsets(raw: bytes) -> list[str]:
    """The three forms that encoded bytes take inside a longer text, without what neighbours change."""
    out = []
    for shift in range(3):
        text = base64.b64encode(b"\0" * shift + raw).decode().rstrip("=")
        start = (0, 2, 3)[shift]
        end = len(text) - (1 if (len(raw) + shift) % 3 else 0)
        out.append(text[start:end])
    return out


def _utf16(text: str, mods: set[str], offset: bool) -> list[bytes]:
    if "utf16be" in mods:
        return [text.encode("utf-16-be")]
    if mods & {"utf16le", "wide"}:
        return [text.encode("utf-16-le")]
    if "utf16" in mods:
        return [text.encode("utf-16-le"), text.encode("utf-16-be")] if offset else [b"\xff\xfe" + text.encode("utf-16-le")]
    return [text.encode()]


def _leaf_value(v: Column, mods: set[str], text: str, f: Fields) -> Column:
    """One value under its modifiers, without negation."""
    if "re" in mods:
        return C.truth(v.rlike(java_regex(text, "".join(x for x in "ims" if x in mods))))
    if "cidr" in mods:
        return C.in_cidr(v, text)
    for name, op in (("gte", Column.__ge__), ("lte", Column.__le__), ("gt", Column.__gt__), ("lt", Column.__lt__)):
        if name in mods:
            if not re.fullmatch(r"\+?\d+", text) or int(text) >= 1 << 64:
                raise RuleError(f"{name} needs a whole number, not {text!r}")
            return C.truth(op(C.unsigned(v), F.lit(int(text)).cast("decimal(20,0)")))
    if "fieldref" in mods or mods & {"equalsfield", "endswithfield"}:
        w = f.value(text)
        if "startswith" in mods:
            return C.truth(F.lower(v).startswith(F.lower(w)))
        if "endswith" in mods or "endswithfield" in mods:
            return C.truth(F.lower(v).endswith(F.lower(w)))
        if "contains" in mods:
            return C.truth(F.lower(v).contains(F.lower(w)))
        return C.truth(v == w)
    if "base64offset" in mods:
        forms = [x for raw in _utf16(text, mods, True) for x in base64_offsets(raw)]
        return reduce(or_, [C.truth(v.contains(x)) for x in forms])
    if "base64" in mods:
        forms = [base64.b64encode(raw).decode().rstrip("=") for raw in _utf16(text, mods, False)]
        return reduce(or_, [C.truth(F.lower(v).contains(x.lower())) for x in forms])
    cased = "cased" in mods
    if "contains" in mods and "windash" in mods:
        dash = f"[{re.escape(f.windash)}]"
        other = F.regexp_replace(v, f"^([^{re.escape(f.windash)}]*){dash}", "$1/")
        forms = {text, re.sub(dash, "/", text, count=1)}
        return reduce(or_, [matches_wild(other, f"*{x}*") for x in sorted(forms)])
    if "contains" in mods:
        return matches_wild(v, f"*{text}*", cased)
    if "startswith" in mods:
        return matches_wild(v, f"{text}*", cased)
    if "endswith" in mods:
        return matches_wild(v, f"*{text}", cased)
    return matches_wild(v, text, cased and f.strict_cased)


def leaf(key: str, value: object, f: Fields) -> Column:
    """key|modifiers: value."""
    name, *mods_ = key.split("|")
    mods = set(mods_)
    if len(mods_) > 3:
        raise RuleError(f"more than three modifiers: {key}")
    if unknown := mods - MODIFIERS:
        raise RuleError(f"unknown modifier {sorted(unknown)[0]}: {key}")
    negated = "neq" in mods
    if not name:
        if value is None:
            return F.lit(False)
        if negated:
            raise RuleError("neq needs a key")
        if "re" in mods:
            return C.truth(F.col("data_string").rlike(java_regex(literal(value))))
        return grep(literal(value))
    if value is None:
        test = f.value(name).isNull()
    elif "exists" in mods:
        test = f.value(name).isNotNull() == F.lit(literal(value).lower() == "true")
    elif isinstance(value, int) and not isinstance(value, bool) and key == "EventID":
        test = C.truth(f.value(name) == str(value))
    else:
        text = literal(value)
        one = lambda v: _leaf_value(v, mods, text, f)
        test = one(f.value(name))
        if f.path(name).rpartition(".")[2] in ("Data", "EventData"):
            test = F.when(f.array(name).isNotNull(), F.exists(f.array(name), one)).otherwise(test)
    return ~test if negated else test


def grep(text: str) -> Column:
    """A keyword anywhere in the whole record."""
    parts = wild(text)
    while parts and parts[0] is None:  # the search is unanchored, so an outer * asks for nothing and would only backtrack
        parts = parts[1:]
    while parts and parts[-1] is None:
        parts = parts[:-1]
    if all(isinstance(x, str) for x in parts):
        return C.truth(F.lower(F.col("data_string")).contains("".join(parts).lower()))
    return C.truth(F.col("data_string").rlike(wild_regex(parts, whole=False)))


def _special(key: str, value: dict, f: Fields) -> Column | None:
    """min_length, regexes, allowlist and value under a key."""
    v = f.value(key.split("|")[0])
    if "min_length" in value:
        tests = [C.truth(F.octet_length(v) >= int(value["min_length"]))]
    else:
        tests = []
    lines = lambda name: [java_regex(x) for x in (f.files(str(value[name])) if f.files else []) if x.strip()]
    if "regexes" in value:
        tests.append(reduce(or_, [C.truth(v.rlike(x)) for x in lines("regexes")], F.lit(False)))
    if "allowlist" in value:
        tests.append(~reduce(or_, [C.truth(v.rlike(x)) for x in lines("allowlist")], F.lit(False)))
    if "value" in value:
        tests.append(leaf(key, value["value"], f))
    return reduce(and_, tests) if tests else None


def selection(node: object, f: Fields, key: str = "") -> Column:
    """A selection's tree: maps are and, lists or (and under |all)."""
    if isinstance(node, dict):
        if key and set(node) & {"min_length", "regexes", "allowlist", "value"}:
            found = _special(key, node, f)
            if found is not None:
                return found
        if not node:
            raise RuleError("an empty selection")
        return reduce(and_, [selection(v, f, f"{key}.{k}" if key and not key.startswith("|") else str(k)) for k, v in node.items()])
    if isinstance(node, list):
        if not node:
            raise RuleError("an empty list")
        mods = key.split("|")[1:]
        all_, neq = "all" in mods, "neq" in mods
        if all_ and neq and key.startswith("|"):
            raise RuleError("neq cannot stand with a list of keywords that all must be found")
        # all asks for every value; neq asks that none is equal, with all that not every one is.
        return reduce(and_ if all_ != neq else or_, [selection(x, f, key) for x in node])
    if not key:
        return grep(literal(node)) if node is not None else F.lit(False)
    return leaf(key, node, f)
