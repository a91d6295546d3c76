"""Column functions of the engine: text, JSON fields, encodings, times, addresses. All stay in the JVM."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = " ¦ "


def truth(cond: Column) -> Column:
    """Two-valued logic: unknown is false."""
    return F.coalesce(cond, F.lit(False))


#: Unicode's white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(v: Column, use: Callable[[Column], Column]) -> Column:
    """use(v) with v evaluated once, however often and under whatever conditions or lambdas use() names it."""
    return F.get(F.transform(F.array(v), use), F.lit(0))


def trim_unicode(v: Column) -> Column:
    return F.btrim(v, F.lit(SPACE))


def collapse_spaces(v: Column) -> Column:
    """Control characters become spaces, runs of white space one space."""
    return F.btrim(F.regexp_replace(F.regexp_replace(v, r"\p{Cntrl}", " "), r"\s+", " "))


def title_first(v: Column) -> Column:
    return F.concat(F.upper(F.left(v, F.lit(1))), F.substr(v, F.lit(2)))


def html_escape(v: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def ascii_equals(v: Column, p: str) -> Column:
    """Equality without regard to ASCII case."""
    if p.isascii():
        return truth((F.octet_length(v) == len(p)) & (F.lower(v) == p.lower()))
    table = str.maketrans(UPPER, LOWER)
    return truth(F.translate(v, UPPER, LOWER) == p.translate(table))


def replace_all(v: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements one after another, the shortest keys first: a later one sees what an earlier one put in. For field names of search output."""
    for a, b in sorted(pairs, key=lambda x: (len(x[0]), x[0])):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def _replace_once(v: Column, keys: list[str], table: dict[str, str], any_case: bool = False) -> Column:
    """What the alternation of the keys finds, from the left and without overlap, through the table; nothing put in is looked at again."""
    if not keys:
        return v
    pattern = ("(?i)" if any_case else "") + "|".join(quote(k) for k in keys)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    hits = F.regexp_extract_all(v, F.lit(pattern), F.lit(0))
    new = lambda i: F.coalesce(F.try_element_at(known, F.translate(F.get(hits, i), UPPER, LOWER) if any_case else F.get(hits, i)), F.lit(""))
    # Behind the last piece there is no hit.
    return F.when(v.rlike(pattern), F.array_join(F.transform(F.split(v, pattern), lambda piece, i: F.concat(piece, new(i))), "")).otherwise(v)


def replace_stream(v: Column, pairs: list[tuple[str, str]]) -> Column:
    """All keys replaced in one pass: of the keys that occur, always the one that ends first, of those the longest; the first of equal keys counts.

    A key with another one inside that ends before it can never be the first to end. Among the rest the leftmost is.
    """
    table: dict[str, str] = {}
    for k, x in pairs:
        if k:
            table.setdefault(k, x)
    keys = [k for k in table if not any(other != k and other in k[:-1] for other in table)]
    return _replace_once(v, keys, table)


def replace_longest(v: Column, pairs: list[tuple[str, str]]) -> Column:
    """All keys replaced in one pass, whatever their ASCII case: from the left, the longest that stands there."""
    lower = str.maketrans(UPPER, LOWER)
    table: dict[str, str] = {}
    for k, x in pairs:
        if k:
            table.setdefault(k.translate(lower), x)
    return _replace_once(v, sorted(table, key=lambda k: (-len(k), k)), table, any_case=True)


def glob(pattern: str) -> str:
    """A case-insensitive whole-string regex of a * and ? pattern."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else quote(c) for c in pattern) + "\\z"


def quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&#~/" else c for c in text)


# JSON fields


def json_path(key: str) -> str:
    """A dotted path as a variant path."""
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def scalar(event: Column, path: str) -> Column:
    """A leaf as trimmed text; arrays, objects and null are absent."""
    text = F.try_variant_get(event, json_path(path), "string")
    # As texts, arrays and objects begin like this; the type is asked of these few alone.
    plain = ~(text.startswith("{") | text.startswith("["))
    simple = ~F.schema_of_variant(F.try_variant_get(event, json_path(path), "variant")).rlike("^(ARRAY|OBJECT|VOID)")
    return F.when(plain, trim_unicode(text)).when(simple, trim_unicode(text))


def array_of(event: Column, path: str) -> Column:
    """An array's elements as text; null where the path has no array."""
    return F.try_variant_get(event, json_path(path), "array<string>")


def typed_scalar(v: Column) -> Column:
    """JSON text of a value: whole numbers and booleans bare, all else a string."""
    whole = v.rlike(r"^-?(0|[1-9][0-9]{0,18})\z") & v.try_cast("bigint").isNotNull()
    return F.when(whole | v.isin("true", "false"), v).otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))


# Numbers


def unsigned(v: Column) -> Column:
    """Whole numbers from 0 to 2**64 - 1, else null."""
    n = F.when(v.rlike(r"^\+?[0-9]{1,20}\z"), v.try_cast("decimal(20,0)"))
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(20,0)"), n)


def hex_to_decimal(v: Column) -> Column:
    return F.when(v.rlike(r"^0[xX][0-9a-fA-F]{1,16}\z"), F.conv(F.substr(v, F.lit(3)), 16, 10)).otherwise(v)


def percent_f32(part: Column, whole: Column) -> Column:
    """Tenths of a percent, halves away from zero."""
    return F.round(part / whole * 1000) / 10


# Times


def parse_time(v: Column) -> Column:
    """RFC 3339, or with a separated offset; null if neither."""
    return F.coalesce(F.try_to_timestamp(v), F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS XXX")), F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm:ss XXX")))


def nanoseconds(v: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text: the timestamp's seconds and all digits behind them."""
    digits = F.rpad(F.regexp_extract(v, r"\.(\d{1,9})", 1), 9, "0")
    return F.unix_seconds(parse_time(v)) * 1_000_000_000 + digits.cast("bigint")


TIME_STYLES = {
    "default": "yyyy-MM-dd HH:mm:ss.SSS xxx",
    "European": "dd-MM-yyyy HH:mm:ss.SSS xxx",
    "ISO-8601": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "RFC-2822": "EEE, d MMM yyyy HH:mm:ss xx",
    "RFC-3339": "yyyy-MM-dd HH:mm:ss.SSSSSSxxx",
    "US": "MM-dd-yyyy hh:mm:ss.SSS a xxx",
    "US military": "MM-dd-yyyy HH:mm:ss.SSS xxx",
}


def format_time(ts: Column, style: str = "default") -> Column:
    return F.date_format(ts, TIME_STYLES[style])


def duration(seconds: Column) -> Column:
    """hh:mm:ss, hours unbounded."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


def uptime(seconds: Column) -> Column:
    """Years of 365 days, months of 30, days, hours, minutes and seconds. Days are those that whole months leave of all seconds, as the format has it, whatever the years."""
    units = ((None, 31_536_000, "Y"), (31_536_000, 2_592_000, "M"), (2_592_000, 86_400, "d"), (86_400, 3_600, "h"), (3_600, 60, "m"), (60, 1, "s"))
    part = lambda within, size: F.floor((seconds % within if within else seconds) / size)
    return F.concat_ws(" ", *[F.concat(part(within, size).cast("string"), F.lit(name)) for within, size, name in units])


def size_text(bytes_: Column) -> Column:
    """Bytes below 1,024 as they are, above with one decimal in units of 1,024."""
    out = F.concat(bytes_.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(bytes_ >= 1024**power, F.format_string(f"%.1f {unit}", bytes_ / float(1024**power))).otherwise(out)
    return out


# Addresses


def ipv4(v: Column) -> Column:
    """The number of an IPv4 address, else null."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    part = lambda p, i: F.get(p, F.lit(i)).try_cast("bigint")
    number = let(F.split(v, r"\."), lambda p: ((part(p, 0) * 256 + part(p, 1)) * 256 + part(p, 2)) * 256 + part(p, 3))
    return F.when(v.rlike("^" + r"\.".join([octet] * 4) + r"\z"), number)


def _within(four: Column, six: Column, network: str) -> Column:
    """Whether an address, as ipv4() and ipv6_hex() have it, is in the network."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        return truth(four.between(int(net.network_address), int(net.broadcast_address)))
    return truth(six.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"))


def in_cidr(v: Column, network: str) -> Column:
    """Whether v is an address in the network; false if either cannot be read."""
    try:
        net = ipaddress.ip_network(network, strict=False)
    except ValueError:
        return F.lit(False)
    return let(ipv4(v) if net.version == 4 else ipv6_hex(v), lambda x: _within(x, x, network))


def ipv6_hex(v: Column) -> Column:
    """An IPv6 address as 32 hex digits: groups padded, :: filled with zero groups; else null."""
    full = r"^[0-9a-f]{1,4}(:[0-9a-f]{1,4})*\z"
    low = F.lower(v)
    groups = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))

    def filled(left: Column, right: Column) -> Column:
        missing = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
        return let(F.concat(left, F.array_repeat(F.lit("0"), missing), right), lambda all_: F.when(F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}\\z")) & (F.size(all_) == 8), F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), "")))

    def joined(halves: Column) -> Column:
        sides = F.struct(groups(F.get(halves, F.lit(0))).alias("left"), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>")).alias("right"))
        return let(sides, lambda x: filled(x["left"], x["right"]))

    return F.when(v.contains(":") & (low.contains("::") | low.rlike(full)), let(F.split(low, "::", 2), joined))


def plain_address(v: Column) -> Column:
    """IPv4-mapped addresses as IPv4; a dotted tail of other IPv6 addresses as two groups."""
    v = F.regexp_replace(v, "^::(?i:ffff):", "")
    tail = F.lpad(F.hex(ipv4(F.regexp_extract(v, r"^.*:([0-9.]+)\z", 1))), 8, "0")
    return F.coalesce(F.concat(F.regexp_replace(v, r"[0-9.]+\z", ""), F.left(tail, F.lit(4)), F.lit(":"), F.right(tail, F.lit(4))), v)


def private_kind(v: Column) -> Column:
    """'Local' for loopback, 0.0.0.0 and LOCAL, 'Private' for private, link-local, multicast and unspecified addresses, else null."""
    private = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "::/128", "fe80::/10", "fc00::/7", "ff00::/8")
    some = lambda x, networks: reduce(or_, [_within(x["four"], x["six"], n) for n in networks])
    kind = lambda x: F.when(some(x, ("127.0.0.0/8", "::1/128")) | v.isin("0.0.0.0", "LOCAL", "ローカル"), "Local").when(some(x, private), "Private")
    return let(F.struct(ipv4(v).alias("four"), ipv6_hex(v).alias("six")), kind)
