"""The smallest of nested ranges, by networks of every length, against a plain search."""

from __future__ import annotations

import ipaddress

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.operators import render

TAIL = "asn string, country string, city string"


@pytest.mark.parametrize("small", [500_000, 0])
def test_nested_ranges(spark, monkeypatch, small):
    monkeypatch.setattr(render, "PREFIX_ROWS", small)
    r = np.random.default_rng(3)
    ranges = [(0, 0xFFFFFFFF, "all", "c0", "t0"), (0x08000000, 0x08FFFFFF, "eight", "c1", "t1")]
    for k in range(300):  # one busy octet
        first = 0x08000000 + int(r.integers(0, 1 << 24))
        ranges.append((first, min(first + int(r.integers(0, 1 << int(r.integers(1, 20)))), 0xFFFFFFFF), f"a{k}", f"c{k}", None if k % 9 == 0 else f"t{k}"))
    ranges = list({x[1] - x[0]: x for x in ranges}.values())  # of different sizes, so that one is the smallest
    six = [("2a00::", "2aff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "six", "s", "u"), ("2a01:5::1", "2a01:5::ff:3", "inner", "i", "v"), ("2a01:5::7", "2a01:5::7", "one", "o", "w")]
    ips = [str(ipaddress.ip_address(0x08000000 + int(x))) for x in r.integers(0, 1 << 24, 2_000)] + ["1.2.3.4", "2a01:5::7", "2a01:5::8", "2a01:6::", "2b00::", "::ffff:8.0.0.1", "no", None]
    rows = spark.createDataFrame([(x,) for x in ips], "ip string").repartition(4)
    out = render.places(rows, "ip", spark.createDataFrame(ranges, f"first long, last long, {TAIL}"), "src", spark.createDataFrame(six, f"first string, last string, {TAIL}"))
    every = [(x[0], x[1], 4, x[2:]) for x in ranges] + [(int(ipaddress.ip_address(x[0])), int(ipaddress.ip_address(x[1])), 6, x[2:]) for x in six]

    def plain(ip):
        try:
            a = ipaddress.ip_address((ip or "").removeprefix("::ffff:"))
        except ValueError:
            return None if ip is None else ("-", "-", "-")
        hit = min((last - first, found) for first, last, version, found in every if version == a.version and first <= int(a) <= last) if any(v == a.version and f <= int(a) <= t for f, t, v, _ in every) else None
        return tuple(x or "-" for x in hit[1]) if hit else ("-", "-", "-")

    got = out.collect()
    assert len(got) == len(ips)
    for x in got:
        assert ((x.src_asn, x.src_country, x.src_city) if x.ip is not None else None) == plain(x.ip), x.ip


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def address(n):
        made.add(1)
        return f"8.1.0.{n % 4}"

    rows = spark.range(40).select("id", address("id").alias("ip"))
    ranges = spark.createDataFrame([(0x08010000, 0x0801FFFF, "AS1", "X", "a")], "first long, last long, asn string, country string, city string")
    assert {tuple(r) for r in render.places(rows, "ip", ranges, "src").select("src_asn", "src_city").collect()} == {("AS1", "a")}
    assert made.value == 40


def test_private_kinds(spark):
    texts = {"127.0.0.1": "Local", "::1": "Local", "LOCAL": "Local", "10.0.0.256": None, "172.31.0.1": "Private", "172.32.0.1": None, "fe80::1": "Private", "::": "Private", "1::2::3": None, "8.8.8.8": None, "FD00:0:0:0:0:0:0:1": "Private", "": None}
    rows = spark.createDataFrame([(k,) for k in texts], "ip string")
    assert {r.ip: r.kind for r in rows.select("ip", C.private_kind(F.col("ip")).alias("kind")).collect()} == texts
