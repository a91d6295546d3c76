"""JSON files cut anywhere give the objects that a whole read gives."""

from __future__ import annotations

import json

import numpy as np
import pytest

from tracelake.sources import records, split_json


def made(seed: int, n: int) -> list[dict]:
    """Objects with all that could mislead: braces, brackets, quotes and backslashes in strings, nesting, empty ones, other alphabets."""
    r = np.random.default_rng(seed)
    bits = ["}", "{", "[", "]", '"', "\\", "\\\\", '\\"', "},{", "é", "\n", " ", "ab", "}\n{", "𝄞", "/"]
    text = lambda: "".join(r.choice(bits, int(r.integers(0, 9))))

    def value(depth: int):
        k = r.integers(0, 7)
        if k == 0 and depth:
            return {text(): value(depth - 1) for _ in range(r.integers(0, 3))}
        if k == 1 and depth:
            return [value(depth - 1) for _ in range(r.integers(0, 3))]
        return (text(), int(r.integers(-9, 99)), True, None, 1.5)[r.integers(0, 5)]

    return [{"id": i, text(): value(3), "z": value(2)} for i in range(n)]


@pytest.mark.parametrize("kind", ["array", "pretty array", "lines", "one after another", "one", "marked array", "spaced end"])
def test_cut_anywhere(spark, tmp_path, kind):
    data = made(len(kind), 1 if kind == "one" else 300)
    one = [json.dumps(x, ensure_ascii=bool(i % 2)) for i, x in enumerate(data)]
    text = {
        "array": "[" + ",".join(one) + "]", "pretty array": json.dumps(data, indent=2), "lines": "\n".join(one), "one after another": "".join(one), "one": one[0],
        "marked array": "﻿[" + ", ".join(one) + "]\n", "spaced end": "\n [" + " ,\n".join(one) + " ] \n\n",
    }[kind]
    (tmp_path / "a.json").write_bytes(text.encode())
    (tmp_path / "b.json").write_bytes(text.encode())
    (tmp_path / "empty.json").write_bytes(b"")
    size = len(text.encode())
    for most in (max(64, size // 40), max(256, size // 7), 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            df = split_json.objects(spark, str(tmp_path))
            got = df.collect()
            if most < size / 5:
                assert split_json._pieces(spark, str(tmp_path), "*.json", 0).rdd.getNumPartitions() >= 5
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        for name in "ab":
            own = [json.loads(r.value) for r in got if r.source_file.endswith(f"{name}.json")]
            assert sorted(map(repr, own)) == sorted(map(repr, data))


def test_broken_ends(spark, tmp_path):
    """A file that breaks off keeps what is whole; the rest is one rejected text. Other values than objects are rejected, not lost."""
    (tmp_path / "a.json").write_text('[{"a": 1}, {"b": "x}"}, {"c": {"d": 2}')
    (tmp_path / "b.json").write_text('[{"a": 1}, 7, "s", {"b": 2}]')
    (tmp_path / "c.json").write_text('{"a": 1}{"b": "open}')
    got = sorted((r.source_file[-6:], r.value) for r in split_json.objects(spark, str(tmp_path)).collect())
    assert got == [
        ("a.json", '{"a": 1}'), ("a.json", '{"b": "x}"}'), ("a.json", '{"c": {"d": 2}'), ("b.json", '7, "s", {"b": 2}'), ("b.json", '{"a": 1}'), ("c.json", '{"a": 1}'), ("c.json", '{"b": "open}'),
    ]


def test_large_files_as_small_ones(spark, tmp_path, monkeypatch):
    rows = [{"EventID": i, "Channel": "S", "Hostname": f"h{i % 3}", "text": "}{" * (i % 4), "@timestamp": "2024-01-01T00:00:00Z"} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"result": r}) for r in rows))
    key = lambda: sorted(map(str, records.read_records(spark, str(tmp_path)).select("source_file", "event_id", "channel", "computer", "data_string").collect()))
    whole = [x for x in key() if x]
    monkeypatch.setattr(records, "WHOLE_BYTES", 100)
    assert key() == whole and len(whole) == 400
