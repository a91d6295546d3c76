"""Which hashes occur twice and how often: tables by hash range, and lookups of bounded size made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

#: The filter never has more bits: 64 MB. A fuller filter only lets more through.
FILTER_BITS = 1 << 29
#: Levels take 64 MB at most, too.
LEVEL_SLOTS = 1 << 27
BLOBS = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
BLOBS_SQL = "bucket int, payload binary"
_KEY = np.dtype([("k", "<u4"), ("t", "?")])
_LOW = B.U64(0xFFFFFFFF)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range of each hash."""
    return (((h >> B.U64(32)) * B.U64(buckets)) >> B.U64(32)).astype(np.int64)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal rows."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, np.concatenate([at[1:], [n]])


def blobs(bucket: np.ndarray, values: np.ndarray, pack: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> pa.RecordBatch:
    """A row for each bucket; values must be in bucket order."""
    at, ends = runs(bucket)
    return pa.record_batch([pa.array(bucket[at].astype(np.int32), pa.int32()), pa.array([pack(values[a:b]) for a, b in zip(at, ends)], pa.binary())], schema=BLOBS)


def planes(values: np.ndarray) -> bytes:
    """Records as their first bytes, then their second ones and so on: places that hardly vary compress to nothing in a shuffle."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    """The records of all rows of planes."""
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint8).reshape(dtype.itemsize, -1).T for x in column]
    return np.ascontiguousarray(np.concatenate(parts)).view(dtype).ravel()


def key_blobs(h: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each hash of a piece once, and whether it has two owners there."""
    if len(h):
        key = (bucket_of(h, buckets).astype(np.uint64) << B.U64(32)) | (h & _LOW)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        at, _ = runs(key)
        twice = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
        key = key[at]
        yield blobs((key >> B.U64(32)).astype(np.int64), np.rec.fromarrays([(key & _LOW).astype(np.uint32), twice], dtype=_KEY))


def find_twice(group: pa.Table) -> pa.Table:
    """The hashes of a range that occur in two pieces, or twice in one."""
    got = np.concatenate([np.frombuffer(x.as_buffer(), dtype=_KEY) for x in group.column("payload")])
    key = np.sort(got["k"])
    again = np.unique(np.concatenate([key[1:][key[1:] == key[:-1]], got["k"][got["t"]]]))
    return pa.table({"bucket": group.column("bucket")[:1], "payload": [again.tobytes()]}, schema=BLOBS)


def _slot(low: np.ndarray, size: int) -> np.ndarray:
    return ((low.astype(np.uint64) * B.U64(size)) >> B.U64(32)).astype(np.int64)


def _bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("payload"):
                bits = np.zeros(size, dtype=bool)
                bits[_slot(np.frombuffer(x.as_buffer(), dtype="<u4"), size)] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.record_batch([batch.column("bucket"), pa.array(out, pa.binary())], schema=BLOBS)

    return run


class Filter:
    """Membership of hashes, with false positives; its bits are broadcast."""

    def __init__(self, twice: DataFrame, buckets: int):
        """twice: materialized rows of bucket and the low halves of its hashes, one row a bucket at most."""
        total = twice.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
        self.buckets, self.size = buckets, 8 * max(1, min(FILTER_BITS, 4 * total) // (8 * buckets))
        bits = np.zeros(buckets * self.size // 8, dtype=np.uint8)
        for r in twice.mapInArrow(_bits(self.size), BLOBS_SQL).toLocalIterator():
            bits[r["bucket"] * self.size // 8 : (r["bucket"] + 1) * self.size // 8] = np.frombuffer(r["payload"], dtype=np.uint8)
        self.bits = twice.sparkSession.sparkContext.broadcast(bits)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = bucket_of(h, self.buckets) * self.size + _slot(h & _LOW, self.size)
        return (self.bits.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def count_blobs(h: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each hash of a piece once with its count there: by range the low halves in order as differences, by byte planes (the high ones are
    nearly all zero and so cost little), then the counts above one."""
    if len(h):
        key = np.sort((bucket_of(h, buckets).astype(np.uint64) << B.U64(32)) | (h & _LOW))
        at, ends = runs(key)
        key, count = key[at], (ends - at).astype("<u4")
        bucket = (key >> B.U64(32)).astype(np.int64)
        at, ends = runs(bucket)
        out = []
        for a, b in zip(at, ends):
            low = (key[a:b] & _LOW).astype("<u4")
            gaps = np.diff(low, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
            many = np.flatnonzero(count[a:b] > 1).astype("<u4")
            out.append(np.array([b - a, len(many)], dtype="<i8").tobytes() + gaps.T.tobytes() + many.tobytes() + count[a:b][many].tobytes())
        yield pa.record_batch([pa.array(bucket[at].astype(np.int32), pa.int32()), pa.array(out, pa.binary())], schema=BLOBS)


_COUNT = np.dtype([("k", "<u4"), ("c", "<u4")])


def find_counts(group: pa.Table) -> pa.Table:
    """The hashes of a range that occur twice or more, with their counts."""
    keys, counts = [], []
    for x in group.column("payload"):
        raw = x.as_buffer()
        n, m = np.frombuffer(raw, dtype="<i8", count=2)
        gaps = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=4 * n, offset=16).reshape(4, n).T).view("<u4").ravel()
        own = np.ones(n, dtype=np.uint32)
        own[np.frombuffer(raw, dtype="<u4", count=m, offset=16 + 4 * n)] = np.frombuffer(raw, dtype="<u4", count=m, offset=16 + 4 * n + 4 * m)
        keys.append(np.cumsum(gaps, dtype=np.uint32))
        counts.append(own)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at, _ = runs(key)
    count = np.add.reduceat(count, at, dtype=np.int64)
    many = count > 1
    out = np.empty(int(many.sum()), dtype=_COUNT)
    out["k"], out["c"] = key[at][many], np.minimum(count[many], (1 << 32) - 1)
    return pa.table({"bucket": group.column("bucket")[:1], "payload": [out.tobytes()]}, schema=BLOBS)


def _levels(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("payload"):
                got = np.frombuffer(x.as_buffer(), dtype=_COUNT)
                table = np.zeros(size, dtype=np.uint8)
                np.maximum.at(table, _slot(got["k"], size), np.minimum(np.log2(got["c"]), 15).astype(np.uint8))
                out.append((table[::2] | (table[1::2] << 4)).tobytes())
            yield pa.record_batch([batch.column("bucket"), pa.array(out, pa.binary())], schema=BLOBS)

    return run


class Levels:
    """The magnitude of hashes' counts: 0 for one, else the logarithm to base 2, up to 15. A broadcast table of at most LEVEL_SLOTS
    half bytes; hashes that share a slot have the higher one's level."""

    def __init__(self, counts: DataFrame, buckets: int):
        """counts: materialized rows of bucket, hashes' low halves and counts."""
        total = (counts.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) // _COUNT.itemsize
        self.buckets, self.size = buckets, 2 * max(1, min(LEVEL_SLOTS, 16 * total) // (2 * buckets))
        table = np.zeros(buckets * self.size // 2, dtype=np.uint8)
        for r in counts.mapInArrow(_levels(self.size), BLOBS_SQL).toLocalIterator():
            table[r["bucket"] * self.size // 2 : (r["bucket"] + 1) * self.size // 2] = np.frombuffer(r["payload"], dtype=np.uint8)
        self.table = counts.sparkSession.sparkContext.broadcast(table)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = bucket_of(h, self.buckets) * self.size + _slot(h & _LOW, self.size)
        return (self.table.value[slot >> 1] >> ((slot & 1) << 2).astype(np.uint8)) & 15
