"""Suffix-array dedup over a logarithmic family of indexes.

Every byte that a 400-byte string covers goes if the same string starts anywhere else too. Bytes that a string of REPORT bytes covers
are counted beside, so shared passages too short to be cut are told as well.

1. Suffixes are sampled by content: of the GRAM-byte grams in a window of REPORT bytes the one with the least hash is the window's anchor, so
   equal windows have their anchor at the same place. An anchor stands for the run of windows that have it, and carries their bytes.
2. Anchors' grams are counted by hash range. In a closed corpus (suffix_dedup) those of a gram that nothing else has are not sent;
   an index to be extended (add) holds all.
3. Each hash range of grams has a family of suffix arrays. A new batch's suffixes are sorted by gram, following bytes and their length, merged with
   the arrays of all levels, and the common prefixes of neighbours (and, in the order of the bytes before, the common suffixes) say which windows
   are equal: two windows are, if neighbours from one to the other never share less than the window needs on either side. Both sides of a match with
   a new suffix are marked. Then the batch becomes a level; while two levels have equal size they merge into one of twice the size. A kept index has a
   table for each level: all are read, but only the merged one is written, so a suffix is written a logarithmic number of times.
4. A gram with more than HOT contexts (a line in a third of all documents) would gather in one range: its windows are sent by
   their own hashes instead, which spreads them, and equal ones are found by 96 bits.
5. Marked spans join back to the texts.

Inside a piece of about 1 MB of text, equal contexts are settled at once (by hashes of 96 bits and the gram's) and sent as one entry, so
a passage in a third of all documents costs one entry a piece. Defined results: null is empty; matches never cross texts; repeated rows are texts of their own
and so remove each other wholly from 400 bytes on; texts below 400 bytes lose nothing; an empty table gives an empty result.
What is kept may be no valid UTF-8, so it is bytes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import drop_scratch, materialize, materialize_parts, ship_package, table
from .repeats import BLOBS_SQL, Levels, blobs, bucket_of, count_blobs, find_counts, runs

MATCH = 400
REPORT = 256
GRAM = 128
BATCHES = 4
#: Bytes of text whose suffixes meet in one hash range.
RANGE_BYTES = 2 << 20
#: Bytes of text that are taken together; windows of a longer text are taken by segments.
SEGMENT = 1 << 20
#: A gram of 2**HOT_LEVEL contexts is matched by its windows' hashes.
HOT_LEVEL = 14
#: Suffixes whose windows are named together, and places of their grams that are taken at a time.
GROUP = 4_096
PLACES = 16
_PLACE = 24
NO_ID = np.iinfo(np.int64).max
LEFT, RIGHT = REPORT - GRAM, MATCH - GRAM

_CONTEXT = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("c2", "<u4"), ("tag", "<u4"), ("id", "<i8"), ("lo", "<u4"), ("left", "<u4"), ("n", "<u4"), ("size", "<u4")])
_SUFFIX = np.dtype([("key", "<u8"), ("id", "<i8"), ("tag", "<u4"), ("lo", "<u4"), ("left", "<u2"), ("n", "<u2"), ("size", "<u2"), ("fresh", "<u2")])
_WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u4"), ("tag", "<u4"), ("id", "<i8"), ("start", "<u4"), ("width", "<u2"), ("fresh", "<u2")])
_SPAN = np.dtype([("id", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4"), ("width", "<u4")])
#: A suffix a row, its bytes on both sides of the gram in `bytes`; rows that are not suffixes have their values there.
_ENTRIES = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("lo", pa.int64()), ("left", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("bytes", pa.binary())])
_ENTRIES_SQL = "bucket int, batch int, key bigint, id bigint, tag bigint, lo bigint, left int, n int, size int, bytes binary"
#: Spans of documents, or (bucket not null) the arrays of a level.
_FOUND = pa.schema([("_id", pa.int64()), ("_tag", pa.int64()), ("_width", pa.int32()), ("_spans", pa.binary()), ("bucket", pa.int32()), ("size", pa.int32()), ("payload", pa.binary())])
_FOUND_SQL = "_id bigint, _tag bigint, _width int, _spans binary, bucket int, size int, payload binary"
_LEVELS_SQL = "bucket int, size int, payload binary"


def _segments(batch: pa.RecordBatch) -> Iterator[tuple]:
    """ids, tags, bytes, offsets, window starts of each text and the place of the first byte in its text; long texts in overlapping segments."""
    data, offsets = B.strings(batch.column("text"))
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.uint32)
    for i, j in B.pieces(offsets, SEGMENT):
        own = offsets[i : j + 1]
        if j - i == 1 and own[1] - own[0] > 2 * SEGMENT:
            for a in range(own[0], own[1] - REPORT + 1, SEGMENT):
                part = data[a : min(a + SEGMENT + MATCH - 1, own[1])]
                yield ids[i:j], tags[i:j], part, np.array([0, len(part)]), np.array([min(SEGMENT, len(part) - REPORT + 1)]), a - own[0]
        else:
            yield ids[i:j], tags[i:j], data[own[0] : own[-1]], own - own[0], np.maximum(0, np.diff(own) - REPORT + 1), 0


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of width values, by running minima from block ends."""
    n = len(x) - width + 1
    y = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    up = np.minimum.accumulate(y, axis=1).ravel()
    down = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def _anchors(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: gram hash, its place, first window, number of windows, text."""
    none = np.zeros(0, dtype=np.int64)
    long_ = np.flatnonzero(starts > 0)
    if not len(long_):
        return none.astype(np.uint64), none, none, none, none
    grams = B.FIRST.windows(B.FIRST.table[data], GRAM)
    places = np.arange(len(grams), dtype=np.uint64)
    low = _least((grams >> B.U64(_PLACE) << B.U64(_PLACE)) | places, REPORT - GRAM + 1)
    s = B.ragged(offsets[long_], starts[long_])
    text = np.repeat(long_, starts[long_])
    place = (low[s] & B.U64((1 << _PLACE) - 1)).astype(np.int64)
    at, ends = runs(place, text)
    # The least hashes crowd at the low end of the range; mixed, they fill it evenly.
    return B.mix(grams[place[at]]), place[at], s[at], ends - at, text[at]


def _contexts(batch: pa.RecordBatch, counts: Levels | None = None) -> Iterator[tuple]:
    """The anchors (with counts, those that stand twice) in the order of key and context; their first windows in the piece, and its bytes."""
    for ids, tags, data, offsets, starts, base in _segments(batch):
        key, place, lo, n, text = _anchors(data, offsets, starts)
        if counts is not None and len(key):
            good = counts(key) > 0
            key, place, lo, n, text = key[good], place[good], lo[good], n[good], text[good]
        if not len(key):
            continue
        e = np.empty(len(key), dtype=_CONTEXT)
        ends = np.minimum(lo + n - 1 + MATCH, offsets[text + 1])
        split = B.mix((place - lo).astype(np.uint64) << B.U64(32) | n.astype(np.uint64))
        e["ctx"] = B.FIRST.spans(B.FIRST.sums(B.FIRST.table[data]), lo, ends) ^ split
        e["c2"] = (B.SECOND.spans(B.SECOND.sums(B.SECOND.table[data]), lo, ends) >> B.U64(32)).astype(np.uint32)
        e["key"], e["id"], e["tag"], e["n"], e["left"], e["size"] = key, ids[text], tags[text], n, place - lo, ends - lo
        e["lo"] = lo - offsets[text] + base
        order = np.lexsort((e["c2"], e["ctx"], e["key"]))
        yield e[order], lo[order], data


def _send_counts(buckets: int):
    """Of each gram of a piece the number of its contexts, two at least where it stands twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e, *_ in _contexts(batch):
                at, ends = runs(e["key"])
                kinds = np.add.reduceat(np.concatenate([[True], (e["ctx"][1:] != e["ctx"][:-1]) | (e["c2"][1:] != e["c2"][:-1]) | (e["key"][1:] != e["key"][:-1])]), at, dtype=np.int64)
                yield from count_blobs(np.repeat(e["key"][at], np.maximum(kinds, np.minimum(ends - at, 2))), buckets)

    return run


def _whole(e: np.ndarray) -> np.ndarray:
    """The spans of all windows of the entries."""
    start, n = e["lo"].astype(np.int64), e["n"].astype(np.int64)
    long_ = np.minimum(n, e["size"].astype(np.int64) - MATCH + 1)
    some = long_ > 0
    return np.concatenate([_span_rows(e, start, start + n - 1 + REPORT, REPORT), _span_rows(e[some], start[some], start[some] + long_[some] - 1 + MATCH, MATCH)])


def _span_rows(e: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    out = np.empty(len(e), dtype=_SPAN)
    out["id"], out["tag"], out["start"], out["end"], out["width"] = e["id"], e["tag"], start, end, width
    return out


def _send(buckets: int, batches_: int, counts: Levels | None, hot: Levels):
    """A piece's entries by batch and bucket: spans that are settled inside it (negative buckets), suffixes with their bytes, one of each
    context (buckets from 0), and windows of hot grams, one of each kind (from `buckets` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e, lo, data in _contexts(batch, counts):
                at, ends = runs(e["key"], e["ctx"], e["c2"])
                settled = [_whole(e[np.repeat(ends - at > 1, ends - at)])]
                e, lo = e[at], lo[at]
                many = hot(e["key"]) >= HOT_LEVEL
                windows = _windows(e[many], lo[many], data)
                at, ends = runs(windows["w1"], windows["w2"], windows["width"])
                again = windows[np.repeat(ends - at > 1, ends - at)]
                settled.append(np.concatenate([_span_rows(again[again["width"] == w], again["start"][again["width"] == w], again["start"][again["width"] == w].astype(np.int64) + w, w) for w in (REPORT, MATCH)]))
                spans = np.concatenate(settled)
                yield _sorted_blobs(-1 - (spans["id"].astype(np.uint64) % B.U64(buckets)).astype(np.int64), spans)
                windows = windows[at]
                yield _sorted_blobs(buckets + bucket_of(windows["w1"], buckets), windows)
                yield _suffix_rows(e[~many], lo[~many], data, buckets, batches_)

    return run


def _sorted_blobs(bucket: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    out = blobs(bucket[order], values[order])
    return pa.record_batch([out.column(0), *[pa.nulls(out.num_rows, f.type) for f in list(_ENTRIES)[1:-1]], out.column(1)], schema=_ENTRIES)


def _windows(e: np.ndarray, lo: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The windows of both widths of the entries, in the order of their hashes."""
    out = []
    for width in (REPORT, MATCH):
        n = np.clip(e["size"].astype(np.int64) - width + 1, 0, e["n"])
        s, entry = B.ragged(lo, n), np.repeat(np.arange(len(e)), n)
        w = np.empty(len(s), dtype=_WINDOW)
        if len(s):
            w["w1"] = B.FIRST.windows(B.FIRST.table[data], width)[s]
            w["w2"] = (B.SECOND.windows(B.SECOND.table[data], width)[s] >> B.U64(32)).astype(np.uint32)
        w["id"], w["tag"], w["start"], w["width"], w["fresh"] = e["id"][entry], e["tag"][entry], s - lo[entry] + e["lo"][entry], width, 1
        out.append(w)
    w = np.concatenate(out)
    return w[np.lexsort((w["width"], w["w2"], w["w1"]))]


def _suffix_rows(e: np.ndarray, lo: np.ndarray, data: np.ndarray, buckets: int, batches_: int) -> pa.RecordBatch:
    which = (B.mix(e["id"].astype(np.uint64)) % B.U64(batches_)).astype(np.int32)
    left, right = e["left"].astype(np.int64), e["size"].astype(np.int64) - e["left"] - GRAM
    # Both sides of the gram, which all suffixes of a key have in common.
    text = data[B.ragged(np.stack([lo, lo + left + GRAM], axis=1).ravel(), np.stack([left, right], axis=1).ravel())]
    ends = np.concatenate([[0], np.cumsum(left + right)]).astype(np.int32)
    held = pa.Array.from_buffers(pa.binary(), len(e), [None, pa.py_buffer(ends), pa.py_buffer(text)])
    values = [bucket_of(e["key"], buckets).astype(np.int32), which, e["key"].view(np.int64), e["id"], e["tag"].astype(np.int64), e["lo"].astype(np.int64), *[e[c].astype(np.int32) for c in ("left", "n", "size")]]
    return pa.record_batch([*[pa.array(x) for x in values], held], schema=_ENTRIES)


def _pack(e: np.ndarray, text: np.ndarray) -> bytes:
    return np.array([len(e)], dtype="<i8").tobytes() + e.tobytes() + text.tobytes()


@dataclass
class SuffixArray:
    """Suffixes in the order of gram, bytes after it and their number; `after` and `before` are the sort strings, zero-padded and ended by the length."""

    e: np.ndarray
    after: np.ndarray
    before: np.ndarray

    @classmethod
    def read(cls, payload: pa.Scalar) -> SuffixArray:
        """A stored level, which is in order."""
        raw = payload.as_buffer()
        n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
        return cls._of(np.frombuffer(raw, dtype=_SUFFIX, count=n, offset=8), np.frombuffer(raw, dtype=np.uint8, offset=8 + n * _SUFFIX.itemsize))

    @classmethod
    def of_rows(cls, rows: pa.Table) -> SuffixArray:
        """The suffix array of a batch."""
        e = np.empty(rows.num_rows, dtype=_SUFFIX)
        for c in ("key", "id", "tag", "lo", "left", "n", "size"):
            x = rows.column(c).to_numpy()
            e[c] = x.view(np.uint64) if c == "key" else x
        e["fresh"] = 1
        return cls.merged([cls._of(e, B.strings(rows.column("bytes"))[0])])

    @classmethod
    def _of(cls, e: np.ndarray, text: np.ndarray) -> SuffixArray:
        left, right = e["left"].astype(np.int64), e["size"].astype(np.int64) - e["left"] - GRAM
        start = np.cumsum(left + right) - left - right
        text = np.concatenate([text, np.zeros(1, dtype=np.uint8)])

        def strings(at: np.ndarray, step: int, length: np.ndarray, width: int) -> np.ndarray:
            columns = np.arange(width)
            inside = columns < length[:, None]
            return np.where(inside, text[np.where(inside, at[:, None] + step * columns, 0)], 0).astype(np.uint8)

        key = e["key"].astype(">u8").view(np.uint8).reshape(-1, 8)
        size = lambda x: x.astype(">u2").view(np.uint8).reshape(-1, 2)
        after = np.concatenate([key, strings(start + left, 1, right, RIGHT), size(right)], axis=1)
        before = np.concatenate([key, strings(start + left - 1, -1, left, LEFT), size(left)], axis=1)
        return cls(e, after, before)

    @classmethod
    def merged(cls, parts: list[SuffixArray]) -> SuffixArray:
        """One array of several; the stable sort merges runs that are in order already."""
        e, after, before = (np.concatenate([getattr(p, c) for p in parts]) for c in ("e", "after", "before"))
        order = np.argsort(_as_strings(after), kind="stable")
        return cls(e[order], after[order], before[order])

    def take(self, which: np.ndarray) -> SuffixArray:
        return SuffixArray(self.e[which], self.after[which], self.before[which])

    def payload(self) -> bytes:
        """As it is stored and sent: entries and their bytes on both sides of the gram."""
        left, right = self.e["left"].astype(np.int64), self.e["size"].astype(np.int64) - self.e["left"] - GRAM
        rows = np.concatenate([self.before[:, 8 : 8 + LEFT][:, ::-1], self.after[:, 8 : 8 + RIGHT]], axis=1)
        columns = np.arange(LEFT + RIGHT)
        return _pack(self.e, rows[(columns >= LEFT - left[:, None]) & (columns < LEFT + right[:, None])])


def _as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _common(rows: np.ndarray) -> np.ndarray:
    """Bytes that each string shares with the one before it after the key: -1 for another key (and the first), no more than either has."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    differ = rows[1:, :-2] != rows[:-1, :-2]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1]) - 8
    length = rows[:, -2].astype(np.int64) * 256 + rows[:, -1]
    return np.concatenate([[-1], np.where(first < 0, -1, np.minimum(first, np.minimum(length[1:], length[:-1])))])


def _scan(pool: SuffixArray) -> np.ndarray:
    """Spans of the windows that a fresh suffix and another have, or an old one and a fresh one."""
    e = pool.e
    # Grams that several suffixes have, a fresh one among them.
    at, ends = runs(e["key"])
    if not len(at):
        return np.zeros(0, dtype=_SPAN)
    good = (ends - at > 1) & (np.maximum.reduceat(e["fresh"], at) > 0)
    x = pool.take(np.flatnonzero(np.repeat(good, ends - at)))
    if not len(x.e):
        return np.zeros(0, dtype=_SPAN)
    # Whole contexts that are equal: all their windows are.
    after = np.cumsum(np.concatenate([[True], (x.after[1:] != x.after[:-1]).any(axis=1)]))
    by = np.argsort(_as_strings(x.before), kind="stable")
    before = np.empty(len(by), dtype=np.int64)
    before[by] = np.cumsum(np.concatenate([[True], (x.before[by][1:] != x.before[by][:-1]).any(axis=1)]))
    same = np.lexsort((x.e["n"], before, after))
    at, ends = runs(after[same], before[same], x.e["n"][same])
    fresh = np.maximum.reduceat(x.e["fresh"][same], at)
    equal = np.repeat((ends - at > 1) & (fresh > 0), ends - at)
    found = [_whole(x.e[same[equal]])]
    # One suffix of each context, of grams that have several.
    one = x.take(same[at])
    one.e = one.e.copy()
    one.e["fresh"] = fresh
    at, ends = runs(one.e["key"])
    one = one.take(np.flatnonzero(np.repeat((ends - at > 1) & (np.maximum.reduceat(one.e["fresh"], at) > 0), ends - at)))
    at, ends = runs(one.e["key"])
    i = 0
    while i < len(at):  # whole grams, as many as are named together
        j = max(i + 1, int(np.searchsorted(ends, at[i] + GROUP, side="right")))
        found.append(_equal_windows(one.take(np.arange(at[i], ends[j - 1]))))
        i = j
    return np.concatenate(found)


def _equal_windows(x: SuffixArray) -> np.ndarray:
    """Spans of equal windows. A window k bytes before its gram needs k common bytes before it and the rest after it: its name is the stretches of
    neighbours, in both orders, that share so much."""
    n = len(x.e)
    after, by = _common(x.after), np.argsort(_as_strings(x.before), kind="stable")
    before, k = _common(x.before[by]), np.arange(LEFT + 1)
    names_before = np.empty((LEFT + 1, n), dtype=np.int64)
    names_before[:, by] = np.cumsum(before < k[:, None], axis=1)
    found = []
    for width in (REPORT, MATCH):
        names_after = np.cumsum(after < (width - GRAM - k)[:, None], axis=1)
        many = np.clip(x.e["size"].astype(np.int64) - width + 1, 0, x.e["n"])
        most = x.e["left"].astype(np.int64)  # bytes before the gram of the first window; the last has many - 1 less
        hits = [np.zeros((2, 0), dtype=np.int64)]
        for low in range(0, LEFT + 1, PLACES):
            begin, end = np.maximum(low, most - many + 1), np.minimum(low + PLACES, most + 1)
            count = np.maximum(0, end - begin)
            entry, split = np.repeat(np.arange(n), count), B.ragged(begin, count)
            name = (split * (n + 1) + names_before[split, entry]) * (n + 1) + names_after[split, entry]
            order = np.argsort(name, kind="stable")
            at, ends = runs(name[order])
            if len(at):
                matched = (ends - at > 1) & (np.maximum.reduceat(x.e["fresh"][entry][order], at) > 0)
                hit = order[np.repeat(matched, ends - at)]
                hits.append(np.stack([entry[hit], most[entry[hit]] - split[hit]]))
        entry, offset = np.concatenate(hits, axis=1)
        if not len(entry):
            continue
        order = np.lexsort((offset, entry))
        entry, offset = entry[order], offset[order]
        # Neighbouring windows of one suffix are one span.
        f = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (offset[1:] != offset[:-1] + 1)]))
        last = np.concatenate([f[1:] - 1, [len(entry) - 1]])
        own = x.e[entry[f]]
        found.append(_span_rows(own, own["lo"] + offset[f], own["lo"] + offset[last] + width, width))
    return np.concatenate(found) if found else np.zeros(0, dtype=_SPAN)


def _equal_hashes(w: np.ndarray) -> np.ndarray:
    """Spans of hot grams' windows that stand twice, a fresh one among them."""
    w = w[np.lexsort((w["width"], w["w2"], w["w1"]))]
    at, ends = runs(w["w1"], w["w2"], w["width"])
    if not len(at):
        return np.zeros(0, dtype=_SPAN)
    w = w[np.repeat((ends - at > 1) & (np.maximum.reduceat(w["fresh"], at) > 0), ends - at)]
    return np.concatenate([_span_rows(w[w["width"] == k], w["start"][w["width"] == k], w["start"][w["width"] == k].astype(np.int64) + k, k) for k in (REPORT, MATCH)])


def _by_document(s: np.ndarray) -> dict:
    """Spans as rows of documents and widths; spans that touch become one."""
    s = s[np.lexsort((s["start"], s["width"], s["tag"], s["id"]))]
    at, ends = runs(s["id"], s["tag"], s["width"])
    pairs = [np.stack(B.merged(s["start"][a:b].astype(np.int64), s["end"][a:b].astype(np.int64)), axis=1).astype("<u4").tobytes() for a, b in zip(at, ends)]
    return {"_id": s["id"][at], "_tag": s["tag"][at].astype(np.int64), "_width": s["width"][at].astype(np.int32), "_spans": pairs}


def _found(spans: np.ndarray, bucket: int | None = None, size: int | None = None, payload: bytes | None = None) -> pa.Table:
    """Spans as rows of documents, and a row of the level's array if there is one."""
    rows = _by_document(spans)
    n = len(rows["_spans"])
    out = pa.table({**rows, "bucket": pa.nulls(n, pa.int32()), "size": pa.nulls(n, pa.int32()), "payload": pa.nulls(n, pa.binary())}, schema=_FOUND)
    if payload is None:
        return out
    array = {"_id": pa.nulls(1, pa.int64()), "_tag": pa.nulls(1, pa.int64()), "_width": pa.nulls(1, pa.int32()), "_spans": pa.nulls(1, pa.binary()), "bucket": [bucket], "size": [size], "payload": [payload]}
    return pa.concat_tables([out, pa.table(array, schema=_FOUND)])


def _aged(e: np.ndarray) -> np.ndarray:
    """The entries as old ones."""
    out = e.copy()
    out["fresh"] = 0
    return out


def _read(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=dtype), *[np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]])


def _work(buckets: int):
    """A hash range's family in a closed corpus: the batches one after the other are merge-scanned against all levels, then become levels themselves."""

    def run(entries: pa.Table) -> pa.Table:
        bucket = entries.column("bucket")[0].as_py()
        if bucket < 0:
            return _found(_read(entries.column("bytes"), _SPAN))
        if bucket >= buckets:
            return _found(_equal_hashes(_read(entries.column("bytes"), _WINDOW)))
        family: list[tuple[int, SuffixArray]] = []
        found = [np.zeros(0, dtype=_SPAN)]
        of = entries.column("batch").to_numpy()
        for b in np.unique(of):
            fresh = SuffixArray.of_rows(entries.filter(pa.array(of == b)))
            found.append(_scan(SuffixArray.merged([*[level for _, level in family], fresh])))
            size, level = 1, SuffixArray(_aged(fresh.e), fresh.after, fresh.before)
            while family and family[-1][0] == size:
                level = SuffixArray.merged([family.pop()[1], level])
                size *= 2
            family.append((size, level))
        return _found(np.concatenate(found))

    return run


def _grow(buckets: int, size: int):
    """A hash range of a kept index: the batch is merge-scanned against the range's arrays of all levels; with those whose levels merge it becomes one array of `size` batches."""

    def run(entries: pa.Table, levels: pa.Table) -> pa.Table:
        bucket = (entries if entries.num_rows else levels).column("bucket")[0].as_py()
        if bucket < 0:
            return _found(_read(entries.column("bytes"), _SPAN))
        merges = levels.column("merges").to_pylist()
        if bucket >= buckets:
            fresh = _read(entries.column("bytes"), _WINDOW)
            own = np.concatenate([_read(levels.filter(pa.array(merges, pa.bool_())).column("payload"), _WINDOW), _aged(fresh)])
            spans = _equal_hashes(np.concatenate([_read(levels.column("payload"), _WINDOW), fresh]))
            return _found(spans, bucket, size, own.tobytes() if len(own) else None)
        arrays = [SuffixArray.read(x) for x in levels.column("payload")]
        own, spans = [x for x, m in zip(arrays, merges) if m], np.zeros(0, dtype=_SPAN)
        if entries.num_rows:
            fresh = SuffixArray.of_rows(entries)
            spans = _scan(SuffixArray.merged([*arrays, fresh]))
            own.append(SuffixArray(_aged(fresh.e), fresh.after, fresh.before))
        return _found(spans, bucket, size, SuffixArray.merged(own).payload() if own else None)

    return run


def _split(old: int, new: int):
    """A level's arrays by the finer ranges of now. Ranges go by the high bits of the hashes, so each new one lies within an old one, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, size, payload in zip(batch.column("bucket").to_pylist(), batch.column("size").to_pylist(), batch.column("payload")):
                if bucket >= old:
                    e = np.frombuffer(payload.as_buffer(), dtype=_WINDOW)
                    e = e[np.argsort(e["w1"], kind="stable")]
                    own, first = bucket_of(e["w1"], new), new
                    part = lambda x, y: e[x:y].tobytes()  # noqa: E731, B023
                else:
                    array = SuffixArray.read(payload)
                    own, first = bucket_of(array.e["key"], new), 0
                    part = lambda x, y: array.take(np.arange(x, y)).payload()  # noqa: E731, B023
                at, ends = runs(own)
                yield pa.record_batch([pa.array(own[at] + first, pa.int32()), pa.array([size] * len(at), pa.int32()), pa.array([part(x, y) for x, y in zip(at, ends)], pa.binary())], names=["bucket", "size", "payload"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("tag", F.xxhash64("text").bitwiseAND(0xFFFFFFFF))


def _count(rows: DataFrame, buckets: int) -> Levels:
    counts = rows.where(F.octet_length("text") >= REPORT).mapInArrow(_send_counts(buckets), BLOBS_SQL).groupBy("bucket").applyInArrow(find_counts, BLOBS_SQL)
    return Levels(materialize(counts, "grams"), buckets)


def _bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _ranges(total: int) -> int:
    return max(16, total // RANGE_BYTES)


@dataclass
class Level:
    """A table of arrays (bucket, size, payload), of `size` batches in so many ranges."""

    size: int
    buckets: int
    table: DataFrame


@dataclass
class Index:
    """The levels, the largest first. Their ranges double as the text that they hold does. Hot grams are those of the first batch: one that becomes hot later stays in its range."""

    family: list[Level]
    buckets: int
    bytes: int
    hot: Levels

    @property
    def levels(self) -> DataFrame:
        """bucket, size, payload of all levels."""
        return reduce(DataFrame.unionByName, [x.table for x in self.family])


def add(docs: DataFrame, index: Index | None = None) -> tuple[DataFrame, Index]:
    """Spans that docs and the index have in common or docs repeat (_id, _tag, _width, _spans; old documents' spans too), and the index with docs.

    The index holds every sampled suffix, as a later batch may match any. Each level is a table in the shared folder. A batch's level takes in the levels
    that it comes to equal in size; their tables are dropped, so the index that was given is used up. The other levels are only read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = _rows(docs)
    total = _bytes(rows)
    if index is None:
        index = Index([], _ranges(total), 0, _count(rows, _ranges(total)))
    total, buckets = total + index.bytes, index.buckets
    while buckets * RANGE_BYTES < total:
        buckets *= 2
    kept, merged, size = list(index.family), [], 1
    while kept and kept[-1].size == size:
        merged.append(kept.pop())
        size *= 2
    levels = spark.createDataFrame([], _LEVELS_SQL + ", merges boolean")
    for level in index.family:
        table = level.table if level.buckets == buckets else level.table.mapInArrow(_split(level.buckets, buckets), _LEVELS_SQL)
        levels = levels.unionByName(table.withColumn("merges", F.lit(level in merged)))
    met = _entries_of(rows, buckets, 1, None, index.hot).groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(_grow(buckets, size), _FOUND_SQL)
    kinds = met.withColumn("kind", F.when(F.col("bucket").isNull(), "spans").otherwise("level"))
    spans, level = materialize_parts(kinds, "suffixes", "kind", ["spans", "level"])
    drop_scratch(*[x.table for x in merged])
    return spans.select("_id", "_tag", "_width", "_spans"), Index([*kept, Level(size, buckets, _of(level))], buckets, total, index.hot)


def _of(level: DataFrame) -> DataFrame:
    out = level.select("bucket", "size", "payload")
    out.scratch_path = getattr(level, "scratch_path", None)
    return out


def _entries_of(rows: DataFrame, buckets: int, batches: int, counts: Levels | None, hot: Levels) -> DataFrame:
    return rows.where(F.octet_length("text") >= REPORT).mapInArrow(_send(buckets, batches, counts, hot), _ENTRIES_SQL)


def _apply(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i, text, cuts, seen in zip(batch.column("doc_id"), batch.column("text"), batch.column("_cuts"), batch.column("_seen")):
                raw = (text.as_py() or "").encode()
                starts, ends = _union(cuts)
                edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if len(starts) else raw
                a, b = _union(seen)
                values = (i.as_py(), len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest() if digest else kept, int((b - a).sum()))
                for out, x in zip(rows, values):
                    out.append(x)
            yield pa.record_batch(
                [*[pa.array(x, pa.int64()) for x in rows[:4]], pa.array(rows[4], pa.string() if digest else pa.binary()), pa.array(rows[5], pa.int64())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept", "n_repeated"],
            )

    return run


def _union(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(x.as_py() for x in spans) if spans.is_valid else b""
    pairs = np.frombuffer(raw, dtype="<u4").reshape(-1, 2).astype(np.int64)
    return B.merged(pairs[:, 0], pairs[:, 1])


def suffix_dedup(docs: DataFrame, digest: bool = False, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the kept bytes (their SHA-256 with digest) and n_repeated, the bytes that repeated strings of REPORT bytes cover."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = _rows(docs)
    buckets = _ranges(_bytes(rows))
    counts = _count(rows, buckets)
    found = materialize(_entries_of(rows, buckets, batches, counts, counts).groupBy("bucket").applyInArrow(_work(buckets), _FOUND_SQL), "spans")
    spans = lambda width: F.collect_list(F.when(F.col("_width") == width, F.col("_spans")))
    found = found.groupBy("_id", "_tag").agg(spans(MATCH).alias("_cuts"), spans(REPORT).alias("_seen"))
    own = F.coalesce(F.col("doc_id"), F.lit(int(NO_ID)))
    joined = rows.join(found, (own == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("doc_id", "text", "_cuts", "_seen")
    return joined.mapInArrow(_apply(digest), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digest else "kept binary") + ", n_repeated bigint")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}

#: Byte strings at every place, joined over a whole table, are beyond SQL at any size; tests hold it to brute force.
ORACLES: dict[str, str] = {}
