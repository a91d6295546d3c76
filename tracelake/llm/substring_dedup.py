"""Substring dedup by difference-cover anchors.

A window is 13 consecutive words. With the perfect difference set {0, 1, 3} modulo 7, two equal windows at any two
places have an aligned offset below 7 at which both places are in the cover, and the 7 words from there lie
inside both windows: hashing 7 words at cover positions alone (3 of 7) finds every repeated window.

1. Cover positions give anchors; a table of anchors that occur twice or more is made by hash range, and turned into a bit
   filter of a fixed largest size (FILTER_BITS). A fuller filter only lets more through.
2. Windows that hold an anchor in the filter are extended to all 13 words and compared by 96 bits of two hashes: first
   inside a piece of about 4 MB of text, where later copies are settled, then by hash range over one entry a piece.
   So a passage that a third of all documents share costs one entry a piece, not one a document.
3. Removed spans go by document range, many spans a row, and meet there as maximal runs, one row a document; these join
   back to the documents, and the words that they cover go.

A window goes if its word sequence also starts in a document with a smaller doc_id. Defined results: null, empty and blank texts have no words;
texts of fewer than 13 words lose none; repeated rows of one doc_id do not remove each other; a null doc_id counts as
larger than all; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import materialize, ship_package, table
from .repeats import BLOBS_SQL, Filter, blobs, bucket_of, find_twice, from_planes, key_blobs, planes, runs

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
GRAM = WINDOW - PERIOD + 1
#: Bytes of text whose entries meet in one hash range.
RANGE_BYTES = 4 << 20
#: Bytes of text whose removed spans meet in one document range.
DOC_BYTES = 16 << 20
NO_ID = np.iinfo(np.int64).max

_ENTRY = np.dtype([("w1", "<u8"), ("w2", "<u4"), ("tag", "<u4"), ("id", "<i8"), ("pos", "<u4")])
#: Words of a text, from start to end, that removed windows cover.
_SPAN = np.dtype([("id", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4")])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, tags, word hashes and offsets of the texts of each piece, and of each word its text."""
    data, offsets = B.strings(batch.column("text"))
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.uint32) if "tag" in batch.schema.names else np.zeros(len(ids), dtype=np.uint32)
    for i, j in B.pieces(offsets):
        own = offsets[i : j + 1] - offsets[i]
        words, at, _ = B.word_hashes(data[offsets[i] : offsets[j]], own)
        yield ids[i:j], tags[i:j], words, at, np.repeat(np.arange(j - i), np.diff(at))


def _anchors(words: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors among the words, and their hashes."""
    n = np.diff(at)
    local = np.arange(len(words)) - at[text]
    good = np.isin(local % PERIOD, COVER) & (local + GRAM <= n[text]) & (n[text] >= WINDOW)
    where = np.flatnonzero(good)
    return where, B.FIRST.windows(words, GRAM)[where] if len(where) else np.zeros(0, dtype=np.uint64)


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, words, at, text in _texts(batch):
                where, h = _anchors(words, at, text)
                yield from key_blobs(h, ids[text[where]], buckets)

    return run


def _send_windows(buckets: int, ranges: int, twice: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tags, words, at, text in _texts(batch):
                where, h = _anchors(words, at, text)
                if not len(where):
                    continue
                found = where[twice(h)]
                seen = np.zeros(len(words) + PERIOD + 1, dtype=np.int64)
                np.add.at(seen, found + 1, 1)
                seen = np.cumsum(seen)
                s = np.flatnonzero(seen[PERIOD : PERIOD + len(words)] > seen[: len(words)])
                s = s[s + WINDOW <= at[1:][text[s]]]
                if not len(s):
                    continue
                e = np.empty(len(s), dtype=_ENTRY)
                e["w1"], e["w2"] = B.FIRST.windows(words, WINDOW)[s], (B.SECOND.windows(words, WINDOW)[s] >> B.U64(32)).astype(np.uint32)
                e["id"], e["tag"], e["pos"] = ids[text[s]], tags[text[s]], s - at[text[s]]
                e = e[np.lexsort((e["id"], e["w2"], e["w1"]))]
                later = _later(e)
                settled = _by_document(_spans(e[later]), ranges)
                if settled.num_rows:  # they pass the hash ranges by: the bucket is negative
                    yield settled.set_column(0, "bucket", pc.subtract(pa.scalar(-1, pa.int32()), settled.column("bucket")))
                sent = e[~later]
                yield blobs(bucket_of(sent["w1"], buckets), sent, planes)

    return run


def _later(e: np.ndarray) -> np.ndarray:
    """Which entries, in the order of w1, w2, id, follow one of a smaller id."""
    if not len(e):
        return np.zeros(0, dtype=bool)
    new = np.concatenate([[True], (e["w1"][1:] != e["w1"][:-1]) | (e["w2"][1:] != e["w2"][:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return e["id"] > e["id"][first]


def _spans(e: np.ndarray) -> np.ndarray:
    """The words under removed windows: windows that follow each other are one span."""
    e = e[np.lexsort((e["pos"], e["tag"], e["id"]))]
    if not len(e):
        return np.zeros(0, dtype=_SPAN)
    pos = e["pos"].astype(np.int64)
    new = np.concatenate([[True], (e["id"][1:] != e["id"][:-1]) | (e["tag"][1:] != e["tag"][:-1]) | (pos[1:] > pos[:-1] + WINDOW)])
    at = np.flatnonzero(new)
    out = np.empty(len(at), dtype=_SPAN)
    out["id"], out["tag"], out["start"] = e["id"][at], e["tag"][at], pos[at]
    out["end"] = pos[np.concatenate([at[1:] - 1, [len(e) - 1]])] + WINDOW
    return out


def _by_document(spans: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Spans as blobs by document range; texts of one id (null above all) spread by their tags."""
    where = (B.mix(spans["id"].astype(np.uint64) ^ B.mix(spans["tag"].astype(np.uint64))) % B.U64(ranges)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    return blobs(where[order], spans[order], planes)


def _resolve(ranges: int):
    """Of a hash range: spans of removed words by document range. Settled spans only change their bucket."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket < 0:
            return group.set_column(0, "bucket", pa.array([-1 - bucket] * len(group), pa.int32()))
        e = from_planes(group.column("payload"), _ENTRY)
        e = e[np.lexsort((e["id"], e["w2"], e["w1"]))]
        return pa.Table.from_batches([_by_document(_spans(e[_later(e)]), ranges)])

    return run


_REPLY = pa.schema([("_id", pa.int64()), ("_tag", pa.int64()), ("_at", pa.binary())])
#: More than any word's place, so that spans of different texts never touch.
_APART = 1 << 33


def _merge(group: pa.Table) -> pa.Table:
    """The maximal runs of removed words of each document of a range."""
    e = from_planes(group.column("payload"), _SPAN)
    e = e[np.lexsort((e["tag"], e["id"]))]
    at, ends = runs(e["id"], e["tag"])
    base = np.repeat(np.arange(len(at), dtype=np.int64) * _APART, ends - at)
    starts, stops = B.merged(base + e["start"], base + e["end"])
    pairs = np.stack([starts % _APART, stops % _APART], axis=1).astype("<u4")
    cut = np.searchsorted(starts, np.arange(len(at) + 1, dtype=np.int64) * _APART)
    return pa.table({"_id": e["id"][at], "_tag": e["tag"][at].astype(np.int64), "_at": [pairs[i:j].tobytes() for i, j in zip(cut, cut[1:])]}, schema=_REPLY)


def _apply(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for i, text, at in zip(batch.column("doc_id"), batch.column("text"), batch.column("_at")):
                words = (text.as_py() or "").encode().split()
                n, gone = len(words), 0
                if at.is_valid:
                    pairs = np.frombuffer(at.as_buffer(), dtype="<u4").reshape(-1, 2).tolist()
                    stay, last = [], 0
                    for a, b in pairs:
                        stay += words[last:a]
                        last = b
                    words = stay + words[last:]
                    gone = n - len(words)
                kept = b" ".join(words)
                for out, x in zip(rows, (i.as_py(), n, gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode())):
                    out.append(x)
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return run


def substring_dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space (their SHA-256 with digest)."""
    spark = docs.sparkSession
    ship_package(spark)
    # The tag tells texts of a repeated doc_id apart.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tagged = rows.withColumn("tag", F.xxhash64("text").bitwiseAND(0xFFFFFFFF))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, ranges = max(16, size // RANGE_BYTES), max(16, size // DOC_BYTES)

    keys = rows.mapInArrow(_send_anchors(buckets), BLOBS_SQL).groupBy("bucket").applyInArrow(find_twice, BLOBS_SQL)
    twice = Filter(materialize(keys, "anchors"), buckets)

    spans = tagged.mapInArrow(_send_windows(buckets, ranges, twice), BLOBS_SQL).groupBy("bucket").applyInArrow(_resolve(ranges), BLOBS_SQL)
    replies = spans.groupBy("bucket").applyInArrow(_merge, "_id bigint, _tag bigint, _at binary")
    own = F.coalesce(F.col("doc_id"), F.lit(int(NO_ID)))
    joined = tagged.join(replies, (own == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("doc_id", "text", "_at")
    out = joined.mapInArrow(_apply(digest), "doc_id bigint, n_words bigint, n_removed bigint, " + ("kept_sha256" if digest else "kept") + " string")
    return out


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op9_substring_dedup": op9_substring_dedup}

ORACLES = {
    "op9_substring_dedup": r"""
WITH docs_in AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
wins AS (
  SELECT rid, doc_id, s, array_to_string(words[s:s + 12], ' ') AS w FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM docs_in)),
firsts AS (SELECT rid, s, coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY w) AS gone FROM wins),
removed AS (SELECT DISTINCT rid, unnest(range(s, s + 13)) AS pos FROM firsts WHERE gone),
tokens AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs_in),
kept AS (
  SELECT t.rid, string_agg(word, ' ' ORDER BY t.pos) AS k, count(*) AS n FROM tokens t LEFT JOIN removed r ON t.rid = r.rid AND t.pos = r.pos WHERE r.rid IS NULL GROUP BY t.rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM docs_in LEFT JOIN kept USING (rid)
"""
}
