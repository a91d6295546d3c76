"""Ranked lexical search: an inverted index in shards, merged document by document through heaps.

1. Each task cuts its documents into shards of SHARD_BYTES of text, without a shuffle. A shard's documents are numbered in the order of
   doc_id; every term has a row with its postings, ordered by that number and compressed: gaps and counts as variable-length bytes, in
   blocks of BLOCK documents, each with its greatest count and its shortest document. All terms of all documents are indexed. The index is a table that
   may be kept, reopened and extended: document counts, lengths and weights are summed when it is asked.
2. Items go through all shards in blocks of ITEMS. In a shard and item a heap holds the next block of documents of each of the item's terms; the lists
   that stand at the least block are taken together and their documents' scores added up. Documents enter a heap of the `top` best, keyed by score,
   then by doc_id; a block whose greatest counts and shortest documents cannot beat its least entry is passed over.
3. The shards' best are merged by item.

Defined results: null or termless documents count for nothing and are never found; null or termless items find nothing; items that are equal in item_id and text are
one item; repeated documents are found each on their own (equal scores of one doc_id in any order, as their rows are equal); null doc_ids come last; a
term that nearly every document holds may weigh 0; empty tables give an empty result. Other columns are not read.
A longer text than SHARD_BYTES is a shard of its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .common import drop_scratch, materialize, ship_package, small, table
from .repeats import runs

SHARD_BYTES = 8 << 20
BLOCK = 512
ITEMS = 1_000
TOP = 10
#: A term's saturation by count and length: score parts are w * (SCALE * tf div (1000 * tf + 8 * m)), m in percent of the mean length.
SCALE, LENGTH_PERCENT = 1_000_000_000, 75
NO_ID = np.iinfo(np.int64).max
#: All that ends a term: every ASCII character but digits and letters.
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_inside = np.zeros(256, dtype=bool)
_inside[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: A row of a shard's documents (term is null: numbered ids and lengths) or of a term's postings.
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("n_terms", pa.int64()), ("heads", pa.binary()), ("body", pa.binary())])
_INDEX_SQL = "shard bigint, term string, df bigint, n_terms bigint, heads binary, body binary"
_FOUND_SQL = "item bigint, doc_id bigint, score bigint"


def varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, and how many bytes each value takes."""
    v = v.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for bits in (7, 14, 21, 28, 35):
        size += v >= B.U64(1 << bits)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[at[on] + k] = ((v[on] >> B.U64(7 * k)) & B.U64(127)).astype(np.uint8) | ((size[on] > k + 1).astype(np.uint8) << 7)
    return out, size


def from_varints(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], raw[:-1] < 128]))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def _cut(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive stretches of bytes as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each term, by segments of bytes."""
    first, second = np.empty(len(starts), dtype=np.uint64), np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + B.SEGMENT, side="right")))
        a, b = starts[i], ends[j - 1]
        for out, poly in ((first, B.FIRST), (second, B.SECOND)):
            out[i:j] = poly.spans(poly.sums(poly.table[low[a:b]]), starts[i:j] - a, ends[i:j] - a)
        i = j
    return first, second


def _shard(number: int, ids: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The index of some documents."""
    order = np.argsort(ids, kind="stable")
    ids, (data, offsets) = ids[order], B.strings(texts.take(pa.array(order)))
    inside = _inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:-1]]) if len(data) else inside)
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | edge[1:-1], [True]]) if len(data) else inside) + 1
    lengths = np.diff(np.searchsorted(starts, offsets))
    docs = pa.record_batch([[number], pa.array([None], pa.string()), [int((lengths > 0).sum())], [int(lengths.sum())], [ids.tobytes()], [lengths.astype("<i4").tobytes()]], schema=_INDEX)
    yield docs
    if not len(starts):
        return
    low = B.LOWER_AZ[data]
    first, second = _hashes(low, starts, ends)
    doc = np.repeat(np.arange(len(ids)), lengths)
    by = np.argsort(first, kind="stable")
    if ((first[by][1:] == first[by][:-1]) & (second[by][1:] != second[by][:-1])).any():
        by = np.lexsort((doc, second, first))
    first, second, doc = first[by], second[by], doc[by]
    # A posting is a document that has the term, with the count; a block a stretch of postings of one term and block of documents.
    at, to = runs(first, second, doc)
    tf, doc, first, second, token = to - at, doc[at], first[at], second[at], by[at]
    b0, b1 = runs(first, second, doc // BLOCK)
    t0, t1 = runs(first[b0], second[b0])
    gap = np.diff(doc, prepend=0)
    gap[b0] = doc[b0] % BLOCK
    body, size = varints(np.stack([gap, tf], axis=1).ravel())
    size = np.add.reduceat(size, 2 * b0)
    block = np.diff(doc[b0] // BLOCK, prepend=0)
    block[t0] = doc[b0[t0]] // BLOCK
    heads, width = varints(np.stack([block, b1 - b0, np.maximum.reduceat(tf, b0), np.minimum.reduceat(lengths[doc], b0)], axis=1).ravel())
    token = token[b0[t0]]
    words = _cut(low[B.ragged(starts[token], ends[token] - starts[token])], ends[token] - starts[token]).cast(pa.string())
    df = np.add.reduceat(b1 - b0, t0)
    n = len(t0)
    heads, body = _cut(heads, np.add.reduceat(width, 4 * t0)), _cut(body, np.add.reduceat(size, t0))
    every = pa.record_batch([pa.array(np.full(n, number)), words, pa.array(df), pa.array(np.zeros(n, dtype=np.int64)), heads, body], schema=_INDEX)
    for i in range(0, n, 50_000):
        yield every.slice(i, 50_000)


def _index(generation: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, made = [], [], 0, 0
        number = (generation << 48) | (TaskContext.get().partitionId() << 20)
        for batch in batches:
            text = batch.column("text")
            _, offsets = B.strings(text)
            own = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            for i, j in B.pieces(offsets, shard_bytes // 4):
                if texts and size + offsets[j] - offsets[i] > shard_bytes:
                    yield from _shard(number + made, np.concatenate(ids), pa.concat_arrays(texts))
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(own[i:j])
                texts.append(text.slice(i, j - i))
                size += offsets[j] - offsets[i]
        if texts:
            yield from _shard(number + made, np.concatenate(ids), pa.concat_arrays(texts))

    return run


def merge(lists: list[tuple], bounds: np.ndarray, top: int, ids: np.ndarray) -> list[tuple[int, int]]:
    """The best (score, document number), from lists of (weight, block numbers, their postings' ends, numbers, parts of the score before weighing);
    bounds: of each list and block the greatest part."""
    best: list[tuple[int, int]] = []  # the least first: by score, then the greater doc_id
    heads = [(x[1][0], k, 0) for k, x in enumerate(lists)]
    heapq.heapify(heads)
    scores = np.zeros(BLOCK, dtype=np.int64)
    while heads:
        block, here, most = heads[0][0], [], 0
        while heads and heads[0][0] == block:
            _, k, at = heads[0]
            here.append((k, at))
            most += lists[k][0] * int(bounds[k][at])
            if at + 1 < len(lists[k][1]):
                heapq.heapreplace(heads, (lists[k][1][at + 1], k, at + 1))
            else:
                heapq.heappop(heads)
        if len(best) == top and most <= best[0][0]:
            continue
        scores[:] = 0
        for k, at in here:
            weight, _, ends, doc, part = lists[k]
            a, b = (ends[at - 1] if at else 0), ends[at]
            scores[doc[a:b] - block * BLOCK] += weight * part[a:b]
        good = np.flatnonzero(scores > (best[0][0] if len(best) == top else 0))
        if len(good) > top:  # a document below the top-th score of its block is below it everywhere
            good = good[scores[good] >= np.partition(scores[good], len(good) - top)[len(good) - top]]
        for d in good:
            entry = (int(scores[d]), -int(d) - block * BLOCK)
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(s, -d) for s, d in best]


def _search(top: int, n_docs: int, n_terms: int):
    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        """One shard and one block of items."""
        out: list[tuple[int, int, int]] = []
        docs = rows.filter(pa.compute.is_null(rows["term"]))
        rows = rows.filter(pa.compute.is_valid(rows["term"]))
        if len(rows) and len(docs):
            ids = np.frombuffer(docs["heads"][0].as_buffer(), dtype="<i8")
            lengths = np.frombuffer(docs["body"][0].as_buffer(), dtype="<i4").astype(np.int64)
            length = lambda n: 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_docs) // n_terms
            part = lambda tf, n: (SCALE * tf) // (1000 * tf + 8 * length(n))
            lists, bounds, weight = {}, {}, dict(zip(rows["term"].to_pylist(), rows["weight"].to_pylist()))
            for term, heads, body in zip(rows["term"].to_pylist(), rows["heads"], rows["body"]):
                head = from_varints(np.frombuffer(heads.as_buffer(), dtype=np.uint8)).reshape(-1, 4)
                pairs = from_varints(np.frombuffer(body.as_buffer(), dtype=np.uint8)).reshape(-1, 2)
                block, ends = np.cumsum(head[:, 0]), np.cumsum(head[:, 1])
                gap = pairs[:, 0].copy()
                far = np.cumsum(gap)
                before = np.concatenate([[0], far[ends[:-1] - 1]])
                doc = far - np.repeat(before, head[:, 1]) + np.repeat(block * BLOCK, head[:, 1])
                lists[term] = (block.tolist(), ends.tolist(), doc, part(pairs[:, 1], lengths[doc]))
                bounds[term] = part(head[:, 2], head[:, 3])
            for item, terms in zip(asked["item"].to_pylist(), asked["terms"].to_pylist()):
                times: dict[str, int] = {}
                for t in terms:
                    if weight.get(t, 0) > 0:
                        times[t] = times.get(t, 0) + 1
                mine = [(n * weight[t], *lists[t]) for t, n in times.items()]
                out += [(item, int(ids[d]), s) for s, d in merge(mine, [bounds[t] for t in times], top, ids)]
        a = np.array(out, dtype=np.int64).reshape(-1, 3)
        # A null doc_id was numbered last.
        return pa.table({"item": pa.array(a[:, 0]), "doc_id": pa.array(a[:, 1], mask=a[:, 1] == NO_ID), "score": pa.array(a[:, 2])})

    return run


def terms_of(text: Column) -> Column:
    """The terms of a text, A-Z lower-cased; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, NOT_TERM), lambda t: t != "")


class LexicalIndex:
    """An inverted index of documents, as a table at a path; without one, a scratch table."""

    def __init__(self, rows: DataFrame, path: str | None = None, generation: int = 0):
        self.rows, self.path, self.generation = rows, path, generation

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> LexicalIndex:
        rows = cls._rows(docs, 0, shard_bytes)
        if path is None:
            return cls(materialize(rows, "lexical-index"))
        rows.write.option("compression", "zstd").parquet(f"{path.rstrip('/')}/generation=0")
        return cls.open(docs.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalIndex:
        rows = spark.read.schema(f"{_INDEX_SQL}, generation int").option("basePath", path).parquet(path)
        return cls(rows.drop("generation"), path, rows.agg(F.max("generation")).first()[0] or 0)

    def add(self, docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> LexicalIndex:
        """The index with more documents: their shards are written beside those that are there, which stay as they are."""
        if self.path is None:
            raise ValueError("an index without a path cannot be extended")
        to = f"{self.path.rstrip('/')}/generation={self.generation + 1}"
        self._rows(docs, self.generation + 1, shard_bytes).write.option("compression", "zstd").parquet(to)
        return self.open(docs.sparkSession, self.path)

    @staticmethod
    def _rows(docs: DataFrame, generation: int, shard_bytes: int) -> DataFrame:
        ship_package(docs.sparkSession)
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        return rows.mapInArrow(_index(generation, shard_bytes), _INDEX_SQL)

    def search(self, items: DataFrame, top: int = TOP) -> DataFrame:
        """item_id, rank, doc_id, score of each item's best documents."""
        spark = self.rows.sparkSession
        ship_package(spark)
        asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
        asked = materialize(asked.select("item_id", F.xxhash64("item_id", "text").alias("item"), terms_of(F.col("text")).alias("terms")), "lexical-items")
        blocks = max(1, math.ceil(asked.count() / ITEMS))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
        docs = self.rows.where("term is null")
        n_docs, n_terms = docs.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

        # Each block's terms meet the postings by equality; a shard's numbers go to each block.
        wanted = asked.select("block", F.explode("terms").alias("term")).distinct()
        known = self.rows.where("term is not null").join(small(wanted.select("term").distinct()), "term", "left_semi")
        known = materialize(known, "lexical-postings")
        weight = known.groupBy("term").agg(F.sum("df").alias("_df"))
        log = F.ln((F.lit(2.0 * n_docs + 2.0)) / (2.0 * F.col("_df") + 1.0))
        weight = wanted.join(weight, "term").select("block", "term", F.floor(1000.0 * log).cast("bigint").alias("weight"))
        hits = known.join(small(weight), "term").select("shard", "block", "term", "weight", "heads", "body")
        numbers = docs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("shard", "block", "term", F.lit(None).cast("bigint").alias("weight"), "heads", "body")
        shards = docs.select("shard")
        mine = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(small(asked), "block").select("shard", "block", "item", "terms")
        found = hits.unionByName(numbers).groupBy("shard", "block").cogroup(mine.groupBy("shard", "block")).applyInArrow(_search(top, int(n_docs), int(n_terms)), _FOUND_SQL)

        # Spark keeps the best of each task already before this shuffle, as the rank is bounded.
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        return found.join(small(asked.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")

    def drop(self) -> None:
        """Delete the index, if it is a scratch table."""
        drop_scratch(self.rows)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LexicalIndex.build(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical_search": op12_lexical_search}

ORACLES = {
    "op12_lexical_search": r"""
WITH toks AS (
  SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
stats AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM toks),
ask AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item_id, term, count(*) AS times FROM ask GROUP BY ALL),
posts AS (
  SELECT rid, doc_id, size, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms)::BIGINT AS size, unnest(terms) AS term FROM toks)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM stats) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posts GROUP BY term),
scored AS (
  SELECT item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * (SELECT n FROM stats)) // (SELECT l FROM stats)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN posts USING (term) GROUP BY ALL HAVING score > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
}
