"""Token ids packed into fixed-length rows, as binary.

Texts become byte-level BPE ids, each document ended by one separator. A document longer than a row is split, losing nothing; segments
are packed by best-fit decreasing: the fullest row that still has room is found by descending a segment tree over the free
capacities. Rows carry the ids (padded with the separator), the cumulative segment lengths and the positions, which restart with every segment.

Work is by blocks of BLOCK tokens inside a task, so memory is bounded and nothing is shuffled; a lost task is simply run
again with the same result. Defined results: null and empty texts are one separator; repeated rows are packed each; an empty table gives
no rows; a null doc_id stays null. Other columns are not read.

The vocabulary is a file of public ranks whose path is a parameter; executors read it from the same path.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import ship_package, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The id behind each document; the vocabulary's first free one.
SEPARATOR = 50256
ROW = 2048
#: Tokens that are packed together.
BLOCK = 4 << 20
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1 << 20

_ROWS = pa.schema([("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))])
ROWS_SQL = "pack_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, doc_offsets array<bigint>"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Ids of texts, found by pieces. A text is cut before a single space between two characters that are surely no white space: no
    token and no look-ahead of the pattern reaches over such a place, so the pieces' ids, joined, are the text's ids."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.flat: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.count = 0
        self.table, self.starts, self.lengths = np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the n + 1 offsets of each text's."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 2:
            plain = (data > 0x20) & (data < 0x7F)
            after = plain.copy()  # the last byte of a character that is no white space
            after[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
            before = plain | ((data >= 0xC3) & (data <= 0xDF))
            cut[1:-2] = (data[1:-1] == 0x20) & after[:-2] & before[2:]
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, dtype=np.uint16), np.zeros(len(offsets), dtype=np.int64)
        hashes = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + B.SEGMENT, side="right")))
            a = starts[i]
            hashes[i:j] = B.FIRST.spans(B.FIRST.sums(B.FIRST.table[data[a : ends[j - 1]]]), starts[i:j] - a, ends[i:j] - a)
            i = j
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.count + len(unique) > REMEMBERED:
            self.clear()
        where = np.empty(len(unique), dtype=np.int64)
        encoding, raw = encoder(self.path), data.tobytes()
        for k, h in enumerate(unique.tolist()):
            row = self.rows.get(h)
            if row is None:
                a, b = starts[first[k]], ends[first[k]]
                got = np.array(encoding.encode_ordinary(raw[a:b].decode()), dtype=np.uint16)
                row = self.rows[h] = self.count
                self.count += 1
                self.flat.append(got)
                self.sizes.append(len(got))
            where[k] = row
        if self.flat:
            self.table = np.concatenate([self.table, *self.flat])
            self.lengths = np.concatenate([self.lengths, np.array(self.sizes, dtype=np.int64)])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.flat, self.sizes = [], []
        row = where[back]
        sizes = self.lengths[row]
        ids = self.table[B.ragged(self.starts[row], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.searchsorted(starts, offsets)]


class Capacities:
    """Free capacities of open rows under a segment tree: the least capacity of at least n that some row has."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.leaves
        while i:
            self.open[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        i = need + self.leaves
        if not self.open[i]:
            # Up to the first ancestor whose right neighbour has an open row, then down to its least leaf.
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.open[i] -= 1
            i >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit(sizes: np.ndarray, row: int) -> list[list[int]]:
    """Items of each row, the largest items first; sizes are 1 to row."""
    rows: list[list[int]] = []
    free = Capacities(row)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        got = free.take(size)
        if got is None:
            capacity, r = row, len(rows)
            rows.append([])
        else:
            capacity, r = got
        rows[r].append(k)
        if capacity > size:
            free.put(capacity - size, r)
    return rows


def pack(ids: np.ndarray, offsets: np.ndarray, doc_ids: list, row: int, first: int) -> pa.RecordBatch:
    """The rows of a block of documents; ids include the separators."""
    lengths = np.diff(offsets)
    parts = -(-lengths // row)
    doc = np.repeat(np.arange(len(lengths)), parts)
    within = B.ragged(np.zeros(len(parts), dtype=np.int64), parts) * row
    size = np.minimum(lengths[doc] - within, row)
    place = np.arange(row, dtype=np.uint16)
    out: list[list] = [[] for _ in _ROWS]
    for r, items in enumerate(best_fit(size, row)):
        block, positions, ends = np.full(row, SEPARATOR, dtype="<u2"), np.zeros(row, dtype="<u2"), [0]
        for k in items:
            a, n = offsets[doc[k]] + within[k], int(size[k])
            block[ends[-1] : ends[-1] + n] = ids[a : a + n]
            positions[ends[-1] : ends[-1] + n] = place[:n]
            ends.append(ends[-1] + n)
        values = (first + r, ends[-1], block.tobytes(), ends, positions.tobytes(), [doc_ids[doc[k]] for k in items], [int(within[k]) for k in items])
        for column, x in zip(out, values):
            column.append(x)
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(out, _ROWS)], schema=_ROWS)


def _packed(path: str, row: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Ids(path)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        docs: list = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, sizes, docs, count, first
            out = pack(np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), docs, row, first)
            first += out.num_rows
            held, sizes, docs, count = [], [], [], 0
            return out

        for batch in batches:
            data, offsets = B.strings(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for i, j in B.pieces(offsets):
                ids, at = tokens.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(np.insert(ids, at[1:], SEPARATOR).astype(np.uint16))
                sizes.append(np.diff(at) + 1)
                docs += names[i:j]
                count += len(held[-1])
                if count >= block:
                    yield flush()
        if docs:
            yield flush()

    return run


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, row: int = ROW, block: int = BLOCK) -> DataFrame:
    """Packed rows: pack_id, n_tokens, ids (little-endian uint16, `row` of them), cu_seqlens, position_ids, and of each segment its doc_id and first token's place."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_packed(vocabulary, row, block), ROWS_SQL)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Packed rows as files of a folder that all executors can write to; id matrices as raw binary in each row."""
    pack_documents(docs, **options).write.option("compression", "zstd").parquet(path)


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_packing": op10_token_packing}

#: BPE and best-fit packing have no SQL; tests hold them to an exact round trip and to a plain packing.
ORACLES: dict[str, str] = {}
