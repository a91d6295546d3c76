"""Runs: stretches of words that repeat with a period, found from the longest previous factors.

In a piece of about PIECE bytes of whole texts (a longer text is a piece of its own):

1. Words become numbers, and prefix doubling sorts the suffixes of every text. The ranks by the first 1, 2, 4, ... words are kept: they
   tell the longest common prefix of two suffixes, or suffix of two prefixes, in as many steps as there are levels.
2. The suffix array and the common prefixes of its neighbours give each place's longest previous factor and its source, by the
   nearest smaller places on both sides. Factors of fewer than SHORT words count as none: a run of the asked kind shows in longer ones.
3. Blocks follow from the left: a longest previous factor, or one word.
4. A run's leftmost occurrence meets a block boundary. At each boundary, for the periods that its two blocks allow, the words on both sides are extended
   in both directions; a run that lies inside a block is copied from the block's source, where the runs are kept in order of their starts.

Runs have at least `exponent` (3 or more) periods and `shortest` (6 or more) words. Defined results: null, empty and blank texts have no words and no
runs; a run never crosses texts; of one stretch the smallest period counts; repeated rows are texts of their own; ties do not arise, as start and
period order a text's runs; an empty table gives an empty result. Other columns are not read. Memory: about 200 bytes a word of a piece, and 4 more for each doubling of its longest repeat.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import ship_package, table, ws_words
from .repeats import runs as stretches

EXPONENT, SHORTEST = 4, 6
SHORT = 3
PIECE = 1 << 20
_SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Suffixes:
    """Suffix array of the texts of a piece, and the ranks of every place by its first 1, 2, 4, ... words; start, end: of each place's text."""

    def __init__(self, first: np.ndarray, second: np.ndarray, start: np.ndarray, end: np.ndarray):
        n, self.start, self.end = len(first), start, end
        # Words of different texts are different, so no suffix is compared with one of another text.
        key = B.mix(first + B.mix(start.astype(np.uint64) + B.U64(1)))
        order = np.argsort(key, kind="stable")
        a, b = order[:-1], order[1:]
        if ((key[a] == key[b]) & ((second[a] != second[b]) | (start[a] != start[b]))).any():
            order = np.lexsort((second, first, start))
            at, to = stretches(start[order], first[order], second[order])
        else:
            at, to = stretches(key[order])
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.repeat(at, to - at)
        self.array, self.levels = order, [rank]
        open_, width = order[np.repeat(to - at > 1, to - at)], 1
        while len(open_):
            rank = self.levels[-1]
            after = open_ + width
            tail = np.where(after < end[open_], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            pair = rank[open_].astype(np.int64) * (n + 1) + tail
            by = np.argsort(pair, kind="stable")
            open_, pair = open_[by], pair[by]
            old = rank[open_].astype(np.int64)
            at, to = stretches(old)
            place = old + np.arange(len(open_)) - np.repeat(at, to - at)
            self.array[place] = open_
            at, to = stretches(pair)
            rank = rank.copy()
            rank[open_] = np.repeat(place[at], to - at)
            self.levels.append(rank)
            open_, width = open_[np.repeat(to - at > 1, to - at)], 2 * width

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same."""
        n, out = len(self.array), np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i + out, j + out
            same = (np.maximum(a, b) < n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            out += same.astype(np.int64) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are the same; i < j, of one text."""
        out, low = np.zeros(len(i), dtype=np.int64), self.start[np.minimum(i, len(self.array) - 1)]
        for k in range(len(self.levels) - 1, -1, -1):
            rank, a, b = self.levels[k], i - out - (1 << k), j - out - (1 << k)
            same = (a >= low) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
            out += same.astype(np.int64) << k
        return out


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and sources of the longest previous factors of SHORT words or more, by place."""
    none = np.zeros(0, dtype=np.int64)
    if len(s.levels) < 2:
        return none, none, none
    sa, pair = s.array, s.levels[1][s.array]
    near = np.flatnonzero(pair[1:] == pair[:-1])  # neighbours share two words
    common = s.forward(sa[near], sa[near + 1])
    near, common = near[common >= SHORT], common[common >= SHORT]
    if not len(near):
        return none, none, none
    at, to = stretches(near - np.arange(len(near)))  # groups of neighbours, each with the next
    lone = to - at == 1
    i, j = sa[near[at[lone]]], sa[near[at[lone]] + 1]
    places, sizes, sources = [np.maximum(i, j)], [common[at[lone]]], [np.minimum(i, j)]
    more: list[tuple[int, int, int]] = []
    for a, b in zip(at[~lone].tolist(), to[~lone].tolist()):
        group = sa[near[a] : near[b - 1] + 2].tolist()
        lcp = [0, *common[a:b].tolist(), 0]
        stack: list[tuple[int, int]] = []  # a place, and its common prefix with the smaller one below it
        for x, shared in zip([*group, -1], lcp):
            while stack and x < stack[-1][0]:
                place, left = stack.pop()
                if left >= shared and left:
                    more.append((place, left, stack[-1][0]))
                elif shared:
                    more.append((place, shared, x))
                shared = min(shared, left)
            stack.append((x, shared))
    if more:
        for out, x in zip((places, sizes, sources), np.array(more, dtype=np.int64).T):
            out.append(x)
    place, size, source = (np.concatenate(x) for x in (places, sizes, sources))
    by = np.argsort(place)
    return place[by], size[by], source[by]


def blocks(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the factors are blocks, from the left; all words between them are blocks of one."""
    end, out = 0, []
    for k, (p, n) in enumerate(zip(place.tolist(), size.tolist())):
        if p >= end:
            out.append(k)
            end = p + n
    return np.array(out, dtype=np.int64)


def _crossing(s: Suffixes, place: np.ndarray, size: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs that meet a boundary of blocks.

    Behind its first period, a run is a previous factor up to its end. So the block of the run's second period ends, or the one behind it begins, a boundary
    whose two blocks have exponent - 1 periods between them but for SHORT - 2 words; and two words at the boundary, or before it, recur a period away.
    """
    low, high, end = s.start[place], s.end[place], place + size
    joined = np.zeros(len(place), dtype=bool)
    joined[1:] = place[1:] == end[:-1]
    joined[1:] &= low[1:] == low[:-1]
    before = np.where(joined, np.concatenate([[0], size[:-1]]), np.minimum(place - low, 1))
    last = np.concatenate([~joined[1:], [True]])
    at = np.concatenate([place, end[last]])
    both = np.concatenate([before + size, size[last] + np.minimum(high - end, 1)[last]])
    low, high = np.concatenate([low, low[last]]), np.concatenate([high, high[last]])
    most = np.minimum((both + 1) // (exponent - 1), (high - low) // exponent)
    q = B.ragged(np.ones(len(at), dtype=np.int64), most)
    at, low, high = (np.repeat(x, most) for x in (at, low, high))
    two, top = s.levels[1], len(s.array) - 1
    found = []
    for left in (at - q, at, at - 2 - q):
        fits = (left >= low) & (left + q < high)
        same = fits & (two[np.clip(left, 0, top)] == two[np.clip(left + q, 0, top)])
        found.append((left[same], q[same]))
    left, q = (np.concatenate(x) for x in zip(*found))
    start = left - s.backward(left, left + q)
    end = left + q + s.forward(left, left + q)
    good = end - start >= np.maximum(shortest, exponent * q)
    start, end, q = start[good], end[good], q[good]
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    at, _ = stretches(start, end)  # the smallest period of a stretch
    return start[at], end[at], q[at]


def all_runs(s: Suffixes, exponent: int = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """start, end, period of all runs of a piece, by start and period."""
    place, size, source = previous_factors(s)
    mine = blocks(place, size)
    place, size, source = place[mine], size[mine], source[mine]
    if not len(place):
        return np.zeros((0, 3), dtype=np.int64)
    start, end, q = _crossing(s, place, size, exponent, shortest)
    known = list(zip(start.tolist(), end.tolist(), q.tolist()))
    texts = set(s.start[start].tolist())  # a text without a run at a boundary has none at all
    inner = np.flatnonzero((size >= shortest + 2) & np.isin(s.start[place], np.array(sorted(texts), dtype=np.int64)))
    seen = set(known)
    for p, n, o in zip(place[inner].tolist(), size[inner].tolist(), source[inner].tolist()):
        k = bisect_left(known, (o + 1,))
        # What is copied comes behind what it is copied from, so a block over its own source is filled on the way.
        while k < len(known) and known[k][0] < o + n - 1:
            a, b, period = known[k]
            copy = (a + p - o, b + p - o, period)
            if b < o + n and copy not in seen:
                seen.add(copy)
                insort(known, copy)
            k += 1
    out = np.array(known, dtype=np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _piece(data: np.ndarray, offsets: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each text: the number of words, the runs, and the words that no run repeats, joined by one space."""
    first, of, (starts, ends) = B.word_hashes(data, offsets)
    second, _, _ = B.word_hashes(data, offsets, poly=B.SECOND)
    n_words = np.diff(of)
    found = np.zeros((0, 3), dtype=np.int64)
    if len(first):
        found = all_runs(Suffixes(first, second, np.repeat(of[:-1], n_words), np.repeat(of[1:], n_words)), exponent, shortest)
    text = np.searchsorted(of, found[:, 0], side="right") - 1
    at = pa.array(np.searchsorted(text, np.arange(len(offsets))).astype(np.int32))
    shown = pa.StructArray.from_arrays([pa.array(found[:, 0] - of[text]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], ["start", "length", "period"])
    edge = np.zeros(len(first) + 1, dtype=np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    # A kept word takes the byte behind it as its space, but for a text's last.
    owner = np.searchsorted(of, kept, side="right") - 1
    space = np.concatenate([owner[1:] == owner[:-1], [False]])[: len(kept)]
    size = ends[kept] - starts[kept] + space
    raw = np.append(data, np.uint8(0))
    raw[ends[kept[space]]] = 0x20
    out = raw[B.ragged(starts[kept], size)]
    cut = np.concatenate([[0], np.cumsum(np.bincount(owner, size, minlength=len(offsets) - 1))]).astype(np.int64)
    collapsed = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(cut), pa.py_buffer(out)])
    return n_words, pa.ListArray.from_arrays(at, shown), collapsed.cast(pa.string())


def _detect(exponent: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.strings(batch.column("text"))
            for i, j in B.pieces(offsets, PIECE):
                own = offsets[i : j + 1]
                n_words, found, collapsed = _piece(data[own[0] : own[-1]], own - own[0], exponent, shortest)
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(n_words.astype(np.int64)), found, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and period) and collapsed: the words without those that a run repeats."""
    if exponent < 3 or shortest < 6:
        raise ValueError("runs of fewer than 3 periods or 6 words are not found by blocks of this kind")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_detect(exponent, shortest), _SCHEMA)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, the first of equal ones; null without runs."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.try_element_at(runs, F.lit(1)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) ends with 0, the words from some place on repeat with a period, both by that number."""
    words, h = ws_words(F.col("text")), F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    n, g = F.size("_words").cast("bigint"), F.floor(F.col("_h") / 10)
    chosen = chosen.withColumns({"_n": n, "_a": F.when(n > 0, g % n), "_k": 3 + g % 8}).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / F.col("_k")))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    made = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda i: F.get(F.col("_words"), place(i)))
    return chosen.select("doc_id", F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op11_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_periods(table(spark, sf_dir, "documents"))).withColumn("_best", strongest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("_best")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"), F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_run_detection": op11_run_detection}

#: Stretches of five words that recur a period later, one after another, are the runs.
ORACLES = {
    "op11_run_detection": r"""
WITH given AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents),
placed AS (SELECT *, len(w)::BIGINT AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM given),
docs_in AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END) + 1]) ELSE w END AS words FROM placed),
grams AS (SELECT rid, n, i, array_to_string(words[i + 1:i + 5], ' ') AS gram FROM (SELECT rid, n, words, unnest(range(n - 4)) AS i FROM docs_in WHERE n >= 6)),
pairs AS (SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND x.gram = y.gram AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
isles AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM pairs),
stretches AS (SELECT rid, q, min(i) AS s, max(i) + 5 + q AS e FROM isles GROUP BY rid, q, isle HAVING max(i) + 5 + q - min(i) >= greatest(6, 4 * q)),
runs AS (SELECT rid, s, e - s AS l, min(q) AS q FROM stretches GROUP BY rid, s, e),
best AS (SELECT rid, s, l, q, row_number() OVER (PARTITION BY rid ORDER BY l::DOUBLE / q DESC, s, q) AS place FROM runs),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM runs),
tokens AS (SELECT rid, unnest(words) AS word, unnest(range(n)) AS i FROM docs_in),
kept AS (SELECT t.rid, string_agg(word, ' ' ORDER BY t.i) AS k FROM tokens t ANTI JOIN gone g ON t.rid = g.rid AND t.i = g.i GROUP BY t.rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s AS start, l AS length, q AS period, (1000 * l) // q AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM docs_in LEFT JOIN listed USING (rid) LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (rid) LEFT JOIN kept USING (rid)
"""
}
