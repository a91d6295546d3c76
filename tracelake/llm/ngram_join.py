"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

1. The document frequency of every n-gram is counted by hash range; mappers get its magnitude from a table of bounded size (64 MB; where
   n-grams share a slot there, the order is less apt, but the result is exact under any order). The global order is by magnitude, then hash.
2. Of n n-grams in that order the first n - ceil(t n) + 1 are a set's prefix. Those of them that two sets have are list entries.
3. Sets that share prefix n-grams are candidates if their sizes (length filter), the positions of a common n-gram (positional filter) and
   what stands behind it (suffix filter) allow the overlap: an entry carries a bitmap of SUFFIX_BITS hash ranges for the n-grams behind its own, and how
   many more those are than bits; common bits and the smaller surplus bound what two suffixes share. All three are tested inside the join.
   Only connection matters, so a list's sets are compared with pivots, those of the earliest positions: one of each list, then 64, 4,096 and so on. A
   pivot that has met its list leaves it, and pairs that are already connected are never made. Once few pairs are left between
   components (PAIRS_AN_ENTRY a list entry), the rest meet at once.
4. Each candidate pair is verified once: pairs that were tried before are taken out, and the sets of the others are intersected.
5. Components by large-star and small-star steps; every document gets the smallest doc_id of its component.

Equal sets are one node throughout, so copies never meet as pairs. Defined results: null, empty and blank texts have no n-grams and are
linked with nothing; a text of fewer than n words is one n-gram; repeated rows and doc_ids are rows of one node; a null
doc_id has the component's smallest known id, or null; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import drop_scratch, hold, materialize, release, ship_package, small, table
from .repeats import BLOBS_SQL, Levels, count_blobs, find_counts

NGRAM = 4
PERCENT = 85
#: N-grams that a task counts together.
BUFFER = 2 << 20
#: All pairs between components are made when they are at most so many times the list entries.
PAIRS_AN_ENTRY = 2
SUFFIX_BITS = 256
#: Pivots of a list: one in the first round, then so many times as many as in the round before.
PIVOT_GROWTH = 64
#: Documents whose n-grams meet in one hash range.
RANGE_DOCS = 5_000

_FIRST = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("tag", pa.int64())])
_POSTING = pa.schema([("g", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("p", pa.int32()), *[(f"b{i}", pa.int64()) for i in range(SUFFIX_BITS // 64)], ("more", pa.int32())])
_BITS = [f"b{i}" for i in range(SUFFIX_BITS // 64)]
_POSTING_SQL = "g bigint, node bigint, n int, p int, " + ", ".join(f"{b} bigint" for b in _BITS) + ", more int"
_SETS = pa.schema([("node", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _sets(batch: pa.RecordBatch, ngram: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes of each text that has words."""
    data, offsets = B.strings(batch.column("text"))
    for i, j in B.pieces(offsets):
        words, at, _ = B.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        grams = B.FIRST.windows(words, ngram)
        for k in range(j - i):
            a, b = at[k], at[k + 1]
            if b - a >= ngram:
                own = np.sort(grams[a : b - ngram + 1])
                yield i + k, own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield i + k, B.FIRST.spans(B.FIRST.sums(words[a:b]), np.array([0]), np.array([b - a]))


def _node(own: np.ndarray) -> int:
    """Hash of a set."""
    with np.errstate(over="ignore"):
        total = B.mix(own ^ B.U64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + B.U64(len(own))
    return int(B.mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _survey(ngram: int, lower: bool):
    """A document's node and size; no node without n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for row, own in _sets(batch, ngram, lower):
                node[row], n[row] = _node(own), len(own)
            yield pa.record_batch([batch.column("doc_id"), pa.array(node, mask=n == 0), pa.array(n), batch.column("tag")], schema=_FIRST)

    return run


def _distinct(batch: pa.RecordBatch, ngram: int, lower: bool, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Node and set of the sets that this task has not met; it remembers a million."""
    for _, own in _sets(batch, ngram, lower):
        node = _node(own)
        if node not in seen:
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(node)
            yield node, own


def _send_counts(ngram: int, lower: bool, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for _, own in _distinct(batch, ngram, lower, seen):
                held.append(own)
                size += len(own)
                if size > BUFFER:
                    yield from count_blobs(np.concatenate(held), buckets)
                    held, size = [], 0
        if held:
            yield from count_blobs(np.concatenate(held), buckets)

    return run


def least(n, percent: int):
    """ceil(percent / 100 * n)."""
    return (percent * n + 99) // 100


def _suffixes(order: np.ndarray, p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-grams behind each place p of a set in the global order, of which the first `size` are the prefix: bitmap of hash ranges, and how many more there are."""
    part = (B.mix(order) >> B.U64(56)).astype(np.int64) % SUFFIX_BITS
    behind = np.zeros((size, SUFFIX_BITS), dtype=np.int32)
    behind[np.arange(size), part[:size]] = 1
    after = behind[::-1].cumsum(axis=0)[::-1] - behind + np.bincount(part[size:], minlength=SUFFIX_BITS)
    after = after[p]
    bits = after > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8"), (len(order) - 1 - p - bits.sum(axis=1)).astype(np.int32)


def _entries(ngram: int, lower: bool, percent: int, levels: Levels):
    """List entries: the n-grams of each distinct set's prefix that another set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[list] = [[] for _ in _POSTING]
            for node, own in _distinct(batch, ngram, lower, seen):
                n = len(own)
                level = levels(own)
                order = np.argsort(level, kind="stable")
                size = n - least(n, percent) + 1
                p = np.flatnonzero(level[order[:size]])
                if not len(p):
                    continue
                bits, more = _suffixes(own[order], p, size)
                values = (own[order[p]].view(np.int64), np.full(len(p), node, dtype=np.int64), np.full(len(p), n, dtype=np.int32), p.astype(np.int32), *bits.T, more)
                for x, y in zip(out, values):
                    x.append(y)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], schema=_POSTING)

    return run


def _whole_sets(ngram: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            size = 0
            for _, own in _sets(batch, ngram, lower):
                nodes.append(_node(own))
                sets.append(own.view(np.int64))
                size += len(own)
                if size > 1_000_000:
                    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=_SETS)
                    nodes, sets, size = [], [], 0
            if nodes:
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=_SETS)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for the nodes of edges u, v; by alternating large and small stars."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        star = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        star = materialize(star, "edges")
        drop_scratch(now)
        now = star
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _fits(percent: int) -> Column:
    """Length, positional and suffix filter of entries (n, p, ...) and (n2, p2, ...) of one list. The first common n-gram of a similar pair passes:
    before it nothing is common, behind it no more than either has, and no more than the bitmaps of what is behind allow."""
    n, m, p, q = (F.col(c).cast("bigint") for c in ("n", "n2", "p", "p2"))
    need = F.ceil(percent * (n + m) / F.lit(100 + percent))
    common = F.least("more", "more2")
    for b in _BITS:
        common = common + F.bit_count(F.col(b).bitwiseAND(F.col(f"{b}_2")))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (1 + F.least(n - p - 1, m - q - 1) >= need) & (1 + common >= need)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs u, v whose sets have the Jaccard similarity; pairs are distinct."""
    one = sets.select(F.col("node").alias("u"), F.col("grams").alias("_g1"))
    two = sets.select(F.col("node").alias("v"), F.col("grams").alias("_g2"))
    both = pairs.join(one, "u").join(two, "v")
    common = F.size(F.array_intersect("_g1", "_g2"))
    return both.where(100 * common >= percent * (F.size("_g1") + F.size("_g2") - common)).select("u", "v")


def _candidates(some: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Pairs u, v of one of some and one of live, of one list and different components, which pass the filters."""
    names = {"g": "g2", "c": "c2", "node": "node2", "n": "n2", "p": "p2", "more": "more2"} | {b: f"{b}_2" for b in _BITS}
    two = live.select(*[F.col(a).alias(b) for a, b in names.items()])
    met = some.join(two, (F.col("g") == F.col("g2")) & (F.col("node") != F.col("node2")) & (F.col("c") != F.col("c2")) & _fits(percent))
    return met.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()


def _roots(lists: DataFrame, fetch, percent: int) -> DataFrame | None:
    """node, root of all sets that are linked with another; None if there are none. fetch: the sets of given nodes."""
    entries = lists.count()
    live, links, roots, tried, many = lists.withColumn("c", F.col("node")), None, None, None, 1
    while entries:
        by = live.groupBy("g", "c").agg(F.count("*").alias("s")).groupBy("g")
        by = by.agg(((F.sum("s") * F.sum("s") - F.sum(F.col("s") * F.col("s"))) / 2).cast("bigint").alias("cross"), F.sum("s").alias("k")).where("cross > 0")
        by = materialize(by, "cross")
        cross = by.agg(F.sum("cross")).first()[0] or 0
        if not cross:
            break
        live = live.join(small(by.select("g")), "g", "left_semi")
        last = cross <= PAIRS_AN_ENTRY * entries
        if last:
            some = live
        else:
            # The pivots of a list: those of the earliest places, at most one a hash class of its sets, so that no list meets in one task.
            turn = live.withColumn("_k", F.pmod(F.xxhash64("node", F.lit(many)), F.lit(many)))
            some = turn.groupBy("g", "_k").agg(F.min(F.struct("p", "n", *[x for x in live.columns if x not in ("g", "p", "n")])).alias("x"))
            some = materialize(some.select("g", *[F.col("x")[x].alias(x) for x in live.columns if x != "g"]), "pivots")
        pairs = _candidates(some, live, percent)
        if tried is not None:
            pairs = pairs.join(small(tried), ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs")
        found = None
        if not pairs.isEmpty():
            sets = fetch(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct())
            found = materialize(verified(pairs, sets, percent), "links")
            drop_scratch(sets)
            # A linked pair is within a component from now on; only those that were not similar can come again.
            failed = pairs.join(small(found), ["u", "v"], "left_anti")
            tried = materialize(failed if tried is None else tried.unionByName(failed), "tried")
            found = None if found.isEmpty() else found
        if found is not None:
            links = found if links is None else links.unionByName(found)
            roots = materialize(components(links), "roots")
        if last:
            break
        done = some.select(F.col("g").alias("_g"), F.col("node").alias("_p"))
        # A list of two has no pair left once its pivot has met the other; its entries need no component any more.
        live = live.join(small(by.where("k > 2").select("g")), "g", "left_semi")
        live = live.join(small(done), (F.col("g") == F.col("_g")) & (F.col("node") == F.col("_p")), "left_anti")
        if found is not None:
            live = live.drop("c").join(small(roots.withColumnRenamed("node", "_n")), F.col("node") == F.col("_n"), "left").select(*lists.columns, F.coalesce("root", "node").alias("c"))
        live = materialize(live, "live")
        many *= PIVOT_GROWTH
    return roots


def ngram_join(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, and for joining back the component's key (null without n-grams) and the text's hash, for every row of docs."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    whole = tagged.mapInArrow(_survey(ngram, lower), "id bigint, node bigint, n bigint, tag bigint")
    whole = materialize(whole.select(F.col("id").alias("doc_id"), "node", "n", "tag"), "survey")
    buckets = max(16, whole.count() // RANGE_DOCS)
    counts = rows.mapInArrow(_send_counts(ngram, lower, buckets), BLOBS_SQL).groupBy("bucket").applyInArrow(find_counts, BLOBS_SQL)
    levels = Levels(materialize(counts, "counts"), buckets)
    lists = materialize(rows.mapInArrow(_entries(ngram, lower, percent, levels), _POSTING_SQL).distinct(), "lists")

    def fetch(nodes: DataFrame) -> DataFrame:
        """node and grams of at least these nodes; a repeated doc_id brings more, and maybe one twice."""
        ids = whole.join(small(materialize(nodes, "nodes")), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id")).select("_id").distinct()
        needed = rows.join(small(materialize(ids, "ids")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        return materialize(needed.mapInArrow(_whole_sets(ngram, lower), "node bigint, grams array<bigint>"), "sets")

    roots = _roots(lists, fetch, percent)
    by_node = whole.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_id"))
    if roots is not None:
        by_node = by_node.join(small(roots.withColumnRenamed("node", "_n")), F.col("node") == F.col("_n"), "left").select("node", "_id", F.coalesce("root", "node").alias("c"))
    else:
        by_node = by_node.withColumn("c", F.col("node"))
    by_node = materialize(by_node, "members")
    smallest = by_node.groupBy("c").agg(F.min("_id").alias("_least"), F.count("*").alias("_k")).where("_k > 1").drop("_k")
    named = by_node.join(small(smallest.withColumnRenamed("c", "_c")), F.col("c") == F.col("_c"), "left")
    named = named.select(F.col("node").alias("_node"), F.coalesce("_least", "_id").alias("_component"), F.col("c").alias("component"))
    out = whole.join(named, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "component", "tag")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, of each component only the one of the smallest doc_id; texts without n-grams all stay."""
    members = materialize(ngram_join(docs, **options).where("component is not null").select("component", "doc_id", "tag"), "members")
    key = F.struct(F.col("doc_id").alias("id"), "tag")
    best = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), key.alias("key"))).alias("_first"), F.count("*").alias("_k")).where("_k > 1")
    best = materialize(best.select(F.col("component").alias("_c"), F.col("_first.key").alias("_best")), "best")
    rest = members.join(small(best), F.col("component") == F.col("_c")).select(key.alias("_other"), "_best")
    own = F.col("_other").eqNullSafe(F.col("_best"))
    lost = materialize(rest.where(~own).select("_other").distinct(), "lost")
    kept = hold(docs).join(small(lost), F.col("_key").eqNullSafe(F.col("_other")), "left_anti")
    # Repeated rows of the one that stays.
    again = materialize(rest.where(own).groupBy("_other").agg(F.count("*").alias("_k")).where("_k > 1").select("_other"), "again")
    if again.isEmpty():
        return release(kept, docs.columns)
    same = F.col("_key").eqNullSafe(F.col("_other"))
    once = kept.join(small(again), same, "left_semi").dropDuplicates(["_key"])
    return release(kept.join(small(again), same, "left_anti").unionByName(once), docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}

#: From docs_in(rid, doc_id, text): grouped(rid, doc_id, n_shingles, component_id).
COMPONENTS_SQL = r"""
gram_words AS (
  SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM docs_in),
grams AS (
  SELECT DISTINCT rid, array_to_string(words[s:s + 3], ' ') AS g FROM (
    SELECT rid, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS s FROM gram_words WHERE len(words) > 0)),
gram_sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
in_common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
linked AS (
  SELECT x, y FROM in_common JOIN gram_sizes s ON s.rid = x JOIN gram_sizes t ON t.rid = y WHERE 100 * k >= 85 * (s.n + t.n - k)),
arcs AS (SELECT x, y FROM linked UNION SELECT y, x FROM linked),
reach(x, y) AS (SELECT x, y FROM arcs UNION SELECT r.x, a.y FROM reach r JOIN arcs a ON r.y = a.x),
grouped AS (
  SELECT g.rid, g.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(g.doc_id, min(o.doc_id)) AS component_id
  FROM gram_words g LEFT JOIN gram_sizes s USING (rid) LEFT JOIN reach r ON r.x = g.rid LEFT JOIN gram_words o ON o.rid = r.y
  GROUP BY g.rid, g.doc_id, s.n)
"""

ORACLES = {
    "op3_ngram_jaccard": "WITH RECURSIVE docs_in AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),"
    + COMPONENTS_SQL
    + "SELECT doc_id, n_shingles, component_id FROM grouped"
}
