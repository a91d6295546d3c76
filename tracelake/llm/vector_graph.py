"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched by beams.

1. Equal vectors become one node with its smallest vec_ids, as many as a result can show; so thousands of copies make no thousands of edges of length
   nothing. Nodes are spread over shards of about SHARD_NODES by hash, each dimension apart.
2. In a shard, nodes enter the graph in batches that double up to BATCH. A beam search from the entry proposes each node's neighbours; robust pruning takes the nearest, drops
   those that lie nearer to it than to the node by ALPHA, takes the next, up to DEGREE. Edges back are added, and a node with too many is pruned
   again. A second round, over the whole graph, mends what the first nodes could not see. Nodes that no path reaches become entries themselves.
3. The index is a table, a row a shard. Queries meet every shard in blocks: a beam search of width BEAM gives candidates, whose cosines are taken in
   double precision from the vectors as given. The best of all shards are merged.

All valid rows are indexed, none is sampled. Nearness is the cosine; equal ones go by the smaller vec_id. Defined results: rows without vec_id, and vectors that are null, empty, zero
or hold null or non-finite components (or whose squares leave the range of doubles) take no part; equal rows are one; a query is not its own
neighbour under its vec_id; vectors of other dimensions than the query's are not compared; empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, ship_package, table

SHARD_NODES = 4_096
#: Queries of a block; with a shard, one task's work.
QUERIES_A_BLOCK = 4_096
DEGREE, ALPHA = 48, 1.2
#: Candidates of a node when the graph is made, and of a query.
WIDTH, BEAM = 64, 200
BATCH = 512
FIRST = 128
TOP = 5
_INDEX_SQL = "dim int, shard int, nodes binary, edges binary, entries binary, ids array<array<bigint>>"
_FOUND_SQL = "query_id bigint, vec_id bigint, score double"


def prune(x: np.ndarray, node: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each node's candidates (rows of numbers, -1: none), up to `degree` by robust pruning, the nearest first."""
    out = np.full((len(node), degree), -1, dtype=np.int32)
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == node[:, None]] = -1
    there = x[np.maximum(near, 0)]
    gone = np.inf
    far = np.where(near < 0, gone, _distance(there, x[node]))
    rows = np.arange(len(node))
    for k in range(degree):
        best = far.argmin(axis=1)
        good = far[rows, best] < gone
        if not good.any():
            break
        out[good, k] = near[rows, best][good]
        between = _distance(there, there[rows, best])
        far[(alpha * between <= far) & good[:, None]] = gone
        far[rows, best] = gone
    return out


def _distance(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors: rows of vectors against a vector a row."""
    return np.sqrt(np.maximum(2 - 2 * np.matmul(many, one[:, :, None])[:, :, 0], 0))


def beam(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, query: np.ndarray, width: int) -> np.ndarray:
    """The `width` nearest nodes that a walk from the entries finds, for each query; -1 where there are fewer. The walk goes on from the nearest node that it has not left yet."""
    n, rows = len(query), np.arange(len(query))
    seen = np.zeros((n, len(x)), dtype=bool)
    seen[:, entries] = True
    first = _distance(np.broadcast_to(x[entries], (n, len(entries), x.shape[1])), query)
    ids = np.full((n, max(width, len(entries))), -1, dtype=np.int32)
    far = np.full(ids.shape, np.inf)
    ids[:, : len(entries)], far[:, : len(entries)] = entries, first
    by = np.argsort(far, axis=1, kind="stable")[:, :width]
    ids, far = np.take_along_axis(ids, by, 1), np.take_along_axis(far, by, 1)
    left = np.zeros(ids.shape, dtype=bool)
    while len(rows):
        ahead = ~left[rows] & (ids[rows] >= 0)
        at = ahead.argmax(axis=1)  # beams are in order, so the first is the nearest
        more = ahead[np.arange(len(rows)), at]
        rows, at = rows[more], at[more]
        if not len(rows):
            break
        left[rows, at] = True
        near = edges[ids[rows, at]]
        fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[rows[r], near[r, c]] = True
        d = np.where(fresh, _distance(x[np.maximum(near, 0)], query[rows]), np.inf)
        all_far = np.concatenate([far[rows], d], axis=1)
        by = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        far[rows] = np.take_along_axis(all_far, by, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1), by, 1)
        left[rows] = np.take_along_axis(np.concatenate([left[rows], np.zeros(d.shape, dtype=bool)], axis=1), by, 1)
    return ids


def _link(x: np.ndarray, edges: np.ndarray, node: np.ndarray, near: np.ndarray, alpha: float) -> None:
    """Give nodes their pruned neighbours, and those an edge back."""
    mine = prune(x, node, near, edges.shape[1], alpha)
    edges[node] = mine
    r, c = np.nonzero(mine >= 0)
    to, back = mine[r, c], node[r]
    by = np.argsort(to, kind="stable")
    to, back = to[by], back[by]
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    count = np.diff(at, append=len(to))
    have = (edges[to[at]] >= 0).sum(axis=1)
    # Those with room take the edges as they are; the others choose anew, in groups of about the same number of candidates.
    for k in np.flatnonzero(have + count <= edges.shape[1]):
        own = np.setdiff1d(back[at[k] : at[k] + count[k]], edges[to[at[k]]])
        edges[to[at[k]], have[k] : have[k] + len(own)] = own
    full = np.flatnonzero(have + count > edges.shape[1])
    full = full[np.argsort(count[full], kind="stable")]
    while len(full):
        rows = max(1, (BATCH * 64) // int(edges.shape[1] + count[full[-1]]))
        part, full = full[-rows:], full[:-rows]
        cand = np.full((len(part), int(count[part].max())), -1, dtype=np.int32)
        for i, k in enumerate(part):
            cand[i, : count[k]] = back[at[k] : at[k] + count[k]]
        edges[to[at[part]]] = prune(x, to[at[part]], np.concatenate([edges[to[at[part]]], cand], axis=1), edges.shape[1], alpha)


def unit(v: np.ndarray) -> np.ndarray:
    """In doubles: near copies, a ten-thousandth apart, are the same in 2 - 2 cos of single precision."""
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows of numbers, -1: none) and entries of the graph over unit vectors."""
    n = len(x)
    edges = np.full((n, degree), -1, dtype=np.int32)
    order = np.random.default_rng(n).permutation(n).astype(np.int32)
    entry = int((x @ x.mean(axis=0)).argmax())
    order[order == entry], order[0] = order[0], entry
    start = np.array([entry], dtype=np.int32)
    head = order[: min(n, FIRST)]
    _link(x, edges, head, np.tile(head, (len(head), 1)), alpha)
    at = len(head)
    while at < n:
        part = order[at : at + min(at, BATCH)]
        _link(x, edges, part, beam(x, edges, start, x[part], width), alpha)
        at += len(part)
    for at in range(0, n, BATCH):
        part = order[at : at + BATCH]
        _link(x, edges, part, np.concatenate([edges[part], beam(x, edges, start, x[part], width)], axis=1), alpha)
    entries, reached = [entry], np.zeros(n, dtype=bool)
    while True:
        now = np.array(entries[-1:], dtype=np.int32)
        reached[now] = True
        while len(now):
            now = np.unique(edges[now])
            now = now[now >= 0]
            now = now[~reached[now]]
            reached[now] = True
        if reached.all():
            return edges, np.array(entries, dtype=np.int32)
        entries.append(int(np.flatnonzero(~reached)[0]))


def _vectors(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), -1)


def _build(kind: str, degree: int, alpha: float, width: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("least", "ascending")])  # the graph does not depend on the order of the rows
        v = _vectors(rows["vector"], kind)
        edges, entries = graph(unit(v), degree, alpha, width)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "nodes": [v.tobytes()], "edges": [edges.tobytes()], "entries": [entries.tobytes()], "ids": pa.array([rows["ids"].to_pylist()], pa.list_(pa.list_(pa.int64())))})

    return run


def _search(kind: str, degree: int, width: int, top: int):
    def run(key: tuple, shard: pa.Table, asked: pa.Table) -> pa.Table:
        """One shard and one block of queries."""
        out: list[tuple[int, int, float]] = []
        dim = key[0].as_py()
        if len(shard) and len(asked):
            nodes = np.frombuffer(shard["nodes"][0].as_buffer(), dtype=kind).reshape(-1, dim)
            edges = np.frombuffer(shard["edges"][0].as_buffer(), dtype=np.int32).reshape(-1, degree)
            entries, ids = np.frombuffer(shard["entries"][0].as_buffer(), dtype=np.int32), shard["ids"][0].as_py()
            x, query, own = unit(nodes), _vectors(asked["vector"], kind), asked["query_id"].to_pylist()
            nodes = nodes.astype(np.float64)
            norm = np.sqrt((nodes * nodes).sum(axis=1))
            for a in range(0, len(query), BATCH):
                found = beam(x, edges, entries, unit(query[a : a + BATCH]), width)
                for q, mine, v in zip(own[a : a + BATCH], found, query[a : a + BATCH].astype(np.float64)):
                    mine = mine[mine >= 0]
                    score = (nodes[mine] * v).sum(axis=1) / (norm[mine] * np.sqrt((v * v).sum()))
                    best = heapq.nsmallest(top, ((-s, i) for s, m in zip(score.tolist(), mine.tolist()) for i in ids[m] if i != q))
                    out += [(q, i, -s) for s, i in best]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    return run


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, vector, dim of the rows that take part, each once."""
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    # A null component makes the sum null, one that is not finite makes it infinite or NaN.
    good = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & (square > 0) & (square < float("inf"))
    return rows.where(F.coalesce(good, F.lit(False))).distinct().withColumn("dim", F.size("vector"))


class VectorIndex:
    """Graphs over vectors, a row a shard, as a table at a path; without one, a scratch table. top: what a search can ask for at most."""

    def __init__(self, rows: DataFrame, kind: str, degree: int, top: int):
        self.rows, self.kind, self.degree, self.top = rows, kind, degree, top

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None, top: int = TOP, shard_nodes: int = SHARD_NODES, degree: int = DEGREE, alpha: float = ALPHA, width: int = WIDTH) -> VectorIndex:
        ship_package(rows.sparkSession)
        kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
        # Copies: the smallest ids are enough, one more than a result shows, as a query may be among them. Each task keeps no more of a vector before they meet.
        copies = Window.partitionBy("dim", "vector").orderBy("vec_id")
        nodes = valid(rows).withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= top + 1)
        nodes = materialize(nodes.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "graph-nodes")
        shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_nodes).cast("int").alias("_shards"))
        nodes = nodes.join(F.broadcast(shards), "dim")  # a row for each dimension
        nodes = nodes.withColumns({"shard": F.pmod(F.xxhash64("vector"), "_shards").cast("int"), "least": F.get("ids", F.lit(0))})
        made = nodes.select("dim", "shard", "least", "vector", "ids").groupBy("dim", "shard").applyInArrow(_build(kind, degree, alpha, width), _INDEX_SQL)
        if path is None:
            return cls(materialize(made, "graph-index"), kind, degree, top)
        made.withColumn("kind", F.lit(kind)).withColumn("degree", F.lit(degree)).withColumn("top", F.lit(top)).write.parquet(path)
        return cls.open(rows.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(path)
        head = rows.select("kind", "degree", "top").first()
        return cls(rows.drop("kind", "degree", "top"), *(head or ("<f4", DEGREE, TOP)))

    def search(self, queries: DataFrame, top: int | None = None, width: int = BEAM) -> DataFrame:
        """query_id, rank, vec_id, score of the nearest found; queries: vec_id and embedding."""
        ship_package(queries.sparkSession)
        top = self.top if top is None else top
        if top > self.top:
            raise ValueError(f"the index keeps copies for {self.top} neighbours")
        asked = materialize(valid(queries).withColumnRenamed("vec_id", "query_id"), "graph-queries")
        blocks = max(1, math.ceil(asked.count() / QUERIES_A_BLOCK))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int"))
        places = F.broadcast(self.rows.groupBy("dim").agg(F.collect_set("shard").alias("_in")))  # a row for each dimension
        asked = asked.join(places, "dim").withColumn("shard", F.explode("_in")).select("dim", "shard", "block", "query_id", "vector")
        shards = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        by = ("dim", "shard", "block")
        found = shards.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_search(self.kind, self.degree, width, top), _FOUND_SQL)
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

    def drop(self) -> None:
        """Delete the index, if it is a scratch table."""
        drop_scratch(self.rows)


def op13_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return VectorIndex.build(rows).search(rows.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op13_vector_graph": op13_vector_graph}
ORACLES: dict[str, str] = {}
