"""Sharding by k-d tree partitioning: leaves of near equal bytes.

The unit is a group of equal texts, which stays in one shard. Groups are points in the metadata dimensions
(log of the size, source, language); the tree splits every node along its widest dimension at
the distributed weighted quantile that gives each side the bytes its leaves still have room for - the weighted
median while the sides' room is equal - until leaves have the target bytes. A group heavier than a small part of a
leaf is first put into the emptiest shard, and takes that much of its room: such groups are at most
shards * HEAVY_PARTS, so the driver may hold them. A quantile is found digit by digit of a 52-bit rank (20 bits of
the dimension, 32 of a hash, so ties split too) for all nodes of a level at once: weights are summed by node and digit first, so what
is put in order are at most 8,192 sums a node, and the driver sees one row a node.

Law `bytes`. Defined results: null text has no bytes and size 1, and null texts are one group apart from empty
ones; crc32 of null is 0. Repeated rows get slots of their own. An empty table gives an empty result. Metadata
columns that are absent or null count as null. Only DataFrame operations run on the main path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small, table

SHARDS = 16
#: A group of more than 1 / HEAVY_PARTS of a leaf's bytes is placed before the tree.
HEAVY_PARTS = 64
DIGIT_BITS, DIGITS = 13, 4
VALUE_BITS, HASH_BITS = 20, 32
#: Rows of one shard that one task numbers.
SLOT_ROWS = 20_000
DIMENSIONS = ("size", "source", "lang")


def _groups(docs: DataFrame) -> DataFrame:
    """A row for each text: key, weight in bytes, rows, and its place in each dimension, 0 to 1."""
    own = {c.lower(): c for c in docs.columns}
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)

    def category(name: str) -> Column:
        col = F.col(own[name]).cast("string") if name in own else F.lit(None).cast("string")
        return F.coalesce(F.crc32(col.cast("binary")) / float(1 << 32), F.lit(0.0))

    rows = docs.select(
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(F.col("text").cast("binary"))).alias("key"),
        size.cast("bigint").alias("size"),
        (F.log2(size.cast("double")) / 48.0).alias("d0"), category("source").alias("d1"), category("lang").alias("d2"),
    )
    return rows.groupBy("key").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("d0").alias("d0"), F.min("d1").alias("d1"), F.min("d2").alias("d2"))


def _room(total: int, heavy: list[tuple[str, int]], shards: int) -> tuple[dict[str, int], list[float]]:
    """Shards of the heavy groups, the heaviest first into the emptiest; the room that is left in each shard."""
    load, at = [0] * shards, {}
    for key, w in heavy:
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += w
        at[key] = s
    rest = total - sum(load)
    # Fill the emptiest shards to one level.
    level, n, ordered = 0.0, 0, sorted(load)
    for n in range(1, shards + 1):
        level = (rest + sum(ordered[:n])) / n
        if n == shards or level <= ordered[n]:
            break
    return at, [max(0.0, level - x) for x in load]


def _wide(node: DataFrame) -> DataFrame:
    """The widest dimension of every node."""
    spans = [F.max(f"d{i}") - F.min(f"d{i}") for i in range(len(DIMENSIONS))]
    found = node.groupBy("node").agg(*[s.alias(f"s{i}") for i, s in enumerate(spans)], *[F.min(f"d{i}").alias(f"lo{i}") for i in range(len(DIMENSIONS))])
    return found


def _digit(rank: Column, k: int) -> Column:
    return F.shiftright(rank, DIGIT_BITS * (DIGITS - 1 - k)).bitwiseAND((1 << DIGIT_BITS) - 1)


def _by_node(values: dict[int, object], kind: str) -> Column:
    """A literal for each node; nodes are fewer than shards."""
    if not values:
        return F.lit(None).cast(kind)
    return F.element_at(F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v).cast(kind))]), F.col("node"))


def tree(groups: DataFrame, room: list[float]) -> DataFrame:
    """groups (key, w, d0..) with the column node: the leaf, 0 to len(room) - 1."""
    shards = len(room)
    span = {1: (0, shards)}  # the leaves of each node; node n has the children 2n and 2n + 1
    leaf: dict[int, int] = {}
    points = groups.withColumn("node", F.lit(1)).withColumn("h", F.shiftrightunsigned(F.xxhash64("key"), 64 - HASH_BITS))
    steps: list[DataFrame] = []
    while span:
        for n in [n for n, (a, b) in span.items() if b - a == 1]:
            leaf[n] = span.pop(n)[0]
        if not span:
            break
        inner = points.where(F.col("node").isin(list(span)))
        dim, low, wide = {}, {}, {}
        for r in _wide(inner).collect():
            best = max(range(len(DIMENSIONS)), key=lambda i: (r[f"s{i}"], -i))
            dim[r["node"]], low[r["node"]], wide[r["node"]] = best, r[f"lo{best}"], r[f"s{best}"] or 1.0
        value = F.element_at(F.array(*[F.col(f"d{i}") for i in range(len(DIMENSIONS))]), _by_node(dim, "int") + 1)
        scaled = F.floor((value - _by_node(low, "double")) / _by_node(wide, "double") * ((1 << VALUE_BITS) - 1))
        rank = F.when(F.col("node").isin(list(span)), F.shiftleft(scaled.cast("bigint"), HASH_BITS).bitwiseOR(F.col("h")))
        points = points.withColumn("rank", rank)
        # Weight that belongs to the left of each node: in proportion to the room of its leaves.
        left = {n: sum(room[a : (a + b) // 2]) / (sum(room[a:b]) or 1.0) for n, (a, b) in span.items()}
        prefix, before = dict.fromkeys(dim, 0), dict.fromkeys(dim, 0)
        goal: dict[int, float] = {}
        for k in range(DIGITS):
            here = points.where(F.col("node").isin(list(dim)))
            if k:
                here = here.where(F.shiftright("rank", DIGIT_BITS * (DIGITS - k)) == _by_node(prefix, "bigint"))
            bins = here.groupBy("node", _digit(F.col("rank"), k).alias("digit")).agg(F.sum("w").alias("w"))
            up = Window.partitionBy("node").orderBy("digit")
            bins = bins.withColumn("end", F.sum("w").over(up)).withColumn("all", F.sum("w").over(Window.partitionBy("node")))
            need = F.col("all") * _by_node(left, "double") if k == 0 else _by_node({n: goal[n] - before[n] for n in dim}, "double")
            # The first bin whose end reaches the need, or the last: a row a node.
            reach = bins.withColumn("need", need).where((F.col("end") >= F.col("need")) | (F.col("end") == F.col("all")))
            for r in reach.groupBy("node").agg(F.min(F.struct("digit", "end", "w", "all")).alias("x")).collect():
                n = r["node"]
                if k == 0:
                    goal[n] = r["x"]["all"] * left[n]
                prefix[n] = (prefix[n] << DIGIT_BITS) | r["x"]["digit"]
                before[n] += r["x"]["end"] - r["x"]["w"]
        # At the last digit the bin is one rank; it goes to the side that it lies on by half.
        at = points.where(F.col("rank") == _by_node(prefix, "bigint")).groupBy("node").agg(F.sum("w").alias("w")).collect() if prefix else []
        cut = {r["node"]: prefix[r["node"]] + (1 if before[r["node"]] + r["w"] / 2 <= goal[r["node"]] else 0) for r in at}
        side = F.when(F.col("rank") < _by_node(cut, "bigint"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
        points = points.withColumn("node", F.when(F.col("rank").isNull(), F.col("node")).otherwise(side).cast("int")).drop("rank")
        points = materialize(points, "kd-level")
        steps.append(points)
        span = {c: part for n, (a, b) in span.items() for c, part in ((2 * n, (a, (a + b) // 2)), (2 * n + 1, ((a + b) // 2, b)))}
    return points.withColumn("shard", _by_node(leaf, "int")).select("key", "shard")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    groups = materialize(_groups(docs), "kd-groups")
    total = groups.agg(F.sum("w")).first()[0] or 0
    most = total / (shards * HEAVY_PARTS)
    heavy = [(r["key"], r["w"]) for r in groups.where(F.col("w") > most).orderBy(F.desc("w"), "key").select("key", "w").collect()] if total else []
    placed, room = _room(total, heavy, shards)
    spark = docs.sparkSession
    fixed = F.broadcast(spark.createDataFrame([(k, s) for k, s in placed.items()], "key string, shard int"))
    light = groups.join(fixed.select("key"), "key", "left_anti")
    where = materialize(tree(light, room).unionByName(fixed), "kd-shards")
    # Groups of many rows (copies, null texts) are at most 2 * shards * HEAVY_PARTS: their rows meet their shard by broadcast, all others by key.
    many = groups.agg(F.sum("n")).first()[0] or 0
    hot = where.join(F.broadcast(groups.where((F.col("w") > most) | (F.col("n") > many / (shards * HEAVY_PARTS))).select("key")), "key")
    hot = materialize(hot.select(F.col("key").alias("_hot"), F.col("shard").alias("_hot_shard")), "kd-hot")

    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size")
    key = F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(F.col("text").cast("binary"))).alias("key")
    rows = docs.select("doc_id", size, F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"), key)
    rows = rows.join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left")
    # Rows that have their shard go anywhere: their keys match none.
    rows = rows.withColumn("key", F.when(F.col("_hot").isNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", "text_crc32").cast("string"))))
    rows = rows.join(small(where), "key", "left").withColumn("shard", F.coalesce("_hot_shard", "shard"))
    rows = materialize(rows.select("doc_id", "size", "text_crc32", "shard"), "kd-rows")
    # Slots: rows of a shard fall into bins by hash, bins into order; a bin is numbered by one task.
    bins = max(1, rows.count() // (shards * SLOT_ROWS) * 2)
    rows = rows.withColumn("_bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(bins)).cast("int"))
    start = rows.groupBy("shard", "_bin").agg(F.count("*").alias("_n"))
    start = start.withColumn("_start", F.sum("_n").over(Window.partitionBy("shard").orderBy("_bin")) - F.col("_n")).drop("_n")
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("shard", "_bin").orderBy("doc_id", "text_crc32", "size")) - 1)
    rows = rows.join(small(start), ["shard", "_bin"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_start") + F.col("_i")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sharding": op5_sharding}

#: A tree of weighted quantiles over nodes found level by level has no practical SQL; tests hold its leaves to a tree built by sorting.
ORACLES: dict[str, str] = {}
