"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of the text is read. A byte is an embedding of 4 learned numbers and a mark, made and not learned, whether its 4 bytes came less than 17 bytes
before too. Filters of 16 bytes move in steps of 8; a chunk is 512 bytes, chunks overlap by half and cover the whole document. A chunk's
feature is a filter's mean response in it, the document's is the largest over its chunks, and a logistic unit combines them.
No label, language, source or doc_id enters a score.

Training is on the driver, on a sample of labelled rows bounded by SAMPLE documents and SAMPLE_BYTES bytes a class, of whole texts of any length, rows
with crc32(doc_id) mod 3 = 1 held out; the sample is the lowest by hash, so it does not depend on partitions. A text that the bytes left do not hold is passed over.
Scoring is a map over pieces of text in bounded memory. Defined results: null and empty texts have one empty chunk and so a score; repeated rows score alike;
without labelled rows of both classes the score is 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import ship_package, table

EMBEDDING = 4
CHANNELS = EMBEDDING + 1
WIDTH, STRIDE = 16, 8
FILTERS = 16
#: Positions of half a chunk: 256 bytes.
HALF = 32
LAGS = range(3, 17)
SAMPLE = 1_000
SAMPLE_BYTES = 4 << 20
#: Texts and bytes of one step of training.
STEP, STEP_BYTES = 32, 1 << 20
EPOCHS = 6
#: Bytes that are scored at a time.
PIECE = 1 << 20
FOLDS, HELD_OUT = 3, 1


@dataclass
class Network:
    embedding: np.ndarray  # 257 x EMBEDDING; the last row is padding
    filters: np.ndarray  # WIDTH * CHANNELS x FILTERS
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        e = r.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32)
        e[256] = 0
        return cls(e, r.normal(0, 0.15, (WIDTH * CHANNELS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weight]


@dataclass
class Layout:
    """Where the texts of a piece stand among padded bytes, positions, half chunks and chunks."""

    bytes: np.ndarray
    again: np.ndarray
    place: np.ndarray  # first byte of each position
    half_starts: np.ndarray
    half_counts: np.ndarray
    chunk_first: np.ndarray  # half chunks of each chunk: first, and second or the same
    chunk_second: np.ndarray
    doc_chunks: np.ndarray  # first chunk of each text


def lay_out(data: np.ndarray, offsets: np.ndarray) -> Layout:
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-np.maximum(sizes - WIDTH, 0) // STRIDE) + 1)  # positions of each text
    room = count * STRIDE + WIDTH + max(LAGS)  # no mark reaches back into another text
    at = np.cumsum(room) - room
    padded = np.full(int(room.sum()) + WIDTH, 256, dtype=np.int16)
    padded[np.arange(len(data)) + np.repeat(at - offsets[:-1], sizes)] = data
    four = padded.astype(np.int64)
    four[:-3] |= (four[1:-2] & 511) << 9 | (four[2:-1] & 511) << 18 | four[3:] << 27
    again = np.zeros(len(padded), dtype=bool)
    for lag in LAGS:
        again[lag:] |= four[lag:] == four[:-lag]
    again &= padded < 256
    # Positions of a text are its own; between texts no position begins.
    first = np.cumsum(count) - count
    halves = -(-count // HALF)
    half_at = np.cumsum(halves) - halves
    within = B.ragged(np.zeros(len(count), dtype=np.int64), halves)
    half_starts = np.repeat(first, halves) + within * HALF
    half_counts = np.minimum(HALF, np.repeat(count, halves) - within * HALF)
    chunks = np.maximum(1, halves - 1)
    chunk_first = B.ragged(half_at, chunks)
    chunk_second = np.minimum(chunk_first + 1, np.repeat(half_at + halves - 1, chunks))
    place = np.repeat(at, count) + B.ragged(np.zeros(len(count), dtype=np.int64), count) * STRIDE
    return Layout(padded, again, place, half_starts, half_counts, chunk_first, chunk_second, np.cumsum(chunks) - chunks)


def windows(net: Network, x: Layout) -> np.ndarray:
    """The inputs of all positions: a row of WIDTH * CHANNELS numbers each."""
    channels = np.empty((len(x.bytes), CHANNELS), dtype=np.float32)
    channels[:, :EMBEDDING] = net.embedding[x.bytes]
    channels[:, EMBEDDING] = x.again
    view = np.lib.stride_tricks.sliding_window_view(channels.reshape(-1), WIDTH * CHANNELS)
    return view[x.place * CHANNELS]


def features(net: Network, x: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document features, and for training: inputs, responses, chunk means."""
    inputs = windows(net, x)
    response = np.maximum(inputs @ net.filters + net.bias, 0)
    half = np.add.reduceat(response, x.half_starts, axis=0)
    two = x.chunk_first != x.chunk_second
    total = half[x.chunk_first] + half[x.chunk_second] * two[:, None]
    means = total / (x.half_counts[x.chunk_first] + x.half_counts[x.chunk_second] * two)[:, None]
    return np.maximum.reduceat(means, x.doc_chunks, axis=0), inputs, response, means


def probability(net: Network, found: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(found @ net.weight + net.offset, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the logistic loss, classes weighed alike."""
    net = Network.fresh(seed)
    good = labels == 1
    if not good.any() or good.all():
        return net
    r = np.random.default_rng(seed)
    share = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in [*net.parameters(), np.zeros(1, np.float32)]]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for mine in _steps(order, texts):
            data = np.frombuffer(b"".join(texts[k] for k in mine), dtype=np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in mine])])
            x = lay_out(data, offsets)
            found, inputs, response, means = features(net, x)
            delta = ((probability(net, found) - labels[mine]) * share[mine] / len(mine)).astype(np.float32)
            grads: list[np.ndarray] = [None, None, None, found.T @ delta + 1e-4 * net.weight, np.array([delta.sum()], np.float32)]
            # Through the largest chunk of each filter to the positions in it.
            back = np.zeros_like(response)
            ends = np.concatenate([x.doc_chunks[1:], [len(means)]])
            for d, (a, b) in enumerate(zip(x.doc_chunks, ends)):
                top = a + means[a:b].argmax(axis=0)
                for f, c in enumerate(top.tolist()):
                    p, q = x.chunk_first[c], x.chunk_second[c]
                    s, e = x.half_starts[p], x.half_starts[q] + x.half_counts[q]
                    back[s:e, f] += delta[d] * net.weight[f] / (e - s)
            if step == 0:  # the weights start at zero: let the first steps find a direction
                net.weight[:] = r.normal(0, 0.3, FILTERS)
            back *= response > 0
            grads[1], grads[2] = inputs.T @ back, back.sum(axis=0)
            down = (back @ net.filters.T).reshape(-1, WIDTH, CHANNELS)
            which = x.bytes[x.place[:, None] + np.arange(WIDTH)].ravel()
            grads[0] = np.stack([np.bincount(which, weights=down[:, :, c].ravel(), minlength=257) for c in range(EMBEDDING)], axis=1).astype(np.float32)
            grads[0][256] = 0
            step += 1
            rate = 0.01 * min(1, step / 20)
            offset = np.array([net.offset], np.float32)
            for p, g, (m, v) in zip([*net.parameters(), offset], grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.offset = float(offset[0])
    return net


def _steps(order: np.ndarray, texts: list[bytes]) -> Iterator[np.ndarray]:
    mine, size = [], 0
    for k in order.tolist():
        if mine and (len(mine) == STEP or size + len(texts[k]) > STEP_BYTES):
            yield np.array(mine)
            mine, size = [], 0
        mine.append(k)
        size += len(texts[k])
    if mine:
        yield np.array(mine)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most `most` labelled texts and `most_bytes` bytes of each class, none of the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_label"))
    order = F.xxhash64(F.col("_id"), F.lit(5))
    chosen = known.where("_label = 0").orderBy(order, "_id").limit(most).unionByName(known.where("_label = 1").orderBy(order, "_id").limit(most))
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sizes = own.select("doc_id", F.octet_length("text").alias("_n")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    left, ids = {0: most_bytes, 1: most_bytes}, []
    for r in sizes.groupBy("_id", "_label").agg(F.max("_n").alias("_n")).orderBy(order, "_id").collect():
        if r["_n"] <= left[r["_label"]]:
            left[r["_label"]] -= r["_n"]
            ids.append((r["_id"], r["_label"]))
    picked = docs.sparkSession.createDataFrame(ids, "_id long, _label int")
    rows = own.join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label")).orderBy("_id").toArrow()
    return [x.encode() for x in rows.column("text").to_pylist()], rows.column("_label").to_numpy().astype(np.float32)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            data, offsets = B.strings(batch.column("text"))
            out = np.empty(batch.num_rows)
            for i, j in B.pieces(offsets, PIECE):
                own = offsets[i : j + 1] - offsets[i]
                out[i:j] = _scores(net, data[offsets[i] : offsets[j]], own)
            yield pa.record_batch([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return run


def _scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of a piece; one long text is taken by segments of whole chunks, with the bytes around them, whose features' largest are its own."""
    step = STRIDE * HALF
    if len(offsets) == 2 and len(data) > 2 * PIECE:
        positions = -(-(len(data) - WIDTH) // STRIDE) + 1
        chunks, many = -(-positions // HALF) - 1, PIECE // step
        found = []
        for first in range(0, chunks, many):
            # Half a chunk before tells which bytes came before; what follows the last chunk completes its window and marks.
            before, count = min(first, 1), min(many, chunks - first)
            part = data[(first - before) * step : (first + count + 1) * step + WIDTH if first + count < chunks else len(data)]
            found.append(features(net, lay_out(part, np.array([0, len(part)])))[3][before : before + count].max(axis=0))
        return probability(net, np.max(found, axis=0)[None])
    return probability(net, features(net, lay_out(data, offsets))[0])


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    spark = docs.sparkSession
    ship_package(spark)
    texts, marks = sample(docs, labels, most)
    shared = spark.sparkContext.broadcast(train(texts, marks, epochs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(shared), "doc_id bigint, score double")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return scored.select("doc_id", (fold == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}

#: A trained network has no SQL; tests hold it to held-out accuracy and to a plain forward pass.
ORACLES: dict[str, str] = {}
