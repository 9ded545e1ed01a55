"""Operator 10, quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Random indexing: every word has a sparse random vector, drawn from its hash; a word's vector is the sum of the
random vectors of its neighbours over the whole corpus. Words, and word shapes (last three bytes, case), are
hashed into ``BUCKETS`` rows each, so the table has one size whatever the corpus; tasks stream their sums into
it and one pass adds them up. Documents are pooled to the mean vectors of their words and shapes, the share of
words that repeat the one before, the norm of the mean random vector, and the log of the word count.

The network (one hidden layer) is fitted with numpy on at most ``MAX_TRAIN`` labelled rows, those with the smallest
hashes of doc_id; a fifth of them sets the temperature of the probabilities. Only rows with crc32(doc_id)
mod 5 <> 0 are learned from. Scoring is one pass over all documents.

Defined cases: null or blank text is scored from zero vectors; a document without label is scored like
any other; equal rows get equal scores; without labels of both kinds every score is the share of label
1 (0.5 without labels); other columns are not carried; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_VALUES, U64, mix, prefix_hash, spans_hash, text_pieces, word_spans
from .scratch import partitions

BUCKETS, DIM, NONZERO = 1 << 13, 32, 2
CHUNKS = 16
MAX_TRAIN = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 40, 0.003, 1e-4
THRESHOLD = 0.3


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, shape hash, row) of each word; case counts."""
    starts, ends, rows = word_spans(data, offsets)
    prefix = prefix_hash(data, BYTE_VALUES)
    words = spans_hash(prefix, starts, ends)
    shape = spans_hash(prefix, np.maximum(starts, ends - 3), ends)
    if len(starts):
        upper = (data[starts] >= 65) & (data[starts] <= 90)
        second = data[np.minimum(starts + 1, ends - 1)]
        shape = mix(shape + upper.astype(U64) + U64(2) * ((second >= 65) & (second <= 90)).astype(U64))
    return words, shape, rows


def _slots(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-th non-zero place of the random vectors, and its sign."""
    h = hashes >> U64(16 * k + 20)
    return (h & U64(DIM - 1)).astype(np.int64), np.where(h >> U64(5) & U64(1), 1.0, -1.0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(2 * BUCKETS * DIM)
    for _, data, offsets in text_pieces(batches):
        words, shape, rows = _tokens(data, offsets)
        near = rows[1:] == rows[:-1]
        for own, base in ((words, 0), (shape, BUCKETS)):
            bucket = (base + (own & U64(BUCKETS - 1)).astype(np.int64)) * DIM
            for k in range(NONZERO):
                slot, sign = _slots(words, k)
                for to, of in ((bucket[1:], (slot[:-1], sign[:-1])), (bucket[:-1], (slot[1:], sign[1:]))):
                    table += np.bincount((to + of[0])[near], of[1][near], len(table))
    parts = table.astype(np.float64).reshape(CHUNKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(sums.as_buffer(), np.float64)
            total[chunk] = total[chunk] + part if chunk in total else part.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of unit vectors: BUCKETS rows of words, then BUCKETS rows of shapes. 2 MB for any corpus."""
    schema, groups = "chunk int, sums binary", partitions(docs.sparkSession)
    parts = docs.select("text").mapInArrow(_contexts, schema)
    # In two levels, so that no task reads the table of every scan task: first one sum a chunk and group of tasks.
    parts = parts.repartition(groups, "chunk", F.spark_partition_id() % groups).mapInArrow(_add_up, schema)
    sums = parts.repartitionById(CHUNKS, F.col("chunk")).mapInArrow(_add_up, schema)
    table = np.zeros((CHUNKS, 2 * BUCKETS * DIM // CHUNKS))
    for r in sums.collect():
        table[r["chunk"]] = np.frombuffer(r["sums"])
    table = table.reshape(2 * BUCKETS, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


N_FEATURES = 2 * DIM + 3


def _features(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    words, shape, rows = _tokens(data, offsets)
    if not len(words):
        return out
    count = np.bincount(rows, minlength=n)
    full = np.flatnonzero(count)
    first = (np.cumsum(count) - count)[full]
    per = count[full, None]
    out[full, :DIM] = np.add.reduceat(table[(words & U64(BUCKETS - 1)).astype(np.int64)], first) / per
    out[full, DIM : 2 * DIM] = np.add.reduceat(table[BUCKETS + (shape & U64(BUCKETS - 1)).astype(np.int64)], first) / per
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    out[:, 2 * DIM] = np.bincount(rows, again, n) / np.maximum(count, 1)
    mean = np.zeros(n * DIM)
    for k in range(NONZERO):
        slot, sign = _slots(words, k)
        mean += np.bincount(rows * DIM + slot, sign, n * DIM)
    out[:, 2 * DIM + 1] = np.linalg.norm(mean.reshape(n, DIM), axis=1) / np.maximum(count, 1)
    out[:, 2 * DIM + 2] = np.log1p(count)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights of the network, its input scaling and temperature."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 10 or share in (0.0, 1.0):
        return {"share": share}
    rng = np.random.default_rng(10)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            h = np.maximum(z[batch] @ p[0] + p[1], 0)
            d = (_sigmoid(h @ p[2] + p[3]) - y[batch]) / len(batch)
            back = np.outer(d, p[2]) * (h > 0)
            step += 1
            for i, g in enumerate((z[batch].T @ back, back.sum(axis=0), h.T @ d, d.sum(keepdims=True))):
                g = g + DECAY * p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logits = np.maximum(z[held] @ p[0] + p[1], 0) @ p[2] + p[3]

    def loss(t: float) -> float:
        q = np.clip(_sigmoid(logits / t), 1e-9, 1 - 1e-9)
        return float(-(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)).mean())

    return {"mean": mean, "scale": scale, "p": p, "temperature": min(np.geomspace(0.25, 8, 60).tolist(), key=loss)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "share" in model:
        return np.full(len(x), model["share"])
    p = model["p"]
    h = np.maximum((x - model["mean"]) / model["scale"] @ p[0] + p[1], 0)
    return _sigmoid((h @ p[2] + p[3]) / model["temperature"])


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, max_train: int = MAX_TRAIN) -> dict:
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    # Bounded by max_train.
    chosen = labels.filter(learn & F.col("quality").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_pieces(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([f.tobytes() for f in _features(data, offsets, table)], pa.binary())], names=["doc_id", "quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(len(rows), N_FEATURES)
    return fit(x, np.array([r["quality"] for r in rows], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = word_vectors(docs)
    model = train(docs, labels, table, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_pieces(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(predict(model, _features(data, offsets, table)), pa.float64())], names=["doc_id", "score"])

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return docs.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
