"""Quality classifier: random-indexing word vectors, pooled per document, in a calibrated two-layer network.

1. ``context_sums`` reads every document: each token (hashed to one of ``BUCKETS``) adds the sparse
   random index vectors of its neighbours up to ``WINDOW`` away. Tasks add up what they read and
   pass it on in blocks of buckets, which Spark deals out and streams into sums; the result has a
   fixed size, whatever the corpus.
2. ``fit`` learns from a bounded sample of labelled rows (``SAMPLE`` rows, least hash of the key
   first): pooled mean and deviation of the unit word vectors go through a hidden layer to a
   probability of label 1. A fifth of the sample is set aside to fit the temperature, which divides
   the logit so that probabilities fit outcomes.
3. ``score`` applies the network to every document.

Keys, languages and sources are never inputs. ``held_out`` marks the rows whose labels are not
used: crc32 of the key as text is divisible by ``FOLDS``.

Defined cases: a null text is an empty one and has the score of no words; several labels of one
key count by their mean; null keys and null labels are not learned from; without labels of both
kinds the score is the mean label (one half without any); other columns and repeated rows pass
through; a column named like an output raises ``ValueError``; empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_slices, text_or_empty, word_tokens

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: Buckets in a row of partial sums; tokens counted before they are added up; buckets of words remembered.
BLOCK, COUNTED, REMEMBERED = 32, 1 << 18, 1 << 17
FOLDS, SAMPLE, HIDDEN, EPOCHS, RATE, SEED, CUT = 5, 20_000, 32, 40, 0.01, 11, 0.3


class Buckets(dict):
    """Bucket of a token, remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = value = zlib.crc32(token.encode("utf-8")) % BUCKETS
        return value


def index_vectors() -> np.ndarray:
    """Sparse random index vector of each bucket: ``NONZERO`` entries of 1 or -1; the last row is no token."""
    rng = np.random.default_rng(SEED)
    vectors = np.zeros((BUCKETS + 1, DIM), np.float32)
    places = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    vectors[np.arange(BUCKETS)[:, None], places] = rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))
    return vectors


def add_contexts(sums: np.ndarray, ids: np.ndarray, index: np.ndarray) -> None:
    """Adds the neighbours' index vectors to the sums of each token. Texts stand apart by ``WINDOW`` gaps (``BUCKETS``)."""
    near = np.zeros((len(ids), DIM), np.float32)
    vectors = index[ids]
    for k in range(1, WINDOW + 1):
        near[k:] += vectors[:-k]
        near[:-k] += vectors[k:]
    for d in range(DIM):
        sums[:, d] += np.bincount(ids, weights=near[:, d], minlength=BUCKETS + 1)[:BUCKETS].astype(np.int64)


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vector of every bucket over all documents."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, index = Buckets(), index_vectors()
        sums, waiting = np.zeros((BUCKETS, DIM), np.int64), []
        gap = [BUCKETS] * WINDOW
        for batch in batches:
            for value in batch.column(0).to_pylist():
                waiting += map(bucket.__getitem__, word_tokens(value))
                waiting += gap
                if len(waiting) > COUNTED:
                    add_contexts(sums, np.array(waiting, np.int64), index)
                    waiting = []
        if waiting:
            add_contexts(sums, np.array(waiting, np.int64), index)
        blocks = [sums[i : i + BLOCK].astype("<i8").tobytes() for i in range(0, BUCKETS, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw, "<i8")
                total[block] = total[block] + values if block in total else values
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])

    parts = map_slices(docs.select(text_or_empty(text)), part, "block int, sums binary", 0)
    rows = parts.repartition("block").mapInArrow(add, "block int, sums binary").collect()  # BUCKETS / BLOCK rows
    sums = np.zeros((BUCKETS, DIM), np.int64)
    for row in rows:
        sums[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.sums, "<i8").reshape(-1, DIM)
    return sums


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors, as float32; a bucket without neighbours has none."""
    length = np.sqrt((sums.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (sums / np.maximum(length, 1)).astype(np.float32)


def pooled(tokens: list[str], bucket: Buckets, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors, likeness of neighbours, and the logarithm of the length."""
    if not tokens:
        return np.zeros(2 * DIM + 2, np.float32)
    ids = np.fromiter(map(bucket.__getitem__, tokens), np.int64, len(tokens))
    total, square, alike = np.zeros(DIM), np.zeros(DIM), 0.0
    for start in range(0, len(ids), COUNTED):
        own = vectors[ids[start : start + COUNTED]]
        total += own.sum(axis=0, dtype=np.float64)
        square += np.einsum("ij,ij->j", own, own)
        alike += float(np.einsum("ij,ij->", own[1:], own[:-1]))
    mean = total / len(ids)
    deviation = np.sqrt(np.maximum(square / len(ids) - mean**2, 0))
    return np.concatenate([mean, deviation, [alike / len(ids), np.log1p(len(ids)) / 8]]).astype(np.float32)


@dataclass
class Network:
    """Standardisation, two layers and temperature; or a constant where there is nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Network:
    """Adam on the rows not set aside; then the temperature of least loss on those that are."""
    constant = float(y.mean()) if len(y) else 0.5
    empty = np.zeros(1)
    if not 0 < y[~aside].sum() < (~aside).sum():
        return Network(empty, empty, empty, empty, empty, 0.0, constant=constant)
    rng = np.random.default_rng(SEED)
    learn = np.flatnonzero(~aside)
    mean, scale = x[learn].mean(axis=0, dtype=np.float64), x[learn].std(axis=0, dtype=np.float64) + 1e-6
    net = Network(mean, scale, rng.normal(0, 0.15, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.15, HIDDEN), 0.0)
    z = (x - mean) / scale
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(learn), RATE * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            hidden = np.tanh(z[rows] @ values[0] + values[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, values[2]) * (1 - hidden**2)
            step += 1
            for k, g in enumerate((z[rows].T @ back + 1e-4 * values[0], back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                values[k] = values[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if aside.any():
        logits, truth = net.logits(x[aside]), y[aside]
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in tried]
        net.temperature = float(tried[int(np.argmin(losses))])
    return net


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, key: str, text: str, label: str, sample: int) -> Network:
    """Network from the ``sample`` learned labels of least hash whose documents are in ``docs``."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.avg(label).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(sample)  # at most `sample` rows: a bounded broadcast
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own = Buckets(), shared.value
        for batch in batches:
            rows = [pooled(word_tokens(t), bucket, own).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.binary())], names=["part", "y", "x"])

    joined = docs.join(F.broadcast(chosen), F.col(key) == F.col("_key"))
    part = (F.floor(F.crc32(F.col("_key").cast("string")) / FOLDS) % 5).cast("int").alias("part")
    rows = map_slices(joined.select(part, F.col("_y").alias("y"), text_or_empty(text)), pool, "part int, y double, x binary", 2)
    got = sorted(tuple(r) for r in rows.orderBy(F.xxhash64("x"), "y").limit(sample).collect())  # repeated keys don't pass the bound
    x = np.array([np.frombuffer(r[2], np.float32) for r in got], np.float32).reshape(len(got), 2 * DIM + 2)
    return train(x, np.array([r[1] for r in got], np.float64), np.array([r[0] == 0 for r in got], bool))


def score(docs: DataFrame, network: Network, vectors: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with the column ``score``."""
    names, at = [*docs.columns, "score"], docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((network, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, (net, own) = Buckets(), shared.value
        for batch in batches:
            x = np.array([pooled(word_tokens(t or ""), bucket, own) for t in batch.column(at).to_pylist()], np.float32).reshape(-1, 2 * DIM + 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(net.probability(x), pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_slices(docs, run, f"{schema}, score double", at)


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE
) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if the score is at least ``CUT``)."""
    if {"held_out", "score", "predicted", "_key", "_y"} & set(docs.columns):
        raise ValueError("the columns held_out, score, predicted, _key and _y are the operator's")
    vectors = word_vectors(context_sums(docs, text))
    network = fit(docs, labels, vectors, key, text, label, sample)
    return score(docs, network, vectors, text).withColumns({"held_out": held_out(key), "predicted": (F.col("score") >= CUT).cast("int")})
