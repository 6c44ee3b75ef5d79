"""Toxicity: cumulative-link ordinal regression on sparse features: words and their beginnings.

The severity of a document is a grade from 0 (clean) to ``GRADES - 1``. Labels only tell toxic from
clean, so grades of toxic rows are learned from the rows themselves: features whose odds are at
least ``LIFT`` times higher in toxic rows are markers, and toxic rows are graded 1, 2, ... by thirds of
their number of markers.

The regression has one weight for each chosen feature, shared by all thresholds, and ordered
thresholds: P(grade <= k) = sigmoid(threshold_k - w x), where x is 1 + log(frequency) of each feature present.
The result is the expected grade, the probability that the grade is not 0, and whether that is at
least ``CUT``.

It is fitted on a bounded sample of labelled rows (``SAMPLE``, least hash of the key first, at most
``SAMPLE_WORDS`` distinct words each, again those of least hash); rows whose key's crc32 is
divisible by ``FOLDS`` are never learned from. Every document is scored over its whole text.

Defined cases: a null text is an empty one; several labels of one key count as toxic if any is;
null keys and labels are not learned from; without labels of both kinds nothing is toxic; other
columns and repeated rows pass through; a column named like an output raises ``ValueError``; empty
tables give empty tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import kept, map_slices, text_or_empty
from lodestone.llm.quality import held_out

GRADES, LIFT, LEAST_ROWS, CUT = 4, 3.0, 5, 0.5
SAMPLE, FEATURES, STEPS, RATE, SHRINK = 10_000, 20_000, 400, 0.1, 1e-5
PREFIXES = (4, 5, 6)
REMEMBERED = 1 << 17
WORDS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word and its beginnings, which insults of one stem share."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def frequencies(text: str) -> Counter:
    """Frequencies of the features of a text."""
    found: Counter = Counter()
    for word, n in Counter(WORDS.findall(text.lower())).items():
        for feature in features(word):
            found[feature] += n
    return found


def strength(count):
    """What a feature counts for: one, and the logarithm of its frequency."""
    return 1 + np.log(count)


@dataclass
class Ordinal:
    """Weights by the hash of a feature, and ordered thresholds between the grades."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def above(self, totals: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - totals[:, None], -40, 40)))


class Remembered(dict):
    """Hashes of a word's weighted features, remembered; most words have none."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        hashes = map(xxhash.xxh64_intdigest, features(word))
        self[word] = value = tuple(h for h in hashes if h in self.weights)
        return value

    def total(self, text: str) -> float:
        found = Counter(h for hashes in map(self.__getitem__, WORDS.findall(text.lower())) if hashes for h in hashes)
        return float(sum(self.weights[h] * strength(n) for h, n in sorted(found.items())))


def grade(markers: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of rows from their numbers of markers."""
    edges = np.quantile(markers[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic, 1 + (markers[:, None] > edges[None, :]).sum(axis=1), 0)


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least loss, by Adam over all rows. Thresholds are a first one and positive steps."""
    steps = np.full(GRADES - 1, 0.5)
    steps[0] = 1.0
    params = [np.zeros(width), steps]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n, ks = len(grades), np.arange(GRADES - 1)
    for t in range(1, STEPS + 1):
        weights, steps = params
        thresholds = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
        totals = np.bincount(row, weights=value * weights[column], minlength=n)
        up_to = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - totals[:, None], -30, 30)))
        padded = np.concatenate([np.zeros((n, 1)), up_to, np.ones((n, 1))], axis=1)
        p = np.maximum(padded[np.arange(n), grades + 1] - padded[np.arange(n), grades], 1e-12)
        slope = up_to * (1 - up_to)
        by_threshold = ((ks[None, :] == grades[:, None] - 1).astype(float) - (ks[None, :] == grades[:, None])) * slope / p[:, None] / n
        by_total = -by_threshold.sum(axis=1)
        on_weights = np.bincount(column, weights=value * by_total[row], minlength=width) + SHRINK * weights
        tail = np.cumsum(by_threshold.sum(axis=0)[::-1])[::-1]
        on_steps = np.concatenate([tail[:1], tail[1:] * np.exp(steps[1:])])
        for k, g in enumerate((on_weights, on_steps)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return params[0], np.cumsum(np.concatenate([params[1][:1], np.exp(params[1][1:])]))


def train(chosen: np.ndarray, marker: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> Ordinal:
    """Regression on rows of (positions in ``chosen``, frequencies)."""
    if not len(chosen) or not 0 < toxic.sum() < len(toxic):
        return Ordinal({}, np.full(GRADES - 1, 30.0))
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    column, count = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    grades = grade(np.bincount(row, weights=count * marker[column], minlength=len(rows)), toxic)
    weights, thresholds = fit_ordinal(row, column, strength(count), grades, len(chosen))
    return Ordinal(dict(zip(chosen.view(np.uint64).tolist(), weights.tolist(), strict=True)), thresholds)


def select(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of uneven odds in (y, words) and, beside them, whether they are markers; at most ``most``, sorted."""
    n = rows.agg(F.coalesce(F.count_if("y"), F.lit(0)), F.count("*")).first()
    bad, every = F.col("bad"), F.col("every")
    shares = {"toxic": (bad + 0.5) / (n[0] + 1), "clean": (every - bad + 0.5) / (n[1] - n[0] + 1)}
    counted = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("y").alias("bad"), F.count("*").alias("every"))
    marker = (F.col("toxic") >= LIFT * F.col("clean")) & (bad >= LEAST_ROWS)
    other = (F.col("clean") >= LIFT * F.col("toxic")) & (every - bad >= LEAST_ROWS)
    uneven = counted.withColumns(shares).withColumn("marker", marker).where(marker | other)
    best = uneven.orderBy(F.abs(F.log(F.col("toxic") / F.col("clean"))).desc(), "word").limit(most).select("word", "marker").collect()
    best.sort()
    return np.array([r.word for r in best], np.int64), np.array([r.marker for r in best], bool)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    """Regression from the ``sample`` learned labels of least hash whose documents are in ``docs``."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    known = usable.groupBy(F.col(key).alias("_key")).agg((F.max(label) > 0).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(sample)  # at most `sample` rows: a bounded broadcast

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = [], []
            for value in batch.column(1).to_pylist():
                found = sorted((xxhash.xxh64_intdigest(w), n) for w, n in frequencies(value).items())
                words.append(np.array([p[0] for p in found], np.uint64).view(np.int64))
                counts.append(np.array([p[1] for p in found], np.int32))
            columns = [batch.column(0), pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "words", "counts"])

    joined = docs.join(F.broadcast(chosen), F.col(key) == F.col("_key")).select(F.col("_y").alias("y"), text_or_empty(text))
    rows = kept(map_slices(joined, hashed, "y boolean, words array<bigint>, counts array<int>", 1))
    best, marker = select(rows, FEATURES)
    shared = docs.sparkSession.sparkContext.broadcast(best)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = [], []
            for words, times in zip(batch.column(1), batch.column(2), strict=True):
                words, times = words.values.to_numpy(), times.values.to_numpy()
                place = np.minimum(np.searchsorted(shared.value, words), max(len(shared.value) - 1, 0))
                known = shared.value[place] == words if len(shared.value) else np.zeros(len(words), bool)
                at.append(place[known].astype(np.int32).tobytes())
                counts.append(times[known].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], names=["y", "at", "counts"])

    found = rows.mapInArrow(narrow, "y boolean, at binary, counts binary")
    got = sorted(tuple(r) for r in found.orderBy(F.xxhash64("at", "counts"), "y").limit(sample).collect())  # repeated keys don't pass the bound
    return train(best, marker, [(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.int32)) for r in got], np.array([r[0] for r in got], bool))


def score(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """``docs`` with severity (expected grade) and p_toxic (probability of a grade above 0)."""
    names, at = [*docs.columns, "severity", "p_toxic"], docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = Remembered(shared.value.weights)
        for batch in batches:
            totals = [weight.total(value or "") for value in batch.column(at).to_pylist()]
            above = shared.value.above(np.array(totals, np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(axis=1)), pa.array(above[:, 0])], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_slices(docs, run, f"{schema}, severity double, p_toxic double", at)


def rate(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with severity, p_toxic and toxic."""
    if {"severity", "p_toxic", "toxic", "_key", "_y"} & set(docs.columns):
        raise ValueError("the columns severity, p_toxic, toxic, _key and _y are the operator's")
    return score(docs, fit(docs, labels, key, text, label, sample), text).withColumn("toxic", F.col("p_toxic") >= CUT)
