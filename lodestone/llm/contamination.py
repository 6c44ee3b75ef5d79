"""Benchmark decontamination: which documents contain which test items.

A document contains an item if at least ``THRESHOLD`` of the item's distinct shingles of ``WIDTH``
words stand in the document, wherever. ``contained`` returns these pairs, ``clean`` the documents
without any.

Search by size-partitioned MinHash sketches. An item of m shingles that is contained misses at
most m - ceil(t m) of them, so one of its m - ceil(t m) + 1 smallest hashes must be in the
document: that bottom sketch is the item's signature. Items are partitioned by size (doubling
classes); the largest hash in any signature of a class is the class's bound, and the sketch of a
document for that class is all its shingle hashes up to the bound. So the sketch of a long
document is as long as needed for the shortest items it may hide, and nothing is missed, where
signatures of a fixed number of permutations lose short items in long documents. A pair whose
sketches share a hash is a candidate, and is verified on the shingles themselves.

Items come in blocks of at most ``BLOCK_ITEMS`` and ``BLOCK_BYTES`` (an item with more bytes is a
block by itself), each sent to all tasks; documents pass each block where they lie and never move.

Defined cases: words are lower-cased runs of letters, digits and underscores; an item of fewer
than ``WIDTH`` words is one shingle of all its words; an item without words, or a null one, is in
no document; a null document is an empty one; repeated rows give repeated pairs, repeated items
with one id count as one item each; null keys pass through; empty tables give empty tables; other
columns are left out of the pairs and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.common import map_slices, text_or_empty

WIDTH, THRESHOLD = 5, 0.8
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 16_000_000
WORDS = re.compile(r"\w+")
#: Odd multipliers that make a shingle's hash depend on the order of its words.
STEP = 0x9E3779B97F4A7C15
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 17


class WordHashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` word hashes."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    mixed = np.zeros(count, np.uint64)
    for k in range(width):
        mixed = (mixed ^ words[k : k + count]) * np.uint64(STEP)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shingles_of(words: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(width)), strict=False))


class Items:
    """Signatures of a block of items: for each shingle width and size class a bound and sorted hashes."""

    def __init__(self, block: list[tuple[object, str]], width: int, threshold: float):
        hashes = WordHashes()
        self.shingles, self.needed, self.width = [], [], []
        signatures: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, (_, text) in enumerate(block):
            words = WORDS.findall((text or "").lower())
            own = min(width, len(words))
            found = shingles_of(words, own) if own else set()
            self.shingles.append(found)
            self.width.append(own)
            self.needed.append(math.ceil(threshold * len(found) - 1e-9))
            if found:
                every = np.unique(shingle_hashes(np.array([hashes[w] for w in words], np.uint64), own))
                least = every[: len(found) - self.needed[-1] + 1].tolist()
                signatures[own][len(found).bit_length()] += [(h, number) for h in least]
        self.classes = []
        for own, sizes in signatures.items():
            for pairs in sizes.values():
                at = defaultdict(list)
                for h, number in pairs:
                    at[h].append(number)
                keys = np.array(sorted(at), np.uint64)
                self.classes.append((own, keys[-1], keys, at))

    def candidates(self, words: np.ndarray) -> set[int]:
        found: set[int] = set()
        made: dict[int, np.ndarray] = {}
        for own, bound, keys, at in self.classes:
            if own not in made:
                made[own] = shingle_hashes(words, own)
            sketch = made[own][made[own] <= bound]
            place = np.searchsorted(keys, sketch)
            for h in np.unique(sketch[keys[place] == sketch]).tolist():
                found.update(at[h])
        return found

    def contained(self, words: list[str], hashes: WordHashes) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) of the items that the words contain."""
        chosen = sorted(self.candidates(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
        made: dict[int, set] = {}
        for number in chosen:
            own = self.width[number]
            if own not in made:
                made[own] = shingles_of(words, own)
            shared = len(self.shingles[number] & made[own])
            if shared >= self.needed[number]:
                yield number, shared


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded number and size, one after another; never all at once."""
    block, size = [], 0
    for row in items.select(key, text).toLocalIterator():
        length = len((row[1] or "").encode("utf-8"))
        if block and (len(block) >= BLOCK_ITEMS or size + length > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += length
    if block:
        yield block


def contained(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    width: int = WIDTH, threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, item key, n_shingles, n_shared, containment) for each document and item it contains."""
    spark = docs.sparkSession
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    source = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    schema = f"`_key` {key_type}, `_item` {item_type}, n_shingles bigint, n_shared bigint"
    ids_type = to_arrow_type(items.schema[item_key].dataType)
    found = None
    for block in blocks(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hashes = Items(shared.value, width, threshold), WordHashes()
            for batch in batches:
                rows, ids, sizes, counts = [], [], [], []
                for row, value in enumerate(batch.column(1).to_pylist()):
                    for number, both in index.contained(WORDS.findall(value.lower()), hashes):
                        rows.append(row)
                        ids.append(shared.value[number][0])
                        sizes.append(len(index.shingles[number]))
                        counts.append(both)
                columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(ids, ids_type), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "_item", "n_shingles", "n_shared"])

        part = map_slices(source, run, schema, 1)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.select(
        F.col("_key").alias(key), F.col("_item").cast(item_type).alias(item_key), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that contain no item, as they are: each block of items filters the rows where they lie."""
    at, names = docs.columns.index(text), docs.columns
    for block in blocks(items.withColumn("_none", F.lit(None).cast("bigint")), "_none", item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hashes = Items(shared.value, width, threshold), WordHashes()
            for batch in batches:
                texts = batch.column(at).to_pylist()
                dirty = [any(True for _ in index.contained(WORDS.findall((t or "").lower()), hashes)) for t in texts]
                yield batch.filter(pa.array([not d for d in dirty], pa.bool_())).rename_columns(names)

        docs = map_slices(docs, run, docs.schema, at)
    return docs
