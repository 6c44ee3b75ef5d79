"""Token counts: pieces are counted once for each distinct pre-token and summed by frequency.

``count_tokens`` follows a BPE tokenizer of a ``tokenizers`` JSON file that folds white space and
letter case, splits by one pattern and merges inside the matches, so the tokens of a pre-token
never depend on its neighbours.

1. ``vocabulary``: every task counts its pre-tokens; Spark adds the counts up (one row for each
   distinct pre-token) and the library encodes each of them once, without keeping ids.
2. Pre-tokens of at least ``floor`` occurrences, no more than ``FREQUENT`` of them, go to every
   task as a table of proven size; a histogram of the counts finds the floor.
3. Every document becomes one row with the sum over its frequent pre-tokens, and one row for each
   of its other pre-tokens with its frequency. Those meet the vocabulary in a join: none of them
   is hot, as hot ones are in the frequent table. Sums by document end it.

Strings of special tokens inside a text count as one token each, as the library's default has it.

Defined cases: a null text is an empty one; an empty text has no tokens; repeated rows stay
repeated; null keys are kept apart by their texts; columns other than key and text are not
carried; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import kept, map_slices, text_or_empty

#: Rows of the table that goes to every task, and distinct pre-tokens a task holds before it passes them on.
FREQUENT, HELD = 150_000, 200_000


class Splitter:
    """Pre-tokens of a text, from the normaliser and the pattern that the tokenizer's file states."""

    def __init__(self, definition: str):
        stated = json.loads(definition)
        steps = [n["type"] for n in stated["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or stated["model"]["type"] != "BPE":
            raise ValueError("a BPE file that folds white space and letter case is asked for")
        self.pattern = regex.compile(stated["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in stated["added_tokens"]]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def __call__(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special strings stand between them."""
        if not any(s in text for s in self.special):
            return self.pieces(text), 0
        parts = self.at_special.split(text)
        return [p for part in parts for p in self.pieces(part)], len(parts) - 1

    def pieces(self, text: str) -> list[str]:
        # each character is folded for itself: the final form of sigma is not used
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def vocabulary(docs: DataFrame, definition: str, text: str = "text") -> DataFrame:
    """(piece, n, n_tokens) of every distinct pre-token of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, found = Splitter(shared.value), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["piece", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                found.update(splitter(value)[0])
            if len(found) >= HELD:
                yield out()
                found.clear()
        yield out()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_str(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                coded = tokenizer.encode_batch(part.column(0).to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(c.ids) for c in coded], pa.int64())], names=["piece", "n", "n_tokens"])

    counted = map_slices(docs.select(text_or_empty(text)), split, "piece string, n bigint", 0).groupBy("piece").agg(F.sum("n").alias("n"))
    return kept(counted.mapInArrow(sizes, "piece string, n bigint, n_tokens bigint"))


GRADE = "floor(log2(n) * 16)"


def floor_of(words: DataFrame, most: int) -> int:
    """The least grade (sixteenth of a doubling of the count) that at most ``most`` pre-tokens reach."""
    floor, above = 64 * 16, 0
    for grade, k in sorted(words.groupBy(F.expr(GRADE).alias("grade")).agg(F.count("*")).collect(), reverse=True):  # <= 1024 rows
        above += k
        if above > most:
            break
        floor = grade
    return floor


def count_tokens(docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for each row of ``docs``."""
    spark = docs.sparkSession
    words = vocabulary(docs, definition, text)
    floor = floor_of(words, FREQUENT)
    frequent = words.where(f"{GRADE} >= {floor}").select("piece", "n_tokens").toPandas()  # <= FREQUENT rows
    shared = spark.sparkContext.broadcast((definition, dict(zip(frequent["piece"], frequent["n_tokens"].tolist(), strict=True))))
    key_type = docs.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, sizes = shared.value
        splitter = Splitter(definition)
        for batch in batches:
            at, digests, n_bytes, tokens, pieces, times = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                found, known = splitter(value)
                rare = Counter()
                for piece in found:
                    size = sizes.get(piece)
                    if size is None:
                        rare[piece] += 1
                    else:
                        known += size
                raw = value.encode("utf-8")
                lines = 1 + len(rare)
                at += [row] * lines
                digests += [xxhash.xxh3_64_intdigest(raw) - (1 << 63)] * lines
                n_bytes += [len(raw)] + [None] * len(rare)
                tokens += [known] + [None] * len(rare)
                pieces += [None, *rare]
                times += [None, *rare.values()]
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(digests, pa.int64())]
            columns += [pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(pieces, pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "digest", "n_bytes", "known", "piece", "times"])

    source = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    rows = kept(map_slices(source, split, f"key {key_type}, digest bigint, n_bytes bigint, known bigint, piece string, times bigint", 1))
    rare = rows.where("piece is not null").join(words.where(f"{GRADE} < {floor}"), "piece").select("key", "digest", (F.col("times") * F.col("n_tokens")).alias("known"))
    whole = rows.where("piece is null").select("key", "digest", "known", "n_bytes")
    sums = whole.unionByName(rare, allowMissingColumns=True).groupBy("key", "digest")
    sums = sums.agg(F.sum("known").alias("known"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("rows"))
    # equal rows were summed together: each of them has its share
    return sums.select(
        F.col("key").alias(key), "n_bytes", (F.col("known") / F.col("rows")).cast("bigint").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("bigint"), "rows"))
    ).drop("col")
