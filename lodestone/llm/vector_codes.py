"""Vector code compression: product codes of whole-number vectors, by per-dimension value dictionaries.

Vectors become whole numbers, floor(scale * x), and are cut into equal consecutive parts. Each part
position has a codebook; it starts as that part of the vectors with the smallest keys and is moved to
the means of what is assigned to it (componentwise floor of sum / count; unused entries stay), a fixed
number of rounds. At the end each part is its nearest entry's index.

1. ``packed`` writes blocks of at most ``BLOCK`` vectors to the shared folder once, dimension by dimension:
   the distinct whole numbers of the dimension (its dictionary) and one 16-bit index into it for each vector.
2. For a codebook, the squared difference of every dictionary number to every entry is tabulated once
   for each block and dimension; the distances of a part are rows gathered from its tables by the dictionary
   indexes and added up. No difference is ever computed twice for equal numbers of a block.
3. A round is one pass over the blocks. Tasks give sums and counts of each entry, which Spark adds
   up; parts x entries rows reach the driver, however many vectors there are.

All arithmetic is on whole numbers: results don't depend on partitions or on the order of rows. A task
holds one block and one dimension's table (``BLOCK`` x entries numbers at most).

Defined cases: rows whose vector is null, or holds null or non-finite components, are left out; a null key
stays null and comes last in the order of keys; repeated rows each have a code; of equal keys the
lexicographically smaller vector comes first; fewer vectors than entries make a smaller codebook; equal
distances go to the lower index; null labels count as one label; other columns are not carried; an
empty table (or one without usable vectors) gives an empty table. ``ValueError``: vectors of unlike lengths, a length that the parts
don't divide, numbers beyond ``vectors.LARGEST``, a key named like an output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.common import kept
from lodestone.llm.vectors import whole_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
OUTPUTS = ("code", "error", "label_error", "codebooks_sha256")
#: Vectors of a block; rows whose distances are added up at a time.
BLOCK, STEP = 4_096, 512


def packed(vectors: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """Blocks (keys, labels, width, dictionary, starts, codes): each dimension's numbers and the indexes into them."""
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    types = {f.name: f.dataType for f in rows.schema.fields}
    names = ["keys", "labels", "width", "dictionary", "starts", "codes"]
    schema = f"keys array<{types['key'].simpleString()}>, labels array<{types['label'].simpleString()}>, width int, dictionary binary, starts binary, codes binary"

    def block(keys: list, labels: list, numbers: list) -> pa.RecordBatch:
        matrix = np.concatenate(numbers).T
        found = [np.unique(dimension, return_inverse=True) for dimension in matrix]
        starts = np.cumsum([0, *(len(values) for values, _ in found)]).astype(np.int32)
        dictionary = np.concatenate([values for values, _ in found] or [np.empty(0)]).astype(np.int32)
        codes = np.stack([code for _, code in found]).astype(np.uint16) if found else np.empty((0, 0), dtype=np.uint16)
        ends = pa.array([0, matrix.shape[1]], type=pa.int32())
        columns = [
            *(pa.ListArray.from_arrays(ends, pa.concat_arrays(values)) for values in (keys, labels)),
            pa.array([len(matrix)], type=pa.int32()),
            *(pa.array([x.tobytes()], type=pa.binary()) for x in (dictionary, starts, codes)),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        count, width = 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                good, numbers = whole_vectors(piece, 2, scale)
                if not len(good):
                    continue
                if width is not None and width != numbers.shape[1]:
                    raise ValueError(f"vectors of unlike lengths: {width}, {numbers.shape[1]}")
                width = numbers.shape[1]
                if count + len(good) > BLOCK:
                    yield block(*held)
                    held, count = ([], [], []), 0
                for part, new in zip(held, (piece.column(0).take(pa.array(good)), piece.column(1).take(pa.array(good)), numbers), strict=True):
                    part.append(new)
                count += len(good)
        if count:
            yield block(*held)

    return kept(rows.mapInArrow(run, schema))


class Block:
    """One stored block: its rows' dictionary indexes by dimension, and each dimension's dictionary."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        value = lambda name: batch.column(batch.schema.get_field_index(name))[row]
        self.keys, self.labels = value("keys").values, value("labels").values
        self.rows, self.width = len(self.keys), value("width").as_py()
        numbers, starts = (np.frombuffer(value(name).as_py(), dtype=np.int32) for name in ("dictionary", "starts"))
        self.dictionaries = [numbers[a:b].astype(np.int64) for a, b in zip(starts, starts[1:], strict=False)]
        self.codes = np.frombuffer(value("codes").as_py(), dtype=np.uint16).reshape(self.width, self.rows)

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([values[code[rows]] for values, code in zip(self.dictionaries, self.codes, strict=True)], axis=1)

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, distance) of the nearest entry of each part, by parts and rows. ``books``: parts, entries, positions."""
        parts, entries, positions = books.shape
        index, least = np.empty((parts, self.rows), dtype=np.int64), np.empty((parts, self.rows), dtype=np.int64)
        for part in range(parts):
            own = range(part * positions, (part + 1) * positions)
            tables = [(self.dictionaries[d][:, None] - books[part, :, d - own.start][None, :]) ** 2 for d in own]
            if sum(int(t.max()) for t in tables) < 1 << 31:
                tables = [t.astype(np.int32) for t in tables]
            total = np.empty((STEP, entries), dtype=tables[0].dtype)
            gathered = np.empty_like(total)
            for start in range(0, self.rows, STEP):
                n = min(STEP, self.rows - start)
                for k, d in enumerate(own):
                    np.take(tables[k], self.codes[d, start : start + n], axis=0, out=(gathered if k else total)[:n], mode="clip")
                    if k:
                        total[:n] += gathered[:n]
                best = total[:n].argmin(axis=1)
                index[part, start : start + n], least[part, start : start + n] = best, total[np.arange(n), best]
        return index, least


def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row)


def first_books(blocks: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks of the vectors with the smallest keys: (parts, entries, positions)."""
    key_type = blocks.schema["keys"].dataType.elementType
    arrow_key = to_arrow_type(key_type)

    def smallest(batches):
        for block in blocks_of(batches):
            order = pc.array_sort_indices(block.keys, null_placement="at_end")
            last = block.keys[order[min(entries, block.rows) - 1].as_py()]
            # rows with the last key are all looked at: of equal keys the smaller vectors come first
            beyond = pc.fill_null(pc.greater(block.keys, last), last.is_valid)
            rows = np.flatnonzero(~beyond.to_numpy(zero_copy_only=False)) if last.is_valid else np.arange(block.rows)
            keys, numbers = block.keys.take(pa.array(rows)).to_pylist(), block.numbers(rows).tolist()
            chosen = sorted(zip(keys, numbers, strict=True), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1]))[:entries]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chosen], type=arrow_key), pa.array([v for _, v in chosen], type=pa.list_(pa.int64()))], ["key", "numbers"])

    found = blocks.mapInArrow(smallest, f"key {key_type.simpleString()}, numbers array<bigint>")
    rows = found.orderBy(F.col("key").asc_nulls_last(), "numbers").limit(entries).collect()
    matrix = np.array([r.numbers for r in rows], dtype=np.int64)
    return matrix.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floored mean of the parts that are nearest to it; unused entries stay."""
    parts, entries, positions = books.shape

    def sums(batches):
        counts, totals = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for block in blocks_of(batches):
            index, _ = block.nearest(books)
            for part in range(parts):
                counts[part] += np.bincount(index[part], minlength=entries)
                for k in range(positions):
                    d = part * positions + k
                    # whole numbers below 2^53 all along: a block has few rows
                    added = np.bincount(index[part], weights=block.dictionaries[d][block.codes[d]], minlength=entries)
                    totals[part, :, k] += added.astype(np.int64)
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry]]
        added = pa.array(list(totals[part, entry]), type=pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), added], ["part", "entry", "n", "sums"])

    found = blocks.mapInArrow(sums, "part int, entry int, n bigint, sums array<bigint>")
    added = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(positions)]
    new = books.copy()
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # at most parts x entries rows
        new[row.part, row.entry] = [row[f"s{k}"] // row.n for k in range(positions)]
    return new


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(key, label, code, error) of each vector: the entries' indexes in part order as hexadecimal digits."""
    key_type, label_type = (blocks.schema[c].dataType.elementType for c in ("keys", "labels"))

    def run(batches):
        for block in blocks_of(batches):
            index, least = block.nearest(books)
            text = np.ascontiguousarray(index.T.astype(np.uint8)).tobytes().hex()
            size = 2 * len(books)
            codes = [text[k : k + size] for k in range(0, len(text), size)]
            columns = [block.keys, block.labels, pa.array(codes, type=pa.string()), pa.array(least.sum(axis=0))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "code", "error"])

    return blocks.mapInArrow(run, f"key {key_type.simpleString()}, label {label_type.simpleString()}, code string, error bigint")


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each usable vector; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    if key in OUTPUTS:
        raise ValueError(f"the key is named like an output: {key}")
    blocks = packed(vectors, key, vector, label, scale)
    widths = [r.width for r in blocks.select("width").distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of unlike lengths: {sorted(widths)}")
    if widths and (widths[0] == 0 or widths[0] % parts):
        raise ValueError(f"{parts} equal parts of {widths[0]} components")
    books = first_books(blocks, parts, entries) if widths else np.empty((parts, 0, 0), dtype=np.int64)
    for _ in range(rounds if widths else 0):
        books = moved(blocks, books)
    rows = kept(coded(blocks, books))
    # a table of its own: Spark knows its size, and broadcasts it or joins by a shuffle that splits hot labels
    sums = kept(rows.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
