"""What several operators share: reading, slices of Arrow batches, kept tables, word tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, small_batches

#: Rows that a worker handles at once, and bytes of text after which a slice ends early.
SLICE_ROWS, SLICE_BYTES = 512, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared checkpoint folder: read many times, computed once."""
    return cut_lineage(df)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(
    batches: Iterable[pa.RecordBatch], text_at: int, most_rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of few rows and few bytes of text; a single long text is a piece."""
    for batch in batches:
        start, size = 0, 0
        for row, length in enumerate(pc.binary_length(batch.column(text_at)).to_pylist()):
            size += length or 0
            if size >= most_bytes or row - start + 1 >= most_rows:
                yield batch.slice(start, row + 1 - start)
                start, size = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def map_slices(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, text_at: int
) -> DataFrame:
    """``mapInArrow`` over slices bounded in rows and bytes; ``text_at`` is the text's position.

    The session's Arrow batches are made no larger than ``BATCH_ROWS`` rows, so that several
    workers beside an executor hold few texts at a time, and give back what they held.
    """
    small_batches(df.sparkSession)

    def run(batches):
        yield from function(slices(batches, text_at))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


WORD = re.compile(r"\w+|[^\w\s]+")


def word_tokens(text: str) -> list[str]:
    """Words and runs of signs, in order; letters keep their case."""
    return WORD.findall(text)
