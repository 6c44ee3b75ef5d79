"""Byte-level BPE: chunks are pre-tokenised apart, stitched where their boundaries meet, then encoded.

``encode`` takes any table with a text column and adds ``ids`` (array<int>); ``decode`` adds
``decoded`` (binary), the bytes of the ids one after another.

A text of up to ``chunk_chars`` code points is one chunk, complete where it is read. A longer
text is cut into chunks that overlap by ``overlap`` code points, dealt over the cluster and
pre-tokenised there. The pattern never looks back, so two chunks that share one boundary inside
their overlap share all later ones: the first shared boundary behind a character that is not
white space becomes a cut. Between cuts lie pieces that are encoded apart and joined in order.
Where an overlap is a single run of one kind and no boundary is shared, the text stays whole
from the last cut on, as such a run is one pre-token.

Defined cases: a null text is an empty one; empty texts have no ids; other columns, repeated
rows and null keys pass through unchanged; equal texts share their pieces; a column that is
named like an output raises ``ValueError``; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_slices

CHUNK_CHARS, OVERLAP = 65_536, 1_024
#: Boundaries so near the end of a chunk may move once more text is seen: the longest fixed alternative of a pattern.
EDGE = 8


def read_ranks(path: str) -> bytes:
    """A rank file as it is: a base64 token and its rank on each line. Bounded by the vocabulary."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def encoder(raw: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=parse_ranks(raw), special_tokens={})


def boundaries(pattern: regex.Pattern, text: str) -> list[int]:
    """Where pre-tokens end behind a character that is no white space. The last one may be cut short."""
    ends = [m.end() for m in pattern.finditer(text)]
    return [e for e in ends[:-1] if not text[e - 1].isspace()]


def cuts(chunks: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Cuts of one text from (start, boundaries in the head, boundaries in the tail) of each chunk in order.

    A chunk whose head shares no boundary with the tail before it ends the search: nothing behind
    it is known to be a boundary of the text.
    """
    found, previous = [], None
    for start, head, tail in chunks:
        if previous is not None:
            shared = [x for x in sorted(set(previous) & {start + e for e in head}) if not found or x > found[-1]]
            if not shared:
                break
            found.append(shared[0])
        previous = [start + e for e in tail]
    return found


def _encode_texts(spark, texts: DataFrame, raw: bytes, pattern: str) -> DataFrame:
    """Adds ids to a table whose last column is ``_piece``, which goes."""
    shared = spark.sparkContext.broadcast(raw)
    names = texts.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(shared.value, pattern)
        for batch in batches:
            rows = [encoding.encode_to_numpy(t, disallowed_special=()) for t in batch.column(len(names)).to_pylist()]
            offsets = [0]
            for row in rows:
                offsets.append(offsets[-1] + len(row))
            values = pa.concat_arrays([pa.array(row, pa.uint32()) for row in rows if len(row)] or [pa.array([], pa.uint32())])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], ids], names=[*names, "ids"])

    return map_slices(texts, run, f"{schema}, ids array<int>" if schema else "ids array<int>", len(names))


def _long_texts(spark, texts: DataFrame, raw: bytes, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(digest, ids) of the long texts in (digest, text), which has one row for each digest."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = chunk_chars - overlap
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start in range(0, max(1, len(text) - overlap), step):
                    yield pa.RecordBatch.from_pylist([{"digest": digest, "start": start, "chunk": text[start : start + chunk_chars]}])

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                size, ends = len(row["chunk"]), boundaries(compiled, row["chunk"])
                tail = [e for e in ends if size - overlap < e <= size - EDGE]
                sides = {"head": [e for e in ends if e < overlap], "tail": tail}
                out.append({"digest": row["digest"], "start": row["start"], **sides})
            yield pa.RecordBatch.from_pylist(out, schema=ends_schema)

    ends_schema = pa.schema(
        [("digest", pa.string()), ("start", pa.int64()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))]
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = sorted((x["start"], x["head"], x["tail"]) for x in row["ends"])
                at = [0, *cuts(ends), len(row["text"])]
                for number in range(len(at) - 1):
                    piece = {"digest": row["digest"], "number": number, "_piece": row["text"][at[number] : at[number + 1]]}
                    yield pa.RecordBatch.from_pylist([piece])

    chunks = map_slices(texts, cut_up, "digest string, start bigint, chunk string", 1).repartition("digest", "start")
    ends = map_slices(chunks, pre_tokenise, "digest string, start bigint, head array<int>, tail array<int>", 2)
    ends = ends.groupBy("digest").agg(F.collect_list(F.struct("start", "head", "tail")).alias("ends"))
    whole = texts.join(ends, "digest").select("digest", "text", "ends")
    cut = map_slices(whole, pieces, "digest string, number bigint, _piece string", 1).repartition("digest", "number")
    encoded = _encode_texts(spark, cut, raw, pattern).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("number", "ids"))).alias("parts"))
    return encoded.select("digest", F.flatten(F.col("parts.ids")).alias("ids"))


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with the column ``ids``. What is collected of one text is bounded by that text's size."""
    if {"ids", "_piece", "_digest"} & set(docs.columns):
        raise ValueError("the columns ids, _piece and _digest are the operator's")
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    is_long = F.length(whole) > chunk_chars
    short = _encode_texts(spark, docs.where(~is_long).withColumn("_piece", whole), ranks, pattern)
    long = docs.where(is_long).withColumn("_digest", F.sha2(F.encode(whole, "UTF-8"), 256))
    texts = long.groupBy(F.col("_digest").alias("digest")).agg(F.first(text).alias("text"))
    ids = _long_texts(spark, texts, ranks, pattern, chunk_chars, overlap)
    long = long.join(ids.withColumnRenamed("digest", "_digest"), "_digest").select(*docs.columns, "ids")
    return short.select(*docs.columns, "ids").unionByName(long)


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``encoded`` (with ``ids``) with the column ``decoded``; ids null: null. An unknown id raises ``KeyError``."""
    if "decoded" in encoded.columns:
        raise ValueError("the column decoded is the operator's")
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    names, at = [*encoded.columns, "decoded"], encoded.columns.index("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {rank: token for token, rank in parse_ranks(shared.value).items()}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column(at)
                values, ends = ids.flatten().to_numpy(zero_copy_only=False).tolist(), [0]
                for size in ids.value_lengths().to_pylist():
                    ends.append(ends[-1] + (size or 0))
                known = ids.is_valid().to_pylist()
                out = [b"".join(map(of.__getitem__, values[a:b])) if k else None for a, b, k in zip(ends, ends[1:], known, strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=names)

    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """The digest columns of ``encode`` and ``decode`` beside the key, ids and bytes left out."""
    coded = decode(encode(docs, ranks, pattern, text), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.withColumns(
        {
            "n_tokens": F.size("ids").cast("bigint"),
            "ids_sha256": F.sha2(F.encode(joined, "UTF-8"), 256),
            "decoded_sha256": F.sha2(F.col("decoded"), 256),
        }
    ).drop("ids", "decoded")
