"""Segments, postings and statistics: what a corpus holds besides its file rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.extract import pin_tag_and_names
from lodestone.schemas import FILES, ID_BUCKETS, conform
from lodestone.session import small_batches


#: Tokens that a worker groups at once.
TOKENS_AT_ONCE = 1 << 18
#: Tokens of neighbouring bodies whose postings share blocks.
TOKENS_OF_BLOCKS = 1 << 20
#: Rows that a worker gives back at once.
ROWS_AT_ONCE = 1 << 14


def build_files(docs: DataFrame) -> DataFrame:
    """File rows of documents. The id is a hash of the path, so it never changes."""
    if "file_id" not in docs.columns:
        docs = docs.withColumn("file_id", F.xxhash64("normalized_path"))
    if "title" not in docs.columns and "content" in docs.columns:
        docs = pin_tag_and_names(docs)
    return conform(docs, FILES)


def build_segments(docs: DataFrame) -> DataFrame:
    """One body per document; blank bodies have none."""
    return docs.where(F.col("content").rlike(r"(?U)\S")).select(
        "file_id", "content", tx.word_count(F.col("content")).cast("int").alias("n_tokens")
    )


def id_bucket(file_id: Column) -> Column:
    # a literal id may be an int, whose hash is another one
    return F.pmod(F.xxhash64(file_id.cast("bigint")), F.lit(ID_BUCKETS)).cast("int")


def bodies_of(segments: DataFrame, ids: list[int]) -> DataFrame:
    """Bodies of a few known files. Stored segments open only the folders concerned."""
    found = segments.where(F.col("file_id").isin(ids))
    if "bucket" not in segments.columns:
        return found
    wanted = F.array_distinct(F.array(*[id_bucket(F.lit(i)) for i in ids])) if ids else F.array()
    return found.where(F.array_contains(wanted.cast("array<int>"), F.col("bucket")))


def _list_lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _run_lengths(lists: pa.ListArray) -> np.ndarray:
    """Characters of all runs of each row."""
    sizes = pc.utf8_length(pc.list_flatten(lists)).to_numpy()
    return np.bincount(pc.list_parent_indices(lists).to_numpy(), sizes, len(lists)).astype(np.int64)


def _few_tokens(batches: Iterator[pa.RecordBatch], lengths=_list_lengths) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``TOKENS_AT_ONCE`` tokens; a longer list is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(lengths(batch.column("tokens")))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, side="right")))
            yield batch.slice(start, end - start)
            start = end
        pa.default_memory_pool().release_unused()


def _group_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (file, term) of the token lists in each batch, with its positions."""
    for batch in _few_tokens(batches):
        lists = batch.column("tokens")
        row = pc.list_parent_indices(lists)
        offsets = lists.offsets.to_numpy()
        place = np.arange(offsets[0], offsets[-1]) - offsets[row.to_numpy()]
        flat = pa.table({"row": row, "term": pc.list_flatten(lists), "at": pa.array(place, pa.int32())})
        groups = flat.filter(pc.field("term") != "").group_by(["row", "term"], use_threads=False)
        found = groups.aggregate([("at", "list")]).combine_chunks()
        rows, positions = found["row"], found["at_list"]
        columns = {
            "term": found["term"],
            "file_id": batch.column("file_id").take(rows),
            "tf": pc.list_value_length(positions),
            "n_tokens": batch.column("n_tokens").take(rows),
            "positions": positions,
        }
        yield from pa.table(columns).to_batches()


def _joined_pieces(batches: Iterator[pa.RecordBatch], lengths=_list_lengths) -> Iterator[pa.RecordBatch]:
    """Pieces of :func:`_few_tokens` joined to about ``TOKENS_OF_BLOCKS`` tokens."""
    held, tokens = [], 0
    for piece in _few_tokens(batches, lengths):
        held.append(piece)
        tokens += int(lengths(piece.column("tokens")).sum())
        if tokens >= TOKENS_OF_BLOCKS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, tokens = [], 0
    if tokens:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def in_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes below 2**31 in ascending order, and where they were; equal ones stay in order."""
    keys = np.sort(codes.astype(np.uint64) << np.uint64(32) | np.arange(len(codes), dtype=np.uint64))
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys begin to differ from the row before, the first row included."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _block_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per term of the token lists in some batches, with the files that hold it."""
    for batch in _joined_pieces(batches):
        lists = batch.column("tokens")
        row, offsets = pc.list_parent_indices(lists).to_numpy(), lists.offsets.to_numpy()
        place = (np.arange(offsets[0], offsets[-1]) - offsets[row]).astype(np.int32)
        words = pc.list_flatten(lists).dictionary_encode()
        code = words.indices.to_numpy()
        if (blank := pc.index(words.dictionary, "").as_py()) >= 0:
            kept = code != blank
            row, place, code = row[kept], place[kept], code[kept]
        yield from _blocks_of_codes(batch, row, place, code, words.dictionary)


def _block_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for the bi-grams of runs of characters, cut here. Each run takes up as many places as it has characters."""
    for batch in _joined_pieces(batches, _run_lengths):
        lists = batch.column("tokens")
        runs = pc.list_flatten(lists)
        sizes = pc.utf8_length(runs).to_numpy()
        row = np.repeat(pc.list_parent_indices(lists).to_numpy(), sizes)
        signs = np.frombuffer("".join(runs.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.searchsorted(row, np.arange(batch.num_rows))
        place = (np.arange(len(row)) - begins[row]).astype(np.int32)
        first = np.ones(len(signs), bool)
        first[np.cumsum(sizes) - 1] = False
        at = np.flatnonzero(first)
        pairs = pa.array(signs[at] << 32 | signs[at + 1]).dictionary_encode()
        names = pa.array([chr(p >> 32) + chr(p & 0xFFFFFFFF) for p in pairs.dictionary.to_pylist()], pa.string())
        yield from _blocks_of_codes(batch, row[at], place[at], pairs.indices.to_numpy(), names)


def _blocks_of_codes(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray, code: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
    """Blocks of the tokens ``names[code]`` that stand at ``place`` in the rows of a batch."""
    code, order = in_order(code)
    row, place = row[order], place[order]
    entries = _changes(code, row)
    blocks = _changes(code[entries])
    holders = row[entries]
    counts = np.diff(np.append(entries, len(code))).astype(np.int32)
    of_block = pa.array(np.append(blocks, len(entries)).astype(np.int32))
    begin = entries[blocks]
    starts = entries - np.repeat(begin, np.diff(of_block.to_numpy()))
    columns = {
        "term": names.take(pa.array(code[entries][blocks])),
        "file_ids": pa.ListArray.from_arrays(of_block, batch.column("file_id").take(pa.array(holders))),
        "tfs": pa.ListArray.from_arrays(of_block, pa.array(counts)),
        "lengths": pa.ListArray.from_arrays(of_block, batch.column("n_tokens").take(pa.array(holders))),
        "starts": pa.ListArray.from_arrays(of_block, pa.array(starts.astype(np.int32))),
        "positions": pa.ListArray.from_arrays(pa.array(np.append(begin, len(code)).astype(np.int32)), pa.array(place)),
    }
    yield from pa.table(columns).to_batches(ROWS_AT_ONCE)
    pa.default_memory_pool().release_unused()


def _per_document(segments: DataFrame, kind: str, tokens: Column, group, layout: str) -> DataFrame:
    """What ``group`` makes of the tokens of each document.

    Tokens are made in the JVM, once (a filter on them would make them again), and grouped where they are: a document
    never leaves its batch, so nothing is shuffled until the rows are laid out by term.
    """
    small_batches(segments.sparkSession)
    listed = F.coalesce(tokens, F.array().cast("array<string>"))
    made = segments.select("file_id", "n_tokens", listed.alias("tokens")).mapInArrow(group, layout)
    return made.select(F.lit(kind).alias("kind"), "*")


def _of_both_kinds(segments: DataFrame, layout: str, group, group_cjk, cjk_tokens: Column) -> DataFrame:
    # the first test, of one range, spares most bodies the costly one
    cjk = segments.where(F.col("content").rlike(tx.CJK_RANGE) & F.col("content").rlike(f"[{tx.CJK_CLASS}]{{2}}"))
    return _per_document(segments, "word", tx.words(F.col("content")), group, layout).unionByName(
        _per_document(cjk, "bigram", cjk_tokens, group_cjk, layout)
    )


def build_postings(segments: DataFrame) -> DataFrame:
    """Word and bi-gram postings with positions, one row per (kind, term, file)."""
    layout = "term string, file_id bigint, tf int, n_tokens int, positions array<int>"
    return _of_both_kinds(segments, layout, _group_tokens, _group_tokens, tx.cjk_bigrams(F.col("content"), separate=True))


def build_blocks(segments: DataFrame) -> DataFrame:
    """The same postings, with the files of a term in lists: a term has one row for some thousand neighbouring bodies.

    Positions of all files of a block are one list, in which ``starts`` and ``tfs`` tell those of each file.
    """
    lists = "file_ids array<bigint>, tfs array<int>, lengths array<int>, starts array<int>, positions array<int>"
    return _of_both_kinds(segments, f"term string, {lists}", _block_tokens, _block_bigrams, tx.cjk_runs(F.col("content")))


def blocks_of(postings: DataFrame) -> DataFrame:
    """Blocks of given postings, by a hash of the file."""
    part = F.pmod(F.xxhash64("file_id"), F.lit(64)).alias("part")
    entry = F.struct("file_id", "tf", "n_tokens", "positions")
    held = postings.groupBy("kind", "term", part).agg(F.sort_array(F.collect_list(entry)).alias("held"))
    sizes = F.transform("held.tf", lambda _, i: F.aggregate(F.slice("held.tf", 1, i), F.lit(0), lambda a, b: a + b))
    return held.select(
        "kind", "term", F.col("held.file_id").alias("file_ids"), F.col("held.tf").alias("tfs"),
        F.col("held.n_tokens").alias("lengths"), sizes.alias("starts"), F.flatten("held.positions").alias("positions"))


def single_blocks(postings: DataFrame) -> DataFrame:
    """Every row of postings as a block of its own."""
    lists = [F.array(c).alias(n) for c, n in (("file_id", "file_ids"), ("tf", "tfs"), ("n_tokens", "lengths"))]
    return postings.select("kind", "term", *lists, F.array(F.lit(0)).alias("starts"), "positions")


def postings_of(blocks: DataFrame, *others: str) -> DataFrame:
    """One row per (kind, term, file) of blocks, and the columns ``others``. Lists that nobody asks for are not read."""
    lists = ("tfs", "lengths", "starts", "positions")
    rows = blocks.select("kind", "term", *others, F.posexplode("file_ids").alias("_at", "file_id"), *lists)
    tf, begin = F.get("tfs", "_at"), F.get("starts", "_at")
    return rows.select(
        "kind", "term", "file_id", tf.alias("tf"), F.get("lengths", "_at").alias("n_tokens"),
        F.slice("positions", begin + 1, tf).alias("positions"), *others)


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("kind", "term").agg(F.count("*").alias("df"))


def block_term_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("kind", "term").agg(F.sum(F.size("file_ids")).alias("df"))


def corpus_stats(segments: DataFrame) -> DataFrame:
    """Document count and mean length over all bodies, scoped or not."""
    return segments.agg(
        F.count("*").alias("n_docs"), F.avg("n_tokens").cast("double").alias("avg_tokens")
    )


def grams(text: Column) -> Column:
    """All distinct substrings of one, two and three characters."""

    def of(n: int) -> Column:
        last = F.length(text) - n + 1
        return F.when(
            last >= 1,
            F.transform(
                F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                lambda i: F.substring(text, i, F.lit(n)),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def build_name_grams(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(gram, key, text) for exact substring search by equi-join."""
    lowered = rows.select(F.col(key), F.lower(text).alias("text"))
    cut = lowered.select(F.explode_outer(grams(F.col("text"))).alias("gram"), key, "text")
    return cut.where("gram is not null")


def build_name_trigrams(files: DataFrame) -> DataFrame:
    """Trigram rows of file names."""
    return (
        build_name_grams(files, "file_id", F.col("file_name"))
        .where(F.length("gram") == 3)
        .select(F.col("gram").alias("trigram"), "file_id")
    )


def substring_join(needles: DataFrame, needle: str, haystack: DataFrame, key: str, text: Column) -> DataFrame:
    """Rows of ``needles`` with every ``key`` whose text contains ``needle``.

    Both sides are cut into grams. Each needle looks only at its rarest gram, so a
    common one does not multiply rows, and ``contains`` settles the rest. Needles of
    up to three characters are a gram themselves.
    """
    cut = build_name_grams(haystack, key, text)
    wanted = needles.select(needle).distinct()
    long_enough = F.least(F.length(needle), F.lit(3))
    probes = wanted.select(
        needle, F.explode_outer(F.filter(grams(F.lower(needle)), lambda g: F.length(g) == long_enough)).alias("gram")
    )
    frequency = cut.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        probes.join(frequency, "gram", "left")
        .groupBy(needle)
        .agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    )
    found = rarest.join(cut, "gram").where(F.col("text").contains(F.lower(needle)))
    return needles.join(found.select(needle, key), needle)
