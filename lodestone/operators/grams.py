"""Stored three-character grams of bodies, names and words, and what is looked up in them.

One table, sorted by kind and gram, tells which files hold a gram in their body ('body'), which in a name, title or
alias ('name'), and which words of the vocabulary hold it ('term'). It keeps the holders in lists and is read as rows
(kind, gram, file_id, term). A second one counts. A lookup reads the pages of the few grams it asks for; whoever
looks up verifies on the text itself.

Bodies: grams of three printable ASCII characters, folded as patterns fold them. Names and words: grams of one to
three characters of any script, lower-cased, so that short needles are a gram themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import patterns as pt
from lodestone.operators import index as ix
from lodestone.session import cut_lineage, small_batches

#: Letters outside of ASCII that a pattern without regard to case takes for ASCII letters.
FOLDED = ("ſKıİ", "skii")
#: Of a literal's grams, so many of the rarest are asked for.
ASKED = 3
#: A condition that more than this share of the bodies may fulfil is not worth a lookup.
WORTH = 0.5
#: Files whose ids a plan may name; more are joined.
NAMED = 1_000


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, *FOLDED))


def _distinct_grams(value: str) -> np.ndarray:
    """The text's grams as numbers of three bytes, each once."""
    codes = np.frombuffer(value.encode("utf-8"), np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.empty(0, np.uint32)
    usable = (codes >= 0x20) & (codes <= 0x7E)
    whole = usable[:-2] & usable[1:-1] & usable[2:]
    found = np.sort((codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:])[whole])
    return found[np.diff(found, prepend=np.uint32(0)) != 0]


#: Pairs of a gram and its holder that a worker groups at once.
PAIRS_AT_ONCE = 1 << 20


def _blocks(grams: pa.Array, offsets: np.ndarray, holders: pa.Array) -> Iterator[pa.RecordBatch]:
    """Grams with lists of file ids or of terms, whichever the holders are."""
    held = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), holders)
    by_file = pa.types.is_integer(holders.type)
    none = pa.array([[]] * len(grams), pa.list_(pa.string() if by_file else pa.int64()))
    sides = (held, none) if by_file else (none, held)
    yield from pa.table([grams, *sides], ["gram", "file_ids", "terms"]).to_batches(ix.ROWS_AT_ONCE)


def _body_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per gram of some thousand bodies, with the files that hold it."""

    def grouped(found: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(found)
        holders = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
        codes, order = ix.in_order(codes)
        holders = holders[order]
        starts = np.flatnonzero(np.diff(codes, prepend=0))
        own = codes[starts]
        spelt = np.stack([own >> 16, own >> 8 & 255, own & 255], axis=1).astype(np.uint8)
        ends = pa.py_buffer(np.arange(0, 3 * len(own) + 1, 3, dtype=np.int32).tobytes())
        grams = pa.StringArray.from_buffers(len(own), ends, pa.py_buffer(spelt.tobytes()))
        yield from _blocks(grams, np.append(starts, len(codes)), pa.array(holders))

    found, ids, pairs = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            for file_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found.append(_distinct_grams(text))
                ids.append(file_id)
                pairs += len(found[-1])
            if pairs >= PAIRS_AT_ONCE:
                yield from grouped(found, ids)
                found, ids, pairs = [], [], 0
    if pairs:
        yield from grouped(found, ids)


def _text_blocks(named: bool):
    """A function that makes one row per gram of one to three characters, with the files (``named``) or the terms that hold it."""

    def grouped(held: dict) -> Iterator[pa.RecordBatch]:
        keys = [key for holders in held.values() for key in holders]
        offsets = np.cumsum([0, *map(len, held.values())])
        yield from _blocks(pa.array(list(held), pa.string()), offsets, pa.array(keys, pa.int64() if named else pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = defaultdict(list), 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}
                for gram in own:
                    if "\n" not in gram:
                        held[gram].append(key)
                pairs += len(own)
                if pairs >= PAIRS_AT_ONCE:
                    yield from grouped(held)
                    held, pairs = defaultdict(list), 0
        if held:
            yield from grouped(held)

    return run


def searchable(files: DataFrame) -> Column:
    """All names of a file in one text; no needle holds the sign between them."""
    return F.lower(F.concat_ws("\n", "file_name", "title", F.array_join("aliases", "\n")))


def gram_blocks(files: DataFrame, segments: DataFrame | None, terms: DataFrame | None) -> DataFrame:
    """(kind, gram, file_ids, terms) of names, of bodies where ``segments`` is given, of words where ``terms`` is.

    Holders are lists, those of some thousand texts, so that neither the shuffle nor the sort meets each pair.
    Linear in a text's length, which substrings by position are not.
    """
    small_batches(files.sparkSession)
    layout = "gram string, file_ids array<bigint>, terms array<string>"

    def cut(kind: str, rows: DataFrame, function) -> DataFrame:
        return rows.mapInArrow(function, layout).select(F.lit(kind).alias("kind"), "*")

    parts = [cut("name", files.select("file_id", searchable(files).alias("text")), _text_blocks(named=True))]
    if terms is not None:
        words = terms.where("kind = 'word'").select("term", F.col("term").alias("text"))
        parts.append(cut("term", words, _text_blocks(named=False)))
    if segments is not None:
        parts.append(cut("body", segments.select("file_id", folded(F.col("content")).alias("text")), _body_blocks))
    return reduce(DataFrame.unionByName, parts)


def grams_of(blocks: DataFrame, *others: str) -> DataFrame:
    """(kind, gram, file_id, term) of blocks, and the columns ``others``."""
    rows = blocks.select("kind", "gram", *others, F.explode(F.arrays_zip("file_ids", "terms")).alias("held"))
    return rows.select("kind", "gram", F.col("held.file_ids").alias("file_id"), F.col("held.terms").alias("term"), *others)


def build_grams(files: DataFrame, segments: DataFrame | None, terms: DataFrame | None) -> DataFrame:
    """(kind, gram, file_id, term), one row for each holder of a gram."""
    return grams_of(gram_blocks(files, segments, terms))


def gram_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("kind", "gram").agg(F.sum(F.size("file_ids") + F.size("terms")).alias("n"))


# --- one pattern --------------------------------------------------------------


def cut(literal: str) -> list[str]:
    return list(dict.fromkeys(literal[i : i + 3] for i in range(len(literal) - 2)))


def _literals(condition: pt.Condition) -> list[str]:
    if condition is None or isinstance(condition, str):
        return [condition] if condition else []
    return [x for part in condition.parts for x in _literals(part)]


def pattern_files(corpus, pattern: str) -> DataFrame | None:
    """Files whose body may match, by the grams that every match holds; None: no lookup can tell, or it doesn't pay.

    The counts of the pattern's own grams come to the driver: as many as the pattern has characters at most.
    """
    condition = pt.needs(pattern)
    if corpus.grams is None or not corpus.body_grams or condition is None:
        return None
    literals = list(dict.fromkeys(_literals(condition)))
    wanted = sorted({g for x in literals for g in cut(x)})
    counts = {r.gram: r.n for r in corpus.gram_counts.where((F.col("kind") == "body") & F.col("gram").isin(wanted)).collect()}
    total = corpus.statistics().select("n_docs").first()[0]
    asked = {x: sorted(cut(x), key=lambda g: (counts.get(g, 0), g))[:ASKED] for x in literals}

    def share(c: pt.Condition) -> float:
        if isinstance(c, str):
            return counts.get(asked[c][0], 0) / max(total, 1)
        shares = [share(p) for p in c.parts]
        return min(shares) if isinstance(c, pt.All) else sum(shares)

    if share(condition) > WORTH:
        return None

    def holds(c: pt.Condition) -> Column:
        if isinstance(c, str):
            return reduce(lambda a, b: a & b, [F.array_contains("has", g) for g in asked[c]])
        joined = [holds(p) for p in c.parts]
        return reduce((lambda a, b: a & b) if isinstance(c, pt.All) else (lambda a, b: a | b), joined)

    rows = corpus.grams.where((F.col("kind") == "body") & F.col("gram").isin(sorted({g for gs in asked.values() for g in gs})))
    return rows.groupBy("file_id").agg(F.collect_set("gram").alias("has")).where(holds(condition)).select("file_id")


def bodies_of(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """Bodies of the files ``ids``. A few are named in the scan, which opens their folders and row groups; more are joined."""
    ids = cut_lineage(ids)
    few = [r[0] for r in ids.limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return ix.bodies_of(segments, few)
    if "bucket" not in segments.columns:
        return segments.join(ids, "file_id", "left_semi")
    return segments.join(ids.withColumn("bucket", ix.id_bucket(F.col("file_id"))), ["bucket", "file_id"], "left_semi")


# --- needles -------------------------------------------------------------------


def rarest(needles: DataFrame, needle: str, counts: DataFrame, kind: str) -> DataFrame:
    """(needle, gram): the needle's rarest gram of the greatest stored length."""
    length = F.least(F.length(needle), F.lit(3))
    own = F.filter(ix.grams(F.lower(needle)), lambda g: F.length(g) == length)
    probes = needles.select(needle).distinct().select(needle, F.explode(own).alias("gram"))
    known = counts.where(F.col("kind") == kind).select("gram", "n")
    return probes.join(known, "gram", "left").groupBy(needle).agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))


def holders(needles: DataFrame, needle: str, corpus, kind: str) -> DataFrame:
    """Rows of ``needles`` with each ``file_id`` (kind 'name') or ``term`` ('term') that holds the needle's rarest gram.

    Words are verified here, as they are their own text; names by whoever reads the file rows.
    """
    column = "term" if kind == "term" else "file_id"
    rows = corpus.grams.where(F.col("kind") == kind).select("gram", F.col(column).alias("_held"))
    # Needles learn their gram before holders join, so that these move once.
    probes = needles.join(cut_lineage(rarest(needles, needle, corpus.gram_counts, kind)), needle)
    found = probes.join(rows, "gram").select(*needles.columns, "_held")
    if kind == "term":
        found = found.where(F.contains("_held", F.lower(needle)))
    return found.withColumnRenamed("_held", column)


def named_files(corpus, groups: list[list[str]]) -> DataFrame | None:
    """Files that may hold a variant of every term in a name; None without stored grams.

    The counts of the request's own grams come to the driver.
    """
    if corpus.grams is None or any(not v for group in groups for v in group):
        return None
    size = lambda v: min(3, len(v))
    cuts = {v: list({v[i : i + size(v)] for i in range(len(v) - size(v) + 1)}) for group in groups for v in map(str.lower, group)}
    wanted = sorted({g for gs in cuts.values() for g in gs})
    counts = {r.gram: r.n for r in corpus.gram_counts.where((F.col("kind") == "name") & F.col("gram").isin(wanted)).collect()}
    asked = {v: min(sorted(gs), key=lambda g: counts.get(g, 0)) for v, gs in cuts.items()}
    rows = corpus.grams.where((F.col("kind") == "name") & F.col("gram").isin(sorted(set(asked.values()))))
    some = [reduce(lambda a, b: a | b, [F.array_contains("has", asked[v.lower()]) for v in group]) for group in groups]
    return rows.groupBy("file_id").agg(F.collect_set("gram").alias("has")).where(reduce(lambda a, b: a & b, some)).select("file_id")
