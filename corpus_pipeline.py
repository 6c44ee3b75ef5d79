"""Training corpus from ``documents``: five stages, each kept as Parquet in the shared folder and read again.

Every stage works on all that its predecessor kept. Equal keys are told apart by their texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, contamination, near, quality, toxicity
from lodestone.llm.common import kept, table
from lodestone.llm.queries import BPE_RANKS


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    columns, known = docs.columns, {"held_out", "score", "predicted"}
    rated = quality.classify(docs.withColumnsRenamed({c: f"_{c}" for c in known}), table(spark, sf_dir, "labels"))
    return rated.where("predicted = 1").drop(*known).withColumnsRenamed({f"_{c}": c for c in known}).select(*columns)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity regression doesn't reject."""
    columns, known = docs.columns, {"severity", "p_toxic", "toxic"}
    rated = toxicity.rate(docs.withColumnsRenamed({c: f"_{c}" for c in known}), table(spark, sf_dir, "labels"))
    return rated.where("not toxic").drop(*known).withColumnsRenamed({f"_{c}": c for c in known}).select(*columns)


#: Part of their shingles of five words that near copies have in common.
LIKENESS = 0.8


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by fingerprints and by the shingles themselves."""
    return near.representatives(docs, likeness=LIKENESS)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether the ids give the text back.

    Columns of the documents that are named like these or like a helper come back as ``docs_<name>``.
    """
    ranks = bpe.read_ranks(public_tokenizers.path(BPE_RANKS))
    known = {"ids", "decoded", "n_tokens", "round_trip", "_piece", "_digest"}
    docs = docs.withColumnsRenamed({c: f"docs_{c}" for c in known})
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.withColumns({"n_tokens": F.size("ids").cast("bigint"), "round_trip": same}).drop("decoded")


STAGES = [
    ("quality classifier", good),
    ("toxicity", civil),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", untested),
    ("byte-level BPE", encoded),
]

#: A trained network, hashes and merges can't be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
    return docs
