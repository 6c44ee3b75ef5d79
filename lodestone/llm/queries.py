"""The registered queries of this package and their SQL. One module for each operator stands beside it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, contamination, licenses, near, negatives, oracle, pages, quality, scoring, simhash, token_counts, toxicity, vector_codes
from lodestone.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(public_tokenizers.path(BPE_RANKS))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN).drop("text")


WORD_TOKENIZER, TOKEN_LIMIT = "word_bpe_49k.json", 2048


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(WORD_TOKENIZER), encoding="utf-8") as file:
        definition = file.read()
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), definition)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op9_near_copies")
def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", near.hex_of("fp").alias("fingerprint"), "component_id")


@query("op2_contamination", oracle.CONTAMINATION)
def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.contained(docs, table(spark, sf_dir, "benchmark"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.rate(docs, table(spark, sf_dir, "labels")).drop("text")


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited(table(spark, sf_dir, "documents"))


@query("op10_page_text")
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op7_chat", oracle.CHAT)
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


@query("op1_pseudo_likelihood")
def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op11_vector_codes", oracle.VECTOR_CODES)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_license_scan", oracle.LICENSES)
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("detections")


@query("op13_hard_negatives", oracle.HARD_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted))
