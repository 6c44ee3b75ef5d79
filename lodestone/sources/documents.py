"""Inputs that become documents: tables of texts, stored pages, files on disk."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions import extensions as ext
from lodestone.functions import paths as px
from lodestone.functions import rules as rl
from lodestone.functions import urls as ux
from lodestone.operators.extract import extract_pages, extract_text, pin_tag_and_names
from lodestone.schemas import FAILURES, FILES, conform
from lodestone.session import cut_lineage
from lodestone.sources import listing as ls


def from_documents(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """Document rows from a table that already holds text.

    ``mapping`` names a column or expression per file column and for ``content``.
    What it leaves out is derived: name from the path, extension from the name, id
    from the path, properties from the head of ``.md`` bodies.
    """
    given = {k: (F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()}
    docs = df.select(*given.values())
    if "file_name" not in given:
        docs = docs.withColumn("file_name", px.name_of(F.col("normalized_path")))
    if "file_ext" not in given:
        docs = docs.withColumn("file_ext", ext.resolve_extension(F.col("file_name"), ext.known_extensions()))
    if "file_id" not in given:
        docs = docs.withColumn("file_id", F.xxhash64("normalized_path"))
    if "source_type" not in given:
        docs = docs.withColumn("source_type", F.lit("local"))
    if not {"title", "aliases", "has_top_tag"} & set(given):
        docs = pin_tag_and_names(docs)
    content = docs["content"] if "content" in docs.columns else F.lit(None).cast("string")
    return _with_content(docs, content)


def _with_content(docs: DataFrame, content: Column) -> DataFrame:
    layout = StructType([*FILES.fields, StructField("content", StringType())])
    return conform(docs.withColumn("content", content), layout)


def from_pages(pages: DataFrame, fetched_at: float | Column) -> DataFrame:
    """Document rows of stored pages (url, html): named by title, extension ``.html``.

    Pages whose URLs are the same when normalised (they differ by fragment, say) are one
    document: the latest by ``page_id`` where there is such a column, else the one with
    the least html.
    """
    at = fetched_at if isinstance(fetched_at, Column) else F.lit(fetched_at)
    url = ux.normalize_url(F.col("url"))
    newest = -F.col("page_id") if "page_id" in pages.columns else F.xxhash64("html")
    # Only a number and a hash of each page meet, and the texts follow by a semi-join.
    ranked = pages.where(ux.is_web_url(F.col("url"))).withColumns(
        {"_url": url, "_rank": F.struct(newest.alias("newest"), F.xxhash64("url", "html").alias("hash"))}
    )
    first = ranked.groupBy("_url").agg(F.min("_rank").alias("_rank"))
    chosen = ranked.join(first, ["_url", "_rank"], "left_semi").dropDuplicates(["_url", "_rank"])
    read = extract_pages(chosen)
    docs = read.select(
        F.xxhash64(url).alias("file_id"),
        F.lit("web").alias("source_type"),
        url.alias("normalized_path"),
        F.when(F.col("title") != "", F.col("title")).otherwise(ux.url_name(url)).alias("file_name"),
        F.lit(".html").alias("file_ext"),
        at.alias("created_at"),
        at.alias("mtime"),
        F.octet_length("html").alias("size"),
        "content",
    )
    return _with_content(docs, F.col("content"))


def list_files(
    spark: SparkSession,
    root: str,
    depth: int | None = None,
    extensions: Iterable[str] | None = None,
    rules: Iterable[str] = (),
    with_bytes: bool = True,
) -> DataFrame:
    """Files below ``root``: path, name, extension, times, size and, if asked, bytes.

    Empty files are listed, and names that begin with ``_`` or ``.``. Extensions, depth and rules are applied to the
    listing, before any content is read.
    """
    root = root if root == "/" else root.rstrip("/")
    listing = ls.listing(spark, root, depth).withColumn("normalized_path", F.regexp_replace("path", r"^file:/+", "/"))
    plain_root = ls.local_path(root)
    wanted = sorted(extensions) if extensions else ext.known_extensions()
    listing = listing.withColumn("file_name", px.name_of(F.col("normalized_path"))).withColumn(
        "file_ext", ext.resolve_extension(F.col("file_name"), wanted)
    )
    listing = listing.where(F.col("file_ext").isNotNull())
    if depth is not None:
        listing = listing.where(px.within_depth(F.col("normalized_path"), plain_root, depth))
    rules = list(rules)
    if rules:
        below = F.substring("normalized_path", F.lit(len(px.path_prefix(plain_root)) + 1), F.length("normalized_path"))
        listing = listing.where(
            ~rl.excluded_by_name(below, rules) & ~rl.excluded_by_path(F.col("normalized_path"), rules)
        )
    found = listing.select(
        "normalized_path",
        "file_name",
        "file_ext",
        F.col("mtime").alias("created_at"),
        "mtime",
        F.col("length").alias("size"),
    )
    return ls.with_bytes(found, "normalized_path") if with_bytes else found


def read_files(
    spark: SparkSession,
    root: str,
    depth: int | None = None,
    extensions: Iterable[str] | None = None,
    rules: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Documents and failures of a folder tree.

    The extracted rows are kept as a table, as both results (and every filter on them)
    would otherwise run the readers again.
    """
    extracted = extract_text(list_files(spark, root, depth, extensions, rules)).drop("bytes")
    return split_failures(cut_lineage(extracted))


def split_failures(extracted: DataFrame, failed_at: float | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that were read, and one failure row for each that was not."""
    at = F.unix_micros(F.current_timestamp()) / 1e6 if failed_at is None else failed_at
    at = at if isinstance(at, Column) else F.lit(at)
    good = extracted.where(F.col("error").isNull()).withColumn("source_type", F.lit("local"))
    good = pin_tag_and_names(good.withColumn("file_id", F.xxhash64("normalized_path")))
    bad = extracted.where(F.col("error").isNotNull()).select(
        "normalized_path",
        "file_name",
        F.col("error").alias("error_message"),
        at.alias("last_failed_at"),
    )
    return _with_content(good, F.col("content")), conform(bad, FAILURES)
