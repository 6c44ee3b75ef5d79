"""Folders as results and as reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.functions import terms as tm
from lodestone.operators import rank as rk
from lodestone.operators import scope as so
from lodestone.request import SearchRequest


def folder_hits(files: DataFrame, terms: list[str], excluded: list[str] = ()) -> DataFrame:
    """Parent folders that hold all terms, with their newest dates."""
    foldered = files.withColumn(
        "folder_path", px.parent_folder(F.col("normalized_path"), F.col("file_name"))
    )
    lowered = F.lower("folder_path")
    for term in terms:
        foldered = foldered.where(lowered.contains(term.lower()))
    for term in excluded:
        foldered = foldered.where(~lowered.contains(term.lower()))
    return foldered.groupBy("folder_path").agg(
        F.max("created_at").alias("created_at"), F.max("mtime").alias("mtime")
    )


def _folder_id(path: Column) -> Column:
    """A stable negative number; the order among folders follows their paths."""
    return -F.shiftrightunsigned(F.xxhash64(path), 1) - 1


def _as_results(folders: DataFrame, request: SearchRequest) -> DataFrame:
    return folders.select(
        _folder_id(F.col("folder_path")).alias("file_id"),
        F.lit("folder").alias("result_kind"),
        F.lit("local").alias("source_type"),
        F.lit(request.full_path).alias("target_path"),
        px.folder_name(F.col("folder_path")).alias("file_name"),
        F.col("folder_path").alias("full_path"),
        F.lit("").alias("file_ext"),
        "created_at",
        "mtime",
        F.lit(0).cast("bigint").alias("click_count"),
        F.lit(0.0).alias("importance"),
        F.lit(False).alias("has_top_tag"),
        F.lit(0).alias("filename_match_level"),
        F.lit(0).alias("relevance_bucket"),
        F.lit(0.0).alias("utility_score"),
        F.lit(0.0).alias("query_click_score"),
        F.lit(5).alias("match_rank"),
        F.lit(0.0).alias("score"),
        F.lit("folder").alias("segment_type"),
    )


def search_folders(scoped: DataFrame, request: SearchRequest) -> DataFrame:
    """Folder results of a request."""
    included, excluded = tm.split_query(request.q)
    hits = folder_hits(scoped, included, excluded)
    hits = so.exclude_paths(hits, request.exclude_rules, request.full_path, "folder_path")
    return _as_results(hits, request)


def folders_of_first_file(rows: DataFrame, request: SearchRequest) -> DataFrame:
    """Folder results of a pattern search: dates of the first file visited."""
    visits = Window.partitionBy("folder_path").orderBy(*rk.regex_order_keys(request.sort_by, request.sort_order))
    # every task passes on one file of a folder at most
    first = rows.withColumn("_visit", F.row_number().over(visits)).where(F.col("_visit") == 1)
    return _as_results(first.select("folder_path", "created_at", "mtime"), request)


def folder_rollup(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Every folder between a file and its nearest indexed root.

    Files are counted per folder first, so what is exploded and joined is folders.
    A folder counts its own files only; the newest index time rises to all ancestors.
    """
    folder = px.parent_folder(F.col("normalized_path"), F.col("file_name"))
    direct = (
        files.where(F.col("source_type") == "local")
        .groupBy(folder.alias("folder_path"))
        .agg(F.count("*").alias("direct"), F.max("indexed_at").alias("last_indexed_at"))
    )
    roots = targets.where(F.col("last_indexed_at").isNotNull() & (F.col("source_type") == "local")).select(
        px.root_key(F.col("full_path")).alias("above")
    ).distinct()
    own = px.root_key(F.col("folder_path"))
    chained = direct.withColumn("chain", F.array_union(px.ancestor_keys(own), F.array(own)))
    nearest = (
        chained.select("folder_path", F.explode_outer("chain").alias("above"))
        .join(roots, "above", "left_semi")
        .groupBy("folder_path")
        .agg(F.max(F.length("above")).alias("root_length"))
    )
    spread = (
        chained.join(nearest, "folder_path", "left")
        .withColumn(
            "up",
            F.explode_outer(
                F.filter(
                    "chain",
                    lambda a: F.length(a) >= F.coalesce(F.col("root_length"), F.length(own)),
                )
            ),
        )
    )
    return spread.groupBy(
        F.when(F.col("up") == "", F.lit("/")).otherwise(F.col("up")).alias("full_path")
    ).agg(
        F.sum(F.when(F.col("up") == own, F.col("direct")).otherwise(0)).alias("indexed_file_count"),
        F.max("last_indexed_at").alias("last_indexed_at"),
    )
