"""Small reports over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.terms import casefold
from lodestone.operators.folders import folder_rollup


def _order(*keys: str):
    """Sort keys by column name, made when a session exists; a minus sign turns one round."""
    return lambda: [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys]


FOLDERS_LATEST = _order("-last_indexed_at", "-full_path")
FOLDERS_LARGEST = _order("-indexed_file_count", "full_path")
PAGES_LATEST = _order("-last_indexed_at", "full_path")
ROOTS = _order("-is_enabled", "full_path")
FAILURES_NEWEST = _order("-last_failed_at", "normalized_path")


def indexed_folders(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Folders with their own file count, latest first."""
    return folder_rollup(files, targets).orderBy(*FOLDERS_LATEST())


def indexed_pages(files: DataFrame) -> DataFrame:
    """Stored pages, one entry each."""
    return (
        files.where("source_type = 'web'")
        .select(
            F.col("normalized_path").alias("full_path"),
            F.col("indexed_at").alias("last_indexed_at"),
            F.lit(1).cast("bigint").alias("indexed_file_count"),
        )
        .orderBy(*PAGES_LATEST())
    )


def folder_list_order(folders: DataFrame) -> DataFrame:
    return folders.orderBy(*FOLDERS_LARGEST())


def registered_roots(targets: DataFrame) -> DataFrame:
    columns = ("full_path", "source_type", "is_enabled", "last_indexed_at", "indexed_file_count")
    return targets.select(*columns).orderBy(*ROOTS())


def failure_list(failures: DataFrame) -> DataFrame:
    return failures.orderBy(*FAILURES_NEWEST())


def corpus_status(files: DataFrame) -> DataFrame:
    """Size, errors and newest index time per source."""
    return files.groupBy("source_type").agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("last_error").isNotNull()).alias("error_count"),
        F.sum("size").alias("total_bytes"),
        F.max("indexed_at").alias("last_indexed_at"),
    )


def run_statistics(diff: DataFrame, failures: DataFrame) -> DataFrame:
    """Files seen, written, skipped, removed and failed in one refresh."""
    failed = failures.select("normalized_path", F.lit(True).alias("failed"))
    rows = diff.join(failed, "normalized_path", "left")
    is_bad = F.coalesce("failed", F.lit(False))
    written = F.col("change").isin("new", "changed") & ~is_bad
    return rows.agg(
        F.count_if(F.col("change") != "missing").alias("files"),
        F.count_if(written).alias("writes"),
        F.count_if(F.col("change") == "unchanged").alias("skipped"),
        F.count_if(F.col("change") == "missing").alias("removed"),
        F.count_if(is_bad).alias("errors"),
    )


def change_counts() -> list[Column]:
    """What a diff counts of itself while it is written."""
    return [F.count_if(F.col("change") == kind).alias(kind) for kind in ("new", "changed", "unchanged", "missing")]


def error_count() -> Column:
    """What an extraction counts of itself while it is written."""
    return F.count_if(F.col("error").isNotNull()).alias("errors")


def observed_statistics(spark: SparkSession, changes: dict, reading: dict) -> DataFrame:
    """The numbers of :func:`run_statistics`, from what was observed in the passes that a refresh makes anyway.

    Only new and changed files are read, so every error is one of them.
    """
    again = changes["new"] + changes["changed"]
    row = (again + changes["unchanged"], again - reading["errors"], changes["unchanged"], changes["missing"], reading["errors"])
    return spark.createDataFrame([row], "files bigint, writes bigint, skipped bigint, removed bigint, errors bigint")


def synonym_conflicts(rules: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Terms that more than one group claims, or that are exclusion rules as well."""
    claims = rules.groupBy(casefold("term").alias("term")).agg(
        F.count_distinct("group_id").alias("groups"), F.min("group_id").alias("winning_group")
    )
    excluded = exclusions.select(casefold("rule").alias("term")).distinct().withColumn("is_excluded", F.lit(True))
    return (
        claims.join(excluded, "term", "left")
        .withColumn("is_excluded", F.coalesce("is_excluded", F.lit(False)))
        .where((F.col("groups") > 1) | F.col("is_excluded"))
    )


def click_counters(clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counters per file, and per (query, file) with the latest time.

    ``clicks`` holds (file_id, normalized_query, clicked_at). A blank query counts for
    the file only.
    """
    per_file = clicks.groupBy("file_id").agg(F.count("*").alias("click_count"))
    per_query = (
        clicks.where("normalized_query != ''")
        .groupBy("normalized_query", "file_id")
        .agg(F.count("*").alias("click_count"), F.max("clicked_at").alias("last_clicked_at"))
    )
    return per_file, per_query


def apply_clicks(files: DataFrame, per_file: DataFrame) -> DataFrame:
    """Add new clicks to the stored counters."""
    new = per_file.select("file_id", F.col("click_count").alias("new_clicks"))
    return files.join(new, "file_id", "left").select(
        *[
            (F.col(c) + F.coalesce("new_clicks", F.lit(0))).alias(c) if c == "click_count" else F.col(c)
            for c in files.columns
        ]
    )
