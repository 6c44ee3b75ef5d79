"""A corpus of any size with a known number of hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: 2026-04-19 00:00 UTC, the date of every generated file.
CREATED_AT = 1776556800.0


# Size, hit pattern, paths and wording of the generated corpus, here and below.
@dataclass(frozen=True)
class Shape:
    total_files: int = 3_000_000
    folders: int = 300
    target_folder: int = 42
    query: str = "needle"
    target_every: int = 500
    global_every: int = 2_000

    @property
    def per_folder(self) -> int:
        if self.total_files % self.folders:
            raise ValueError("total_files must be a multiple of folders")
        return self.total_files // self.folders

    @property
    def target_root(self) -> str:
        return f"/benchmark/folder_{self.target_folder:06d}"


def is_hit(row: Column, shape: Shape) -> Column:
    folder, place = F.floor(row / shape.per_folder), row % shape.per_folder
    in_target = (folder == shape.target_folder) & (place % shape.target_every == 0)
    return in_target | (row % shape.global_every == 0)


def generate_corpus(spark: SparkSession, shape: Shape = Shape(), rows: DataFrame | None = None) -> DataFrame:
    """Document rows. ``rows`` may supply the running number ``id`` from a table."""
    rows = spark.range(shape.total_files) if rows is None else rows
    n = F.col("id")
    folder, place = F.floor(n / shape.per_folder), n % shape.per_folder
    path = F.format_string(
        "/benchmark/folder_%06d/sub_%03d/file_%05d.md", folder, F.floor(place / 1000), place
    )
    word = F.when(is_hit(n, shape), F.lit(f"{shape.query} ")).otherwise("")
    return rows.select(
        (n + 1).alias("file_id"),
        F.lit("local").alias("source_type"),
        path.alias("normalized_path"),
        F.format_string("file_%05d.md", place).alias("file_name"),
        F.lit(".md").alias("file_ext"),
        F.lit(CREATED_AT).alias("created_at"),
        F.lit(CREATED_AT).alias("mtime"),
        F.lit("").alias("title"),
        F.concat(F.lit("alpha "), word, F.lit("benchmark document "), n + 1).alias("content"),
    ).withColumn("size", F.octet_length("content").cast("bigint"))


def expected_hits(rows: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Hits in the target folder and in all, counted from running numbers alone."""
    n = F.col("id")
    in_target = F.floor(n / shape.per_folder) == shape.target_folder
    hit = is_hit(n, shape)
    return rows.agg(
        F.count_if(hit & in_target).alias("target_hits"), F.count_if(hit).alias("global_hits")
    )
