"""Clicks as a stream: counters per file and per (query, file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestone.operators.reports import click_counters


def deduplicated(clicks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event id once; state older than the watermark is dropped.

    ``clicks`` holds (event_id, file_id, normalized_query, ts).
    """
    return clicks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def write_counters(clicks: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour") -> DataStreamWriter:
    """Stream writer of counter deltas.

    A micro-batch is summed before it is written, into a folder named by its batch id.
    A batch that is run again after a failure overwrites its own folder, so no click is
    counted twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("clicked_at", F.unix_micros("ts") / 1e6)
        rows = rows.persist()
        per_file, per_query = click_counters(rows)
        per_file.write.mode("overwrite").parquet(f"{path}/per_file/batch={batch_id}")
        per_query.write.mode("overwrite").parquet(f"{path}/per_query/batch={batch_id}")
        rows.unpersist()

    return (
        deduplicated(clicks, lateness)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )


def read_counters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Counters summed over all batches."""
    per_file = spark.read.schema("file_id bigint, click_count bigint, batch bigint").parquet(f"{path}/per_file")
    per_query = spark.read.schema(
        "normalized_query string, file_id bigint, click_count bigint, last_clicked_at double, batch bigint"
    ).parquet(f"{path}/per_query")
    return (
        per_file.groupBy("file_id").agg(F.sum("click_count").alias("click_count")),
        per_query.groupBy("normalized_query", "file_id").agg(
            F.sum("click_count").alias("click_count"), F.max("last_clicked_at").alias("last_clicked_at")
        ),
    )
