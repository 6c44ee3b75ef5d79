"""Relevance buckets, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scores as sc
from lodestone.functions import terms as tm
from lodestone.session import cut_lineage


def _bucket(share: Column) -> Column:
    return (11 - F.floor(share * 10 + 0.999999)).cast("int")


def _bin(score: Column) -> Column:
    """A coarse step function of the score.

    Scores are 0, the name constant, or negative within a few powers of ten, so the
    logarithm in steps of 1/256 gives some ten thousand bins however large the data is.
    """
    return (
        F.when(score < 0, -F.floor(F.log(-score) * 256))
        .when(score == 0, F.lit(1_000_000))
        .otherwise(F.lit(1_000_001))
        .cast("bigint")
    )


def bucket_edges(best: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The worst (rank, score) of every bucket: at most ten rows (per key).

    Equal scores are counted first. The running count then needs a global order only
    over the bins; inside a bin it is a window of its own.
    """
    keys = list(keys)
    counted = best.groupBy(*keys, "match_rank", "score").agg(F.count("*").alias("n"))
    counted = counted.withColumn("bin", _bin(F.col("score")))
    bins = counted.groupBy(*keys, "match_rank", "bin").agg(F.sum("n").alias("in_bin"))
    over_bins = Window.partitionBy(*keys).orderBy("match_rank", "bin")
    bins = bins.withColumn(
        "before", F.sum("in_bin").over(over_bins.rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bin")
    ).withColumn("total", F.sum("in_bin").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, "match_rank", "bin").orderBy("score")
    return (
        counted.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(bins, [*keys, "match_rank", "bin"])
        .withColumn("relevance_bucket", _bucket((F.col("before") + F.col("upto")) / F.col("total")))
        .groupBy(*keys, "relevance_bucket")
        .agg(F.max(F.struct("match_rank", "score")).alias("edge"))
    )


def bucket_from_edges(edges: Column) -> Column:
    """Bucket of a row: the highest one whose edge is not better than the row."""
    own = F.struct(F.col("match_rank"), F.col("score"))
    reached = F.filter(edges, lambda e: e["edge"] >= own)
    return F.array_max(F.transform(reached, lambda e: e["relevance_bucket"]))


def relevance_bucket(best: DataFrame, method: str = "counted") -> DataFrame:
    """Add ``relevance_bucket``, 10 for the best tenth down to 1.

    ``counted`` works at any size; ``window`` is the textbook form, for small results.
    """
    if method == "window":
        share = F.cume_dist().over(Window.orderBy("match_rank", "score"))
        return best.withColumn("relevance_bucket", _bucket(share))
    edges = (
        bucket_edges(best)
        .agg(F.collect_list(F.struct("relevance_bucket", "edge")).alias("v"))
        .scalar()
    )
    return best.withColumn("edges", edges).withColumn(
        "relevance_bucket", bucket_from_edges(F.col("edges"))
    ).drop("edges")


def add_scores(df: DataFrame, query_clicks: DataFrame | None, q: str, as_of: float) -> DataFrame:
    """Utility of each file and its click score for this very query."""
    clicks = F.col("click_count") + F.col("imported_click_count")
    df = df.withColumn("utility_score", sc.utility(clicks, F.col("importance"), F.col("mtime"), as_of))
    if query_clicks is None:
        return df.withColumn("query_click_score", F.lit(0.0))
    affinity = query_clicks.where(F.col("normalized_query") == tm.history_key(q)).select(
        "file_id",
        sc.query_affinity(F.col("click_count"), F.col("last_clicked_at"), as_of).alias("query_click_score"),
    )
    return df.join(affinity, "file_id", "left").withColumn(
        "query_click_score", F.coalesce("query_click_score", F.lit(0.0))
    )


def _order_column(sort_by: str) -> str:
    return {"created": "created_at", "modified": "mtime", "click_count": "click_count"}[sort_by]


DEFAULT_KEYS = (
    "filename_match_level",
    "has_top_tag",
    "query_click_score",
    "relevance_bucket",
    "utility_score",
    "mtime",
)


def order_keys(sort_by: str = "default", sort_order: str = "desc", merged: bool = False) -> list[Column]:
    """Sort keys of a result table.

    Explicit orders keep match quality first unless ``merged``: results joined with
    folders, records or found by pattern follow the asked column alone. Folders rank
    behind files on a tie, in path order, as their numbers are negative.
    """
    ascending = sort_order == "asc"

    def by(column, up: bool) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        return column.asc() if up else column.desc()

    is_folder = F.col("result_kind") == "folder"
    number = F.when(is_folder, F.lit(-1)).otherwise(F.col("file_id"))
    if sort_by == "default":
        return [F.col(k).desc() for k in DEFAULT_KEYS] + [number.desc(), F.col("full_path").asc()]
    if merged:
        return [by(_order_column(sort_by), ascending), by(number, ascending), by("full_path", not ascending)]
    return [
        F.col("match_rank").asc(),
        F.col("score").asc(),
        F.col("importance").desc(),
        by(_order_column(sort_by), ascending),
        F.col("file_id").desc(),
    ]


def regex_order_keys(sort_by: str = "default", sort_order: str = "desc") -> list[Column]:
    """Order in which a pattern search visits files; it decides a folder's first file."""
    clicks = F.col("click_count") + F.col("imported_click_count")
    if sort_by == "default":
        return [F.col("has_top_tag").desc(), clicks.desc(), F.col("mtime").desc(), F.col("file_id").desc()]
    column = clicks if sort_by == "click_count" else F.col(_order_column(sort_by))
    asked = column.asc_nulls_last() if sort_order == "asc" else column.desc()
    return [F.col("importance").desc(), asked, F.col("file_id").desc()]


def rank(df: DataFrame, sort_by: str = "default", sort_order: str = "desc", merged: bool = False) -> DataFrame:
    return df.orderBy(*order_keys(sort_by, sort_order, merged))


def page(df: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with ``position``. Planned as a distributed top-k."""
    rows = df.orderBy(*keys).offset(offset).limit(limit)
    # At most ``limit`` rows are left, so one ordered window is bounded.
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*keys)) + offset)


def page_info(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Total, rows on the page, whether more follow, and where they start."""
    returned = F.greatest(F.least(F.lit(limit), F.col("total") - offset), F.lit(0))
    end = F.col("returned") + offset
    return (
        df.agg(F.count("*").alias("total"))
        .withColumn("returned", returned)
        .withColumn("has_more", end < F.col("total"))
        .withColumn("next_offset", F.when(F.col("has_more"), end))
    )


def number_rows(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Consecutive numbers from 1 in the given order, without a single-task window.

    A range sort gives every partition its place in the order; the row's own index is
    part of ``monotonically_increasing_id``. The sorted rows are checkpointed, since
    both steps must see the same partitions.
    """
    bits = 33
    mono = F.monotonically_increasing_id()
    placed = cut_lineage(
        df.orderBy(*order)
        .withColumn("_mono", mono)
        .withColumn("_part", F.shiftright("_mono", bits))
        .withColumn("_index", F.col("_mono").bitwiseAND((1 << bits) - 1))
        .drop("_mono")
    )
    sizes = placed.groupBy("_part").agg((F.max("_index") + 1).alias("_size"))
    # One row per partition of the sort.
    starts = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_start"),
    )
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_index") + 1).cast("bigint").alias(name)
    )
