"""JSON records and access metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scores as sc

# Keys that may hold the list of records, in order of preference.
LIST_KEYS = ("tasks", "data", "items")
# Metric names of one document.
METRICS = (
    "accessCount", "backlinkCount", "lastOpenedAt", "modifiedAt",
    "outgoingLinkCount", "attachmentCount", "headingCount", "tagCount",
)


def from_json_records(df: DataFrame, column: str = "payload") -> DataFrame:
    """One row (position, record) per record of a list, or of a list under a known key.

    Records stay JSON text. Input columns other than the payload are kept.
    """
    payload = F.try_parse_json(column)
    as_list = "array<variant>"
    listed = F.when(
        F.schema_of_variant(payload).startswith("ARRAY"), F.try_variant_get(payload, "$", as_list)
    )
    for key in LIST_KEYS:
        inner = F.try_variant_get(payload, f"$.{key}", "variant")
        is_list = F.schema_of_variant(inner).startswith("ARRAY")
        listed = F.coalesce(listed, F.when(is_list, F.try_variant_get(payload, f"$.{key}", as_list)))
    rest = [c for c in df.columns if c != column]
    records = df.select(*rest, F.posexplode_outer(listed).alias("position", "v")).where("position is not null")
    return records.select(
        *rest, (F.col("position") + 1).alias("position"), F.to_json("v").alias("record")
    )


def _counter(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def read_access_metrics(df: DataFrame, root: str, column: str = "payload") -> DataFrame:
    """(normalized_path, clicks, one column per metric) of a metrics document.

    Metrics lie under ``fileMetrics``, ``files`` or ``metrics``; without them the plain
    counts of ``accessCounts`` are used. Paths are relative to ``root``. A plain count also
    stands in for the clicks of a structure that has none, never for its importance.
    """
    doc = F.col(column)
    as_map = "map<string,string>"

    def branch(name: str) -> Column:
        text = F.get_json_object(doc, f"$.{name}")
        return F.when(text.startswith("{"), F.from_json(text, as_map))

    found = [branch(n) for n in ("fileMetrics", "files", "metrics")]
    metrics = F.coalesce(*[F.when(F.size(m) > 0, m) for m in found])
    docs = df.select(
        F.xxhash64(doc).alias("doc"), metrics.alias("metrics"), branch("accessCounts").alias("counts")
    )
    key = ["doc", "relative"]
    rich = docs.select("doc", F.explode_outer("metrics").alias("relative", "value")).where("relative is not null")
    plain = docs.select(
        "doc", F.col("metrics").isNull().alias("alone"), F.explode_outer("counts").alias("relative", "count")
    ).where("relative is not null")
    # A map never travels with its rows: counts meet metrics in a join by path.
    rows = rich.join(plain.drop("alone"), key, "left").select("relative", "value", "count")
    rows = rows.unionByName(
        plain.where("alone").select("relative", F.col("count").alias("value"), F.lit(None).cast("string").alias("count"))
    )
    is_struct = F.col("value").startswith("{")
    fallback = F.coalesce("count", F.lit("0"))
    own = F.when(is_struct, _counter(F.col("value"), "accessCount")).otherwise(F.col("value"))
    clicks = F.when(is_struct, F.coalesce(own, fallback)).otherwise(own)
    prefix = root if root.endswith("/") else root + "/"
    return rows.select(
        F.concat(F.lit(prefix), F.col("relative")).alias("normalized_path"),
        clicks.alias("clicks"),
        own.alias("accessCount"),
        *[F.when(is_struct, _counter(F.col("value"), m)).alias(m) for m in METRICS if m != "accessCount"],
    )


def import_metrics(files: DataFrame, metrics: DataFrame, root: str, as_of: float) -> DataFrame:
    """Files with imported clicks and importance set from metrics.

    Below ``root`` both are reset first; elsewhere they stay. Metrics are unique per path.
    """
    from lodestone.functions import paths as px

    if "clicks" not in metrics.columns:
        metrics = metrics.withColumn("clicks", F.col("accessCount"))
    last = [F.last(m).alias(m) for m in ("clicks", *METRICS)]
    scored = metrics.groupBy("normalized_path").agg(*last).select(
        "normalized_path",
        sc.non_negative(F.col("clicks")).alias("new_clicks"),
        sc.importance(F.col, as_of).alias("new_importance"),
    )
    joined = files.join(scored, "normalized_path", "left")
    inside = px.under(F.col("normalized_path"), root)
    return joined.select(
        *[c for c in files.columns if c not in ("imported_click_count", "importance")],
        F.coalesce(
            "new_clicks", F.when(inside, F.lit(0)).otherwise(F.col("imported_click_count"))
        ).alias("imported_click_count"),
        F.coalesce("new_importance", F.when(inside, F.lit(0.0)).otherwise(F.col("importance"))).alias(
            "importance"
        ),
    )
