"""Search of free-form JSON records next to documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import terms as tm
from lodestone.operators import rank as rk
from lodestone.operators import snippets as sn

# Fields that hold links (never searched), in order of preference.
LINK_FIELDS = ("hyperlink", "link", "url", "href", "input_url", "external_url")
# Fields that identify and name a record, in order of preference.
ID_FIELDS = ("id", "task_id", "uid")
NAME_FIELDS = ("text", "title", "name", "label", "content")


def _flat(value) -> str:
    if isinstance(value, dict):
        fields = [(k, v) for k, v in value.items() if k.lower() not in LINK_FIELDS and v is not None]
        return " ".join(_flat(v) if isinstance(v, (dict, list)) else f"{k}: {v}" for k, v in fields)
    return " ".join(map(_flat, value)) if isinstance(value, list) else str(value)


@F.pandas_udf(T.StringType())
def _nested_text(record: pd.Series) -> pd.Series:
    return record.map(lambda r: None if r is None else _flat(json.loads(r)))


def record_text(record: Column) -> Column:
    """``key: value`` text of a record without its link fields.

    A flat record of strings and whole numbers is rewritten in the JVM; nested ones,
    and values whose text form needs a parser, pass through Arrow.
    """
    fields = F.from_json(record, "map<string,string>")
    simple = record.rlike(
        r'^\s*\{\s*(?:"[^"\\{}\[\]]*"\s*:\s*(?:"[^"\\{}\[\]]*"|-?(?:0|[1-9][0-9]{0,17}))\s*,?\s*)*\}\s*$'
    ) & (F.size(F.map_keys(fields)) == F.size(F.array_distinct(F.map_keys(fields))))
    pairs = F.filter(F.map_entries(fields), lambda e: ~F.lower(e["key"]).isin(*LINK_FIELDS))
    flat = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")
    return F.when(simple, flat).otherwise(_nested_text(F.when(~simple, record)))


def _first_text(record: Column, keys: tuple[str, ...]) -> Column:
    """First of the fields that is a non-blank string."""
    doc = F.try_parse_json(record)

    def text(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
        value = F.btrim(F.try_variant_get(doc, f"$.{key}", "string"))
        return F.when((kind == "STRING") & (value != ""), value)

    return F.coalesce(*[text(k) for k in keys])


def record_fields(records: DataFrame, position: str = "position") -> DataFrame:
    """Add record_id, record_name and record_link; the row number stands in for an id."""
    record = F.col("record")
    ids = [
        F.greatest(F.get_json_object(record, f"$.{k}").try_cast("bigint"), F.lit(1)) for k in ID_FIELDS
    ]
    rows = records.withColumn("record_id", F.coalesce(*ids, F.col(position)))
    return rows.withColumn(
        "record_name",
        F.coalesce(_first_text(record, NAME_FIELDS), F.concat(F.lit("Task "), F.col("record_id"))),
    ).withColumn("record_link", _first_text(record, LINK_FIELDS))


def search_records(records: DataFrame, q: str, target_path: str = "", as_of: float = 0.0, snippets: bool = True) -> DataFrame:
    """Records whose text holds every term and no excluded one, as result rows."""
    included, excluded = tm.split_query(q.strip())
    rows = records.withColumn("record_text", record_text(F.col("record")))
    lowered = F.lower("record_text")
    for term in included:
        rows = rows.where(lowered.contains(term.lower()))
    for term in excluded:
        rows = rows.where(~lowered.contains(term.lower()))
    rows = record_fields(rows)
    snippet = sn.record_snippet(F.col("record_text"), included) if snippets else F.lit("")
    return rows.select(
        (-F.col("record_id")).alias("file_id"),
        F.lit("file").alias("result_kind"),
        F.lit("record").alias("source_type"),
        F.lit(target_path).alias("target_path"),
        F.col("record_name").alias("file_name"),
        F.concat(F.lit("record://"), F.col("record_id")).alias("full_path"),
        F.lit(".record").alias("file_ext"),
        F.lit(as_of).alias("created_at"),
        F.lit(as_of).alias("mtime"),
        F.lit(0).cast("bigint").alias("click_count"),
        F.lit(0.0).alias("importance"),
        F.lit(False).alias("has_top_tag"),
        F.lit(0).alias("filename_match_level"),
        F.lit(0).alias("relevance_bucket"),
        F.lit(0.0).alias("utility_score"),
        F.lit(0.0).alias("query_click_score"),
        F.lit(0).alias("match_rank"),
        F.lit(0.0).alias("score"),
        F.lit("record").alias("segment_type"),
        snippet.alias("snippet"),
        "record_link",
    )


def union_records(
    results: DataFrame,
    records: DataFrame,
    keys: list[Column] | None = None,
    cap: int | None = None,
    record_order: list[Column] | None = None,
) -> DataFrame:
    """Documents and records in one result table.

    ``cap`` keeps the first so many of either side in its own order, a fixed property
    of interactive merging (1,000 there); by default both sides stay whole.
    """
    if cap is not None:
        results = results.orderBy(*(keys or rk.order_keys())).limit(cap)
        records = records.orderBy(*(record_order or [F.col("file_id").desc()])).limit(cap)
    return results.unionByName(records, allowMissingColumns=True)
