"""Table layouts. One place for names and types; loaders cast to these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("normalized_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_ext", T.StringType()),
        T.StructField("created_at", T.DoubleType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("click_count", T.LongType()),
        T.StructField("imported_click_count", T.LongType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("has_top_tag", T.BooleanType()),
        T.StructField("title", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("indexed_at", T.DoubleType()),
        T.StructField("last_error", T.StringType()),
    ]
)

SEGMENTS = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("n_tokens", T.IntegerType()),
    ]
)

# Bodies on disk lie in folders by a hash of their id.
ID_BUCKETS = 64
STORED_SEGMENTS = T.StructType([*SEGMENTS.fields, T.StructField("bucket", T.IntegerType())])

POSTINGS = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # 'word' or 'bigram'
        T.StructField("term", T.StringType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)

#: Stored postings: the files of a term in lists.
POSTING_BLOCKS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("file_ids", T.ArrayType(T.LongType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())),
        T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)

TERM_STATS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("df", T.LongType()),
    ]
)

GRAMS = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # 'body', 'name' or 'term'
        T.StructField("gram", T.StringType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("term", T.StringType()),
    ]
)

#: Stored grams: the holders of a gram in lists.
GRAM_BLOCKS = T.StructType(
    [*GRAMS.fields[:2], T.StructField("file_ids", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.StringType()))]
)

GRAM_COUNTS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("gram", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)

CORPUS_STATS = T.StructType(
    [
        T.StructField("n_docs", T.LongType()),
        T.StructField("avg_tokens", T.DoubleType()),
    ]
)

# As stored: sums, of which each version adds its own.
TOTALS = T.StructType([T.StructField("n_docs", T.LongType()), T.StructField("tokens", T.DoubleType())])

# Ids whose rows in older versions no longer count: as a file, or as a body.
REPLACED = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("kind", T.StringType())])

VERSIONS = T.StructType(
    [
        T.StructField("number", T.IntegerType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("given", T.ArrayType(T.StringType())),
    ]
)

FAILURES = T.StructType(
    [
        T.StructField("normalized_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("last_failed_at", T.DoubleType()),
    ]
)

QUERY_CLICKS = T.StructType(
    [
        T.StructField("normalized_query", T.StringType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("click_count", T.LongType()),
        T.StructField("last_clicked_at", T.DoubleType()),
    ]
)

TARGETS = T.StructType(
    [
        T.StructField("full_path", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("is_enabled", T.BooleanType()),
        T.StructField("exclude_rules", T.ArrayType(T.StringType())),
        T.StructField("index_depth", T.IntegerType()),
        T.StructField("selected_extensions", T.ArrayType(T.StringType())),
        T.StructField("last_indexed_at", T.DoubleType()),
        T.StructField("indexed_file_count", T.LongType()),
        T.StructField("index_version", T.IntegerType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("breadcrumb_links", T.ArrayType(T.StringType())),
        T.StructField("json_ld_blocks", T.ArrayType(T.StringType())),
    ]
)

_DEFAULTS = {
    "click_count": 0,
    "imported_click_count": 0,
    "importance": 0.0,
    "has_top_tag": False,
    "title": "",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; absent columns get their default."""
    columns = []
    for field in schema.fields:
        if field.name in df.columns:
            value = F.col(field.name).cast(field.dataType)
            if field.name in _DEFAULTS:
                value = F.coalesce(value, F.lit(_DEFAULTS[field.name]).cast(field.dataType))
            elif field.name == "aliases":
                value = F.coalesce(value, F.array().cast(field.dataType))
        elif field.name == "aliases":
            value = F.array().cast(field.dataType)
        else:
            value = F.lit(_DEFAULTS.get(field.name)).cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)
