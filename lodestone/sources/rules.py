"""Rule texts as tables: synonym groups, exclusion rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import rules as rl
from lodestone.functions.terms import distinct_variants


def synonym_rules(lines: DataFrame) -> DataFrame:
    """(group_id, position, term) of lines (group_id, value), one group per line.

    Terms are split at ``,`` or ``，``; the first spelling of a folded term stays.
    """
    pieces = F.transform(F.split(F.translate("value", "，", ","), ","), lambda t: F.btrim(t))
    terms = F.filter(pieces, lambda t: t != "")
    unique = distinct_variants(F.get(terms, 0), terms)
    rows = lines.where("value is not null").withColumn("members", F.when(F.size(terms) > 0, unique))
    return rows.select("group_id", F.posexplode_outer("members").alias("position", "term")).where("term is not null")


def read_synonym_rules(spark: SparkSession, path: str) -> DataFrame:
    """Groups of one small text file, numbered in line order."""
    lines = (
        spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.split("value", r"\r?\n")))
    )
    return synonym_rules(lines.toDF("group_id", "value"))


def synonym_groups(text: str) -> tuple[tuple[str, ...], ...]:
    """The same groups as plain values, for a single request."""
    from lodestone.functions.terms import fold_unique

    lines = (line.replace("，", ",").split(",") for line in (text or "").splitlines())
    groups = (tuple(fold_unique(t.strip() for t in line if t.strip())) for line in lines)
    return tuple(group for group in groups if group)


def exclusion_rules(lines: DataFrame | None = None, spark: SparkSession | None = None) -> DataFrame:
    """(position, rule, is_path): each rule once. Paths keep their case, names do not.

    Without lines the default list is returned.
    """
    if lines is None:
        spark = spark or SparkSession.active()
        lines = spark.createDataFrame(list(enumerate(rl.DEFAULT_RULES)), "position int, value string")
    cleaned = lines.select("position", F.btrim("value").alias("rule")).where("rule != ''")
    is_path = F.col("rule").contains("/") | F.col("rule").contains("\\")
    keyed = cleaned.withColumn("is_path", is_path).withColumn(
        "key", F.when(F.col("is_path"), F.col("rule")).otherwise(F.lower("rule"))
    )
    first = Window.partitionBy("key").orderBy("position")
    return (
        keyed.withColumn("n", F.row_number().over(first)).where("n = 1").select("position", "rule", "is_path")
    )
