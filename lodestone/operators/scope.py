"""Which files a search may look at, and which results it must hide."""

from __future__ import annotations

from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import extensions as ext
from lodestone.functions import paths as px
from lodestone.functions import rules as rl
from lodestone.request import SearchRequest

SOURCES = {"local": ("local",), "web": ("web",), "local_web": ("local", "web")}


def of_source(source_type: Column, wanted: str) -> Column:
    return source_type.isin(*SOURCES[wanted])


def day_range(seconds: Column, first: date | None, last: date | None) -> Column:
    """Days in the session's time zone, the last one included."""

    def midnight(day: date) -> Column:
        return F.unix_micros(F.to_timestamp(F.lit(day.isoformat()))) / 1e6

    test = F.lit(True)
    if first is not None:
        test = test & (seconds >= midnight(first))
    if last is not None:
        test = test & (seconds < midnight(last + timedelta(days=1)))
    return test


def top_roots(targets: DataFrame) -> DataFrame:
    """Keys of registered roots that lie under no other registered root."""
    keys = targets.select(px.root_key(F.col("full_path")).alias("key"), "full_path").distinct()
    above = keys.select("key", F.explode_outer(px.ancestor_keys(F.col("key"))).alias("above"))
    nested = above.join(keys.select(F.col("key").alias("above")), "above", "left_semi")
    return keys.join(nested.select("key"), "key", "left_anti").select("key").distinct()


def chosen_targets(targets: DataFrame, source: str) -> DataFrame:
    """Enabled roots of the source; all registered ones when none is enabled."""
    mine = targets.where(of_source(F.col("source_type"), source))
    none_enabled = mine.agg(
        F.coalesce(F.max(F.col("is_enabled").cast("int")), F.lit(0)).alias("m")
    ).scalar()
    return mine.where(F.col("is_enabled") | (none_enabled == 0))


def in_targets(files: DataFrame, targets: DataFrame, source: str = "local") -> DataFrame:
    """Files below a chosen root.

    Only outermost roots are compared, so a file meets at most one of them and the
    semi-join on its exploded ancestors keeps each file once. (``explode_outer``, here and
    elsewhere: for ``explode`` the optimizer adds a filter that computes the list twice.)
    """
    roots = top_roots(chosen_targets(targets, source)).withColumnRenamed("key", "above")
    exploded = files.withColumn("above", F.explode_outer(px.ancestor_keys(F.col("normalized_path"))))
    return exploded.join(roots, "above", "left_semi").drop("above")


def scope_files(files: DataFrame, request: SearchRequest, targets: DataFrame | None = None) -> DataFrame:
    path = F.col("normalized_path")
    scoped = files.where(of_source(F.col("source_type"), request.source_type))
    if request.full_path:
        scoped = scoped.where(
            px.under(path, request.full_path, include_root=request.source_type == "web")
        )
        if request.max_depth is not None:
            scoped = scoped.where(px.within_depth(path, request.full_path, request.max_depth))
    elif not request.search_all:
        if targets is None:
            return scoped.where(F.lit(False))
        scoped = in_targets(scoped, targets, request.source_type)
    if request.types:
        wanted = ext.extension_filter(
            request.types, request.extra_content_extensions, request.extra_filename_extensions
        )
        scoped = scoped.where(ext.with_extensions(F.col("file_ext"), wanted))
    dated = F.col("created_at") if request.date_field == "created" else F.col("mtime")
    if request.date_from or request.date_to:
        scoped = scoped.where(day_range(dated, request.date_from, request.date_to))
    return scoped


def mentions(terms: list[str], *columns: Column) -> Column:
    """Some term occurs in some column; NULL counts as empty."""
    test = F.lit(False)
    for term in terms:
        for column in columns:
            test = test | F.coalesce(F.lower(column).contains(term.lower()), F.lit(False))
    return test


def exclude_terms(df: DataFrame, terms: list[str], body: str | None = "content") -> DataFrame:
    columns = [F.col("file_name"), px.parent_folder(F.col("normalized_path"), F.col("file_name"))]
    return df.where(~mentions(terms, *columns, *([F.col(body)] if body else [])))


def exclude_paths(df: DataFrame, rules, root: str = "", path: str = "normalized_path") -> DataFrame:
    return df.where(~rl.excluded_result(F.col(path), rules, root))


def filter_ext(df: DataFrame, text: str) -> DataFrame:
    return df.where(ext.exact_extension(F.col("file_ext"), text))


def filter_paths(df: DataFrame, keyword: str = "", hidden: list[str] = (), path: str = "full_path") -> DataFrame:
    """Folder list filter: keep one keyword, hide others."""
    lowered = F.lower(path)
    kept = df.where(lowered.contains(keyword.strip().lower())) if keyword.strip() else df
    for word in filter(None, (h.strip().lower() for h in hidden)):
        kept = kept.where(~lowered.contains(word))
    return kept


# --- roots and paths ---------------------------------------------------------

#: Roots that every task may hold; more are joined.
MOST_ROOTS = 50_000


def _few(df: DataFrame) -> list | None:
    """The rows, or None if they are more than ``MOST_ROOTS``."""
    rows = df.limit(MOST_ROOTS + 1).collect()
    return rows if len(rows) <= MOST_ROOTS else None


def _chain(path: str) -> Column:
    """Keys of the folders above a path and of the path itself, nearest last."""
    return F.array_union(px.ancestor_keys(F.col(path)), F.array(px.root_key(F.col(path))))


def covering_root(paths: DataFrame, targets: DataFrame, path: str = "path") -> DataFrame:
    """Deepest enabled root at or above each path; NULL when none covers it.

    Up to ``MOST_ROOTS`` roots go to every task as a table of keys, and each path steps up its folders until
    one is a root: no row of ``paths`` moves. More roots are met by an equi-join over the exploded folders.
    """
    roots = targets.where("is_enabled").select(
        px.root_key(F.col("full_path")).alias("key"), "source_type", F.col("full_path").alias("root")
    )
    few = _few(roots.distinct())
    covered = F.col("covering_root").isNotNull().alias("is_covered")
    if few is None:
        return _covering_by_join(paths, roots, path).select("*", covered)
    by_key: dict[tuple[str, str], str] = {}
    for r in few:
        if r.source_type is not None and r.key is not None:
            known = by_key.get((r.source_type, r.key), "")
            by_key[r.source_type, r.key] = max(known, r.root, key=lambda x: (len(x), x))
    shared = paths.sparkSession.sparkContext.broadcast(by_key)

    @F.pandas_udf("string")
    def deepest(chains: pd.Series, kinds: pd.Series) -> pd.Series:
        known = shared.value
        up = (next((known[kind, key] for key in reversed(chain) if (kind, key) in known), None) if chain is not None else None for chain, kind in zip(chains, kinds, strict=True))
        return pd.Series(list(up), dtype=object)

    return paths.withColumn("covering_root", deepest(_chain(path), F.col("source_type"))).select("*", covered)


def _covering_by_join(paths: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    keyed = paths.select(path, "source_type").distinct()
    candidates = keyed.withColumn("key", F.explode_outer(_chain(path)))
    best = (
        candidates.join(roots, ["key", "source_type"])
        .groupBy(path, "source_type")
        .agg(F.max_by("root", F.struct(F.length("root"), "root")).alias("covering_root"))
    )
    return paths.join(best, [path, "source_type"], "left")


def overlapping_roots(paths: DataFrame, targets: DataFrame, path: str = "path") -> DataFrame:
    """Pairs (path, root) where one equals or contains the other.

    Up to ``MOST_ROOTS`` roots, with their folders, are broadcast; more are joined by a shuffle.
    """
    left = paths.select(path, px.root_key(F.col(path)).alias("pk")).distinct()
    right = targets.select(F.col("full_path").alias("root"), px.root_key(F.col("full_path")).alias("rk")).distinct()
    right = F.broadcast(right) if _few(right) is not None else right

    def upwards(df: DataFrame, key: str) -> DataFrame:
        chain = F.array_union(px.ancestor_keys(F.col(key)), F.array(key))
        return df.withColumn("up", F.explode_outer(chain))

    below = upwards(left, "pk").join(right, F.col("up") == F.col("rk")).select(path, "root")
    above = left.join(upwards(right, "rk"), F.col("up") == F.col("pk")).select(path, "root")
    return below.unionByName(above).distinct()
