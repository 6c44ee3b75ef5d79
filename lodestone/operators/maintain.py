"""Keeping a corpus current: what changed, what to delete, which roots are stale."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.functions import rules as rl
from lodestone.operators import scope as so
from lodestone.operators.extract import pin_tag_and_names
from lodestone.session import cut_lineage

INDEX_VERSION = 1


def _folder_of() -> Column:
    """Folder of a path; paths at the top have the empty one."""
    return F.regexp_replace("normalized_path", "/?[^/]*$", "")


def folder_digests(rows: DataFrame, failed: bool = False) -> DataFrame:
    """(folder, n, digest): an order-free hash of what lies directly in each folder.

    A digest is a sum of row hashes over (path, mtime, size, error), so tasks add up what they hold first and
    only one row of each folder is exchanged. ``failed``: the rows know their last error.
    """
    error = F.coalesce("last_error", F.lit("")) if failed else F.lit("")
    # 0.0 turns -0.0 into 0.0; two hashes, as one of 64 bits would meet its like among 10^10 folders
    parts = ["normalized_path", (F.col("mtime") + 0.0).alias("m"), "size", error]
    hashes = [F.xxhash64(*parts).cast("decimal(38,0)"), F.xxhash64(F.lit(1), *parts).cast("decimal(38,0)")]
    rows = rows.select(_folder_of().alias("folder"), hashes[0].alias("h0"), hashes[1].alias("h1"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"), F.struct(F.sum("h0").alias("a"), F.sum("h1").alias("b")).alias("digest"))


def tree_digests(folders: DataFrame, deepest: int) -> DataFrame:
    """(folder, n, digest) of whole trees, down to ``deepest`` levels: the digests of all folders at or below each one."""
    parts = F.split("folder", "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest)))
    above = F.transform(levels, lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = folders.select(F.explode(above).alias("folder"), "n", "digest")
    return rows.groupBy("folder").agg(F.sum("n").alias("n"), F.struct(F.sum("digest.a").alias("a"), F.sum("digest.b").alias("b")).alias("digest"))


def _unequal(old: DataFrame, new: DataFrame) -> DataFrame:
    """(folder) whose digests differ or exist on one side only."""
    both = old.select("folder", F.struct("n", "digest").alias("o")).join(new.select("folder", F.struct("n", "digest").alias("w")), "folder", "full_outer")
    return both.where(~F.col("o").eqNullSafe(F.col("w"))).select("folder")


def differing_folders(existing: DataFrame, listing: DataFrame, top: int = 3) -> DataFrame:
    """(folder) of the folders in which something differs, as a table.

    Trees of the first ``top`` levels are compared before their folders: a tree whose sums are equal is left out as
    a whole, and only folders below unequal trees are compared one by one.
    """
    old, new = cut_lineage(folder_digests(existing, failed=True)), cut_lineage(folder_digests(listing))
    trees = cut_lineage(_unequal(tree_digests(old, top), tree_digests(new, top)))
    root = F.array_join(F.slice(F.split("folder", "/"), 1, top), "/")
    below = [side.join(trees.select(F.col("folder").alias("tree")), root == F.col("tree"), "left_semi") for side in (old, new)]
    return cut_lineage(_unequal(*below))


def digest_diff(existing: DataFrame, listing: DataFrame) -> DataFrame:
    """The same as :func:`diff_snapshot`; rows are joined only where their folder's digests differ.

    For listings of whole roots, most of whose folders haven't changed since.
    """
    folders = differing_folders(existing, listing)
    inside = lambda rows, how: rows.withColumn("_folder", _folder_of()).join(folders, F.col("_folder") == F.col("folder"), how).drop("_folder")
    same = inside(listing.select("normalized_path"), "left_anti").select("normalized_path", F.lit("unchanged").alias("change"))
    narrow = existing.select("normalized_path", "mtime", "size", "last_error")
    return diff_snapshot(inside(narrow, "left_semi"), inside(listing.select("normalized_path", "mtime", "size"), "left_semi")).unionByName(same)


def diff_snapshot(existing: DataFrame, listing: DataFrame) -> DataFrame:
    """(normalized_path, change) with new, changed, unchanged or missing.

    A row that failed last time counts as changed. Only four narrow columns of either
    side meet in the join.
    """
    old = existing.select(
        "normalized_path",
        F.struct("mtime", "size", F.coalesce("last_error", F.lit("")).alias("error")).alias("old"),
    )
    new = listing.select("normalized_path", F.struct("mtime", "size").alias("new"))
    o, n = F.col("old"), F.col("new")
    same = (o["mtime"] == n["mtime"]) & (o["size"] == n["size"]) & (o["error"] == "")
    change = (
        F.when(o.isNull(), "new")
        .when(n.isNull(), "missing")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, "normalized_path", "full_outer").select("normalized_path", change.alias("change"))


def responsible(
    path: Column,
    root: str,
    depth: int | None = None,
    extensions: Iterable[str] | None = None,
    rules: Iterable[str] = (),
    file_ext: Column | None = None,
) -> Column:
    """Whether a refresh of ``root`` with these limits would have visited a path."""
    test = px.under(path, root, include_root=True)
    if depth is not None:
        # The root itself is level 0, like the files directly in it.
        test = test & ((path == root) | px.within_depth(path, root, depth))
    if extensions is not None:
        lowered = F.lower(path)
        ends = F.lit(False)
        for ext in extensions:
            ends = ends | lowered.endswith(ext)
        if file_ext is not None:
            ends = ends | F.lower(F.coalesce(file_ext, F.lit(""))).isin(*extensions)
        test = test & ends
    rules = list(rules)
    if rules:
        test = test & ~rl.excluded_by_path(path, rules) & ~rl.excluded_by_name(path, rules)
    return test


def responsible_by_target(path: Column, rule_lists: Iterable[Iterable[str]]) -> Column:
    """The same test with the settings of each path's root as columns: covering_root,
    index_depth, selected_extensions (NULL or empty: all) and exclude_rules, whose
    values are ``rule_lists``."""
    root, allowed = F.col("covering_root"), F.col("selected_extensions")
    prefix = F.concat(px.root_key(root), F.lit("/"))
    shallow = F.col("index_depth").isNull() | (path == root) | (px.slash_count(path) - px.slash_count(prefix) <= F.col("index_depth"))
    wanted = (F.size(F.coalesce(allowed, F.array().cast("array<string>"))) == 0) | F.exists(
        allowed, lambda ext: F.endswith(F.lower(path), F.lower(ext))
    )
    hidden = F.lit(False)
    for rules in rule_lists:
        rules = list(rules)
        listed = F.array(*map(F.lit, rules)).cast("array<string>")
        mine = F.coalesce("exclude_rules", F.array().cast("array<string>")) == listed
        hidden = hidden | (mine & (rl.excluded_by_path(path, rules) | rl.excluded_by_name(path, rules)))
    return shallow & F.coalesce(wanted, F.lit(False)) & ~hidden


def missing_rows(existing: DataFrame, seen: DataFrame, **scope) -> DataFrame:
    """Stored rows inside the refreshed scope that the listing no longer has."""
    ext = F.col("file_ext") if "file_ext" in existing.columns else None
    mine = existing.where(responsible(F.col("normalized_path"), file_ext=ext, **scope))
    return mine.join(seen.select("normalized_path"), "normalized_path", "left_anti")


def scoped_delete(existing: DataFrame, seen: DataFrame, **scope) -> DataFrame:
    """Stored rows that remain after a refresh of the scope."""
    gone = missing_rows(existing, seen, **scope).select("normalized_path")
    return existing.join(gone, "normalized_path", "left_anti")


def clear_failures(failures: DataFrame, still_failing: DataFrame, **scope) -> DataFrame:
    """Failures that remain: outside the scope, or failing again."""
    return scoped_delete(failures, still_failing, **scope)


def latest_failures(failures: DataFrame) -> DataFrame:
    """The newest error of every path."""
    latest = F.max_by(F.struct("file_name", "error_message", "last_failed_at"), "last_failed_at")
    return failures.groupBy("normalized_path").agg(latest.alias("f")).select("normalized_path", "f.*")


def apply_diff(existing: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """File rows after a refresh.

    ``fresh`` replaces rows of the same path but keeps their id, clicks, imported clicks
    and importance; ``gone`` (normalized_path) is removed.
    """
    replaced = fresh.select("normalized_path").unionByName(gone.select("normalized_path"))
    return existing.join(replaced, "normalized_path", "left_anti").unionByName(carried_over(existing, fresh))


def carried_over(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` rows with the id, clicks and importance of the stored row of their path."""
    kept_columns = ("file_id", "click_count", "imported_click_count", "importance")
    old = existing.select("normalized_path", *[F.col(c).alias(f"old_{c}") for c in kept_columns])
    return fresh.join(old, "normalized_path", "left").select(
        *[F.coalesce(f"old_{c}", c).alias(c) if c in kept_columns else F.col(c) for c in existing.columns]
    )


def record_errors(files: DataFrame, failures: DataFrame) -> DataFrame:
    """Set ``last_error`` of stored files that failed now, so the next diff retries them."""
    errors = failures.select("normalized_path", F.col("error_message").alias("new_error"))
    return files.join(errors, "normalized_path", "left").select(
        *[F.coalesce("new_error", c).alias(c) if c == "last_error" else F.col(c) for c in files.columns]
    )


def needs_refresh(
    targets: DataFrame,
    window_minutes: float,
    rules: Iterable[str],
    depth: int,
    extensions: Iterable[str],
    as_of: float,
) -> DataFrame:
    """Add ``needs_refresh``: never indexed, other settings, older version, or too old."""
    rules, extensions = F.array(*map(F.lit, rules)), F.array(*map(F.lit, sorted(extensions)))

    def listed(name: str) -> Column:
        return F.coalesce(name, F.array()).cast("array<string>")

    stale = (
        F.col("last_indexed_at").isNull()
        | (listed("exclude_rules") != rules.cast("array<string>"))
        | (F.coalesce("index_depth", F.lit(0)) != depth)
        | (listed("selected_extensions") != extensions.cast("array<string>"))
        | (F.coalesce("index_version", F.lit(0)) < INDEX_VERSION)
        | (as_of - F.col("last_indexed_at") > window_minutes * 60)
    )
    return targets.withColumn("needs_refresh", stale)


def mark_fresh(
    targets: DataFrame,
    root: str,
    as_of: float,
    rules: Iterable[str],
    depth: int,
    extensions: Iterable[str],
    file_count: int | Column,
    refreshed: str | None = None,
) -> DataFrame:
    """Targets with ``root`` marked as indexed now. A refresh of a part changes nothing."""
    if refreshed is not None and refreshed != root:
        return targets
    new = {
        "last_indexed_at": F.lit(as_of),
        "exclude_rules": F.array(*map(F.lit, rules)).cast("array<string>"),
        "index_depth": F.lit(depth),
        "selected_extensions": F.array(*map(F.lit, sorted(extensions))).cast("array<string>"),
        "indexed_file_count": (file_count if isinstance(file_count, Column) else F.lit(file_count)).cast("bigint"),
        "index_version": F.lit(INDEX_VERSION),
    }
    mine = F.col("full_path") == root
    return targets.select(
        *[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in targets.columns]
    )


def assert_covered(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """Paths with ``is_allowed``: covered, or no root of the source is enabled."""
    enabled = targets.where("is_enabled").groupBy("source_type").agg(F.count("*").alias("n_enabled"))
    return (
        so.covering_root(paths, targets)
        .join(enabled, "source_type", "left")
        .withColumn("is_allowed", F.col("is_covered") | (F.coalesce("n_enabled", F.lit(0)) == 0))
        .drop("n_enabled")
    )


def delete_targets(
    files: DataFrame, failures: DataFrame, targets: DataFrame, roots: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove everything at or below ``roots`` (path); roots that overlap become stale."""
    outer = so.top_roots(roots.select(F.col("path").alias("full_path"))).withColumnRenamed("key", "above")

    def without(df: DataFrame) -> DataFrame:
        path = F.col("normalized_path")
        chain = F.array_union(px.ancestor_keys(path), F.array(px.root_key(path)))
        hit = df.select("normalized_path", F.explode_outer(chain).alias("above")).join(outer, "above", "left_semi")
        return df.join(hit.select("normalized_path"), "normalized_path", "left_anti")

    stale = so.overlapping_roots(roots.select("path"), targets).select(F.col("root").alias("full_path")).distinct()
    stale = stale.withColumn("stale", F.lit(True))
    marked = targets.join(stale, "full_path", "left").select(
        *[
            F.when(F.col("stale"), F.lit(None if c == "last_indexed_at" else 0)).otherwise(F.col(c)).alias(c)
            if c in ("last_indexed_at", "indexed_file_count")
            else F.col(c)
            for c in targets.columns
        ]
    )
    return without(files), without(failures), marked


def delete_files(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("file_id"), "file_id", "left_anti")


def backfill_metadata(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Title, aliases and pin flag of ``.md`` files, read again from stored bodies."""
    bodies = files.where("file_ext = '.md'").select("file_id", "file_ext").join(segments, "file_id")
    fresh = pin_tag_and_names(bodies).select(
        "file_id",
        F.col("title").alias("new_title"),
        F.col("aliases").alias("new_aliases"),
        F.col("has_top_tag").alias("new_has_top_tag"),
    )
    replaced = ("title", "aliases", "has_top_tag")
    return files.join(fresh, "file_id", "left").select(
        *[F.coalesce(f"new_{c}", c).alias(c) if c in replaced else F.col(c) for c in files.columns]
    )


def auto_exclude(targets: DataFrame, unreachable: DataFrame) -> DataFrame:
    """Folders that could not be reached join the rules of their root.

    ``unreachable`` holds (root, path).
    """
    found = unreachable.groupBy("root").agg(F.sort_array(F.collect_set("path")).alias("found"))
    none = F.array().cast("array<string>")
    merged = F.array_union(F.coalesce("exclude_rules", none), F.coalesce("found", none))
    return targets.join(found, targets["full_path"] == found["root"], "left").select(
        *[merged.alias(c) if c == "exclude_rules" else targets[c] for c in targets.columns]
    )


def merge_target_rules(targets: DataFrame, old_global: list[str], new_global: list[str]) -> DataFrame:
    """Local targets follow the global rules: removed ones leave, current ones join.

    Own rules of a target stay. Identity keeps the case of paths only.
    """
    kept = {rl.rule_key(r) for r in new_global}
    removed = sorted({rl.rule_key(r) for r in old_global} - kept)
    none = F.array().cast("array<string>")

    def key(rule: Column) -> Column:
        return F.when(rule.contains("/") | rule.contains("\\"), rule).otherwise(F.lower(rule))

    gone = F.array(*map(F.lit, removed)).cast("array<string>")
    retained = F.filter(F.coalesce("exclude_rules", none), lambda r: ~F.array_contains(gone, key(r)))
    joined = F.concat(retained, F.array(*map(F.lit, new_global)).cast("array<string>"))
    keys = F.transform(joined, key)
    merged = F.filter(joined, lambda r, i: F.array_position(keys, key(r)) == i + 1)
    return targets.withColumn(
        "exclude_rules", F.when(F.col("source_type") == "local", merged).otherwise(F.col("exclude_rules"))
    )
