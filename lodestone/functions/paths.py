"""Path columns. Stored paths use ``/``; folders carry no trailing slash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WINDOWS = r"^(?:\\\\|//|[A-Za-z]:[\\/])"
_UNC = r"^(?:\\\\|//)"


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | path.rlike(_WINDOWS)


def normalize_path(path: Column) -> Column:
    """Text form used for storage; NULL when the path is not absolute.

    Doubled slashes, ``.`` parts and a trailing slash go; ``..`` is resolved for
    POSIX paths and kept for Windows ones. UNC paths keep their two slashes.
    """
    slashed = F.translate(path, "\\", "/")
    windows = path.rlike(_WINDOWS)
    text = F.when(windows, slashed).otherwise(path)
    parts = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, p)),
    )
    drive_only = windows & (F.size(parts) == 1) & ~path.rlike(_UNC)
    return (
        F.when(path.rlike(_UNC), F.concat(F.lit("//"), F.array_join(parts, "/")))
        .when(drive_only, F.concat(F.array_join(parts, "/"), F.lit("/")))
        .when(windows, F.array_join(parts, "/"))
        .when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(resolved, "/")))
    )


def path_prefix(root: str) -> str:
    """The prefix shared by everything below ``root``, with one trailing slash."""
    return root if root.endswith("/") else root + "/"


def under(path: Column, root: str, include_root: bool = False) -> Column:
    """Below ``root``; reaches the Parquet scan as a prefix filter."""
    below = path.startswith(path_prefix(root))
    return (path == root) | below if include_root else below


def slash_count(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def within_depth(path: Column, root: str, depth: int) -> Column:
    return slash_count(path) - path_prefix(root).count("/") <= depth


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_folder(path: Column, name: Column) -> Column:
    """Folder of a file; ``/`` for a file at the root.

    A web page is named by its title, so its path need not end with its name.
    """
    cut = F.when(
        path.endswith(name), F.substring(path, F.lit(1), F.length(path) - F.length(name))
    ).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    trimmed = F.regexp_replace(cut, "/+$", "")
    return F.when(trimmed == "", F.lit("/")).otherwise(trimmed)


def folder_name(folder: Column) -> Column:
    """Last part of a folder path, for display."""
    trimmed = F.regexp_replace(folder, r"[/\\]+$", "")
    last = F.regexp_extract(trimmed, r"([^/\\]*)$", 1)
    rooted = F.regexp_replace(trimmed, r"[^/\\]*$", "")
    return (
        F.when(trimmed == "", folder)
        .when(F.length(rooted) == 1, trimmed)
        .otherwise(last)
    )


def name_stem(name: Column, ext: Column) -> Column:
    """Name without the characters of its extension (titles of pages lose five)."""
    return F.substring(name, F.lit(1), F.greatest(F.length(name) - F.length(ext), F.lit(0)))


def relative_depth(root: Column, path: Column) -> Column:
    """Folder levels from ``root`` down to ``path``; 0 when it is not below."""

    def tidy(p: Column) -> Column:
        t = F.regexp_replace(F.translate(p, "\\", "/"), "/+$", "")
        return F.when(t == "", F.lit("/")).otherwise(t)

    r, d = tidy(root), tidy(path)
    prefix = F.when(r.endswith("/"), r).otherwise(F.concat(r, F.lit("/")))
    rest = F.substring(d, F.length(prefix) + 1, F.length(d))
    return F.when(
        F.startswith(F.lower(d), F.lower(prefix)) & (F.lower(r) != F.lower(d)),
        F.size(F.filter(F.split(rest, "/"), lambda p: p != "")),
    ).otherwise(0)


def root_key(root: Column) -> Column:
    """Join key of a root: no trailing slash, so ``/`` becomes the empty string."""
    return F.regexp_replace(root, "/+$", "")


def ancestor_keys(path: Column) -> Column:
    """Keys of all folders above ``path``, nearest last."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda k: F.array_join(F.slice(parts, 1, k), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))
