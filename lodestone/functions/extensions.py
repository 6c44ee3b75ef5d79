"""File extensions: known sets, longest-suffix match, user lists."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions whose body is read.
CONTENT_EXTENSIONS = (
    ".md", ".excalidraw.md", ".dio.svg", ".json", ".xml", ".txt", ".excalidraw",
    ".dio", ".pdf", ".docx", ".xlsx", ".xlsm", ".pptx", ".msg",
)
# Extensions found by name only.
NAME_ONLY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".heic", ".svg", ".bmp", ".tif", ".tiff",
    ".mp3", ".m4a", ".aac", ".wav", ".flac", ".aif", ".aiff", ".alac", ".m4p",
)


def tidy_extension(token: str) -> str:
    token = token.strip().lower()
    return token if not token or token[0] == "." else "." + token


def known_extensions(content: Iterable[str] = (), names: Iterable[str] = ()) -> list[str]:
    return sorted({*CONTENT_EXTENSIONS, *NAME_ONLY_EXTENSIONS, *content, *names})


def extension_filter(text: str | None, content: Iterable[str] = (), names: Iterable[str] = ()) -> list[str]:
    """Extensions named in a list; unknown ones are ignored, an empty list means all."""
    known = known_extensions(content, names)
    asked = {tidy_extension(t) for t in re.split(r"[\s,]+", text or "") if t}
    return sorted(asked.intersection(known)) or known


def extension_entries(text: str | None) -> list[str]:
    """User-added extensions: one per line or comma, first spelling kept."""
    tidy = (tidy_extension(t) for t in re.split(r"[,\n\r]", text or ""))
    return list(dict.fromkeys(t for t in tidy if t))


def resolve_extension(name: Column, extensions: Iterable[str]) -> Column:
    """Longest known extension that ends the name; NULL when none does.

    The leftmost match that reaches the end of the name is the longest one.
    """
    pattern = "|".join(re.escape(ext) for ext in sorted(extensions))
    return F.nullif(F.regexp_extract(F.lower(name), f"({pattern})$", 1), F.lit(""))


def extension_kind(ext: Column, content: Iterable[str] = (), names: Iterable[str] = ()) -> Column:
    return (
        F.when(ext.isin(*CONTENT_EXTENSIONS, *content), F.lit("content"))
        .when(ext.isin(*NAME_ONLY_EXTENSIONS, *names), F.lit("name_only"))
    )


def with_extensions(ext: Column, extensions: Iterable[str]) -> Column:
    return ext.isin(*extensions)


def exact_extension(ext: Column, text: str) -> Column:
    """Filter typed over a result list: exact extension, blank means everything."""
    wanted = {tidy_extension(t) for t in text.split()}
    return F.lower(ext).isin(*sorted(wanted)) if wanted else F.lit(True)
