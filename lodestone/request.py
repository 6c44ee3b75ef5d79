"""A search request: plain values, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

SOURCES = ("local", "web", "local_web")
TARGETS = ("all", "body", "filename", "folder", "filename_and_folder")
SORTS = ("default", "created", "modified", "click_count")
MAX_LIMIT = 1000


@dataclass(frozen=True)
class SearchRequest:
    q: str
    full_path: str = ""
    search_all: bool = True
    source_type: str = "local"
    max_depth: int | None = None
    regex: bool = False
    target: str = "all"
    types: str | None = None
    extra_content_extensions: tuple[str, ...] = ()
    extra_filename_extensions: tuple[str, ...] = ()
    exclude_rules: tuple[str, ...] = ()
    synonyms: tuple[tuple[str, ...], ...] = ()
    date_field: str = "created"
    date_from: date | None = None
    date_to: date | None = None
    sort_by: str = "default"
    sort_order: str = "desc"
    limit: int = 20
    offset: int = 0
    include_snippets: bool = True
    as_of: float = field(default=0.0)

    def __post_init__(self) -> None:
        if not self.q:
            raise ValueError("q must not be empty")
        _one_of("source_type", self.source_type, SOURCES)
        _one_of("target", self.target, TARGETS)
        _one_of("date_field", self.date_field, ("created", "modified"))
        _one_of("sort_by", self.sort_by, SORTS)
        _one_of("sort_order", self.sort_order, ("asc", "desc"))
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must lie between 1 and {MAX_LIMIT}")
        if self.offset < 0:
            raise ValueError("offset must not be negative")
        if self.max_depth is not None and not 0 <= self.max_depth <= 99999:
            raise ValueError("max_depth must lie between 0 and 99999")
        if self.date_from and self.date_to and self.date_to < self.date_from:
            raise ValueError("date_to must be on or after date_from")
        if self.full_path and not is_absolute(self.full_path):
            raise ValueError("full_path must be absolute")

    @property
    def wants_body(self) -> bool:
        return self.target in ("all", "body")

    @property
    def wants_name(self) -> bool:
        return self.target in ("all", "filename", "filename_and_folder")

    @property
    def wants_folder(self) -> bool:
        return self.target in ("all", "folder", "filename_and_folder")

    def with_(self, **changes) -> SearchRequest:
        return replace(self, **changes)


def is_absolute(path: str) -> bool:
    drive = len(path) >= 3 and path[0].isalpha() and path[1] == ":" and path[2] in "/\\"
    return path.startswith(("/", "\\\\", "http://", "https://")) or drive


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
