"""Document search and corpus maintenance as Spark jobs."""

from lodestone.operators.extract import register_extractor
from lodestone.plans.batch import search_many
from lodestone.plans.refresh import refresh, refresh_stored, refresh_targets
from lodestone.plans.search import (
    SearchResult,
    search,
    search_existing,
    search_names,
    search_regex,
    to_results,
)
from lodestone.request import SearchRequest
from lodestone.sources.corpus import Corpus, compact, read_corpus, write_corpus
from lodestone.sources.documents import from_documents, from_pages, list_files, read_files

__all__ = [
    "Corpus",
    "compact",
    "SearchRequest",
    "SearchResult",
    "from_documents",
    "from_pages",
    "list_files",
    "read_corpus",
    "read_files",
    "refresh",
    "refresh_stored",
    "refresh_targets",
    "register_extractor",
    "search",
    "search_existing",
    "search_many",
    "search_names",
    "search_regex",
    "to_results",
    "write_corpus",
]
