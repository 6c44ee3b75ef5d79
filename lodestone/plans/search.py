"""One request to one result table: terms, pattern, names only, stored corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.functions import rules as rl
from lodestone.functions import scores as sc
from lodestone.functions import terms as tm
from lodestone.operators import folders as fo
from lodestone.operators import grams as gr
from lodestone.operators import match as mt
from lodestone.operators import rank as rk
from lodestone.operators import scope as so
from lodestone.operators import snippets as sn
from lodestone.operators.records import union_records
from lodestone.request import SearchRequest
from lodestone.session import cut_lineage
from lodestone.sources.corpus import Corpus

RESULT_COLUMNS = (
    "file_id", "result_kind", "source_type", "target_path", "file_name", "full_path", "file_ext",
    "created_at", "mtime", "click_count", "importance", "has_top_tag", "filename_match_level",
    "relevance_bucket", "utility_score", "query_click_score", "match_rank", "score", "segment_type",
)


@dataclass(frozen=True)
class SearchResult:
    """All matches, and the views a caller asks for."""

    corpus: Corpus
    request: SearchRequest
    matches: DataFrame

    @property
    def merged(self) -> bool:
        return self.request.regex or self.request.wants_folder

    @property
    def keys(self) -> list[Column]:
        return rk.order_keys(self.request.sort_by, self.request.sort_order, self.merged)

    def page(self) -> DataFrame:
        request = self.request
        rows = rk.page(self.matches, self.keys, request.limit, request.offset)
        if request.include_snippets:
            included, _ = tm.split_query(request.q)
            terms = tm.fold_unique(v for group in mt.variants(request) for v in group)
            pattern = " ".join(included) if request.regex else None
            rows = sn.add_snippets(
                rows, self.corpus.segments, terms, pattern, request.wants_body, request.wants_name
            )
        return rows

    def info(self) -> DataFrame:
        return rk.page_info(self.matches, self.request.limit, self.request.offset)

    def presented(self) -> DataFrame:
        return to_results(self.page())


def to_results(df: DataFrame) -> DataFrame:
    """The columns shown to a user: times as timestamps, the priority flag added."""
    shown = [c for c in RESULT_COLUMNS if c not in ("created_at", "mtime", "importance")]
    extra = [c for c in ("position", "snippet") if c in df.columns]
    return df.select(
        *shown,
        F.timestamp_seconds("created_at").alias("created_at"),
        F.timestamp_seconds("mtime").alias("mtime"),
        (F.col("filename_match_level") >= 2).alias("filename_match_priority"),
        *extra,
    )


def _file_results(matched: DataFrame, request: SearchRequest) -> DataFrame:
    return matched.select(
        "file_id",
        F.lit("file").alias("result_kind"),
        "source_type",
        F.lit(request.full_path).alias("target_path"),
        "file_name",
        F.col("normalized_path").alias("full_path"),
        "file_ext",
        "created_at",
        "mtime",
        (F.col("click_count") + F.col("imported_click_count")).alias("click_count"),
        "importance",
        "has_top_tag",
        "filename_match_level",
        "relevance_bucket",
        "utility_score",
        "query_click_score",
        "match_rank",
        "score",
        "segment_type",
    )


def merge_results(files: DataFrame, folders: DataFrame) -> DataFrame:
    return files.unionByName(folders)


def search(
    corpus: Corpus, request: SearchRequest, bucket_method: str = "counted", settle: bool = True
) -> SearchResult:
    """Ranked search.

    Buckets compare each match with all others. With ``settle`` the matches are kept as a
    table first, so bodies and names are read once; without, the plan stays lazy and
    reads them twice.
    """
    if request.regex:
        return search_regex(corpus, request)
    _, excluded = tm.split_query(request.q)
    scoped = so.scope_files(corpus.files, request, corpus.targets)
    matched = mt.match_files(corpus, scoped, request)
    matched = cut_lineage(matched) if settle else matched
    # The share of better hits counts everything that matched; rules hide rows later.
    matched = rk.relevance_bucket(matched, bucket_method)
    matched = so.exclude_paths(matched, request.exclude_rules, request.full_path)
    matched = mt.drop_mentions(corpus, matched, excluded)
    matched = rk.add_scores(matched, corpus.query_clicks, request.q.strip(), request.as_of)
    results = _file_results(matched, request)
    if request.wants_folder:
        results = merge_results(results, fo.search_folders(scoped, request))
    return SearchResult(corpus, request, results)


def search_regex(corpus: Corpus, request: SearchRequest) -> SearchResult:
    """Pattern search over bodies, names and folders.

    Where the corpus has grams of bodies and every match must hold some literal, only bodies that hold the
    literal's grams are read; other patterns read all.
    """
    included, excluded = tm.split_query(request.q)
    pattern = " ".join(included)
    java = f"(?iu){pattern}"
    try:
        # the engine that runs the pattern also judges it
        corpus.files.sparkSession._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException as error:
        raise ValueError(f"bad pattern: {error}") from error
    scoped = so.scope_files(corpus.files, request, corpus.targets)
    path = F.col("normalized_path")
    is_url = path.startswith("http://") | path.startswith("https://")
    hidden = F.when(is_url, rl.excluded_url(path, request.exclude_rules)).otherwise(
        rl.excluded(path, request.exclude_rules)
    )
    scoped = scoped.where(~hidden) if request.exclude_rules else scoped
    never = F.lit(False)
    rows = scoped
    in_body = never
    if request.wants_body:
        candidates = gr.pattern_files(corpus, pattern)
        segments = corpus.segments if candidates is None else gr.bodies_of(corpus.segments, candidates)
        body = segments.where(F.col("content").rlike(java)).select("file_id", F.lit(True).alias("in_body"))
        rows = rows.join(body, "file_id", "left")
        in_body = F.coalesce("in_body", never)
    folder = px.parent_folder(path, F.col("file_name"))
    rows = rows.select(
        *scoped.columns,
        in_body.alias("hit_body"),
        (F.col("file_name").rlike(java) if request.wants_name else never).alias("hit_name"),
        (folder.rlike(java) if request.wants_folder else never).alias("hit_folder"),
        folder.alias("folder_path"),
    ).where("hit_body or hit_name or hit_folder")
    rows = mt.drop_mentions(corpus, rows, excluded)
    files = (
        rows.where("hit_body or hit_name")
        .withColumn("filename_match_level", F.when(F.col("hit_name"), 2).otherwise(0))
        .withColumn("relevance_bucket", F.lit(10))
        .withColumn("match_rank", F.when(F.col("hit_body"), mt.BODY).otherwise(mt.NAME))
        .withColumn("score", F.lit(0.0))
        .withColumn("segment_type", F.when(F.col("hit_body"), F.lit("body")).otherwise(F.lit("filename")))
    )
    files = rk.add_scores(files, None, "", request.as_of)
    results = _file_results(files, request)
    if request.wants_folder:
        results = merge_results(results, fo.folders_of_first_file(rows.where("hit_folder"), request))
    return SearchResult(corpus, request, results)


def search_existing(corpus: Corpus, q: str, folder: str = "", **options) -> SearchResult:
    """Search what is stored: any depth, an empty folder means everything."""
    options.setdefault("exclude_rules", rl.DEFAULT_RULES)
    return search(corpus, SearchRequest(q=q, full_path=folder, search_all=True, **options))


@dataclass(frozen=True)
class MergedResult:
    """Documents and records in one order, whole; a page and its totals come from it."""

    request: SearchRequest
    matches: DataFrame

    def page(self) -> DataFrame:
        keys = rk.order_keys(self.request.sort_by, self.request.sort_order, merged=True)
        return rk.page(self.matches, keys, self.request.limit, self.request.offset)

    def info(self) -> DataFrame:
        return rk.page_info(self.matches, self.request.limit, self.request.offset)


def search_with_records(corpus: Corpus, request: SearchRequest, records: DataFrame) -> MergedResult:
    """Documents that match, and the rows that ``search_records`` found, as one result."""
    return MergedResult(request, union_records(search(corpus, request).matches, records))


def _names_request(q: str, path: str = "", limit: int = 100, **options) -> SearchRequest:
    return SearchRequest(
        q=q, full_path=path, search_all=not path, target="filename_and_folder", limit=limit,
        include_snippets=False, max_depth=0 if path else None, **options,
    )


def search_names_info(corpus: Corpus, q: str, path: str = "", **options) -> DataFrame:
    """Total of a name search, rows on its page, whether more follow."""
    return search(corpus, _names_request(q, path, **options)).info()


def search_names(corpus: Corpus, q: str, path: str = "", **options) -> DataFrame:
    """Names and folders only, in a compact form."""
    page = search(corpus, _names_request(q, path, **options)).page()
    return page.select(
        "position",
        F.col("file_name").alias("name"),
        F.col("full_path").alias("path"),
        F.when(F.col("result_kind") == "folder", "directory").otherwise("file").alias("type"),
        F.lit(0).cast("bigint").alias("size"),
        F.col("mtime").alias("date_modified"),
    )
