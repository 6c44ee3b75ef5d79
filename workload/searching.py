"""Search queries: terms, names, patterns, folders, scopes, ranks, pages, snippets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lodestone.functions import extensions as ext
from lodestone.functions import paths as px
from lodestone.functions import rules as rl
from lodestone.functions import scores as sc
from lodestone.functions import terms as tm
from lodestone.functions import text as tx
from lodestone.functions import urls as ux
from lodestone.operators import folders as fo
from lodestone.operators import index as ix
from lodestone.operators import match as mt
from lodestone.operators import rank as rk
from lodestone.operators import scope as so
from lodestone.operators import snippets as sn
from lodestone.plans.batch import search_many
from lodestone.plans.search import search, search_existing, search_names
from lodestone.request import SearchRequest
from lodestone.sources.records import import_metrics
from workload import views as v
from workload.registry import query

# --- index tables ------------------------------------------------------------


@query("files", v.with_views(
    "select file_id, normalized_path, file_name, file_ext, created_at, mtime, size, click_count,"
    " imported_click_count, importance, has_top_tag, title, aliases, length(content) as chars from files"))
def files(spark, sf):
    docs = v.documents(spark, sf)
    return docs.select(
        "file_id", "normalized_path", "file_name", "file_ext", "created_at", "mtime", "size", "click_count",
        "imported_click_count", "importance", "has_top_tag", "title",
        F.array_join("aliases", "\n").alias("aliases"), F.length("content").alias("chars"))


@query("segments", v.with_views(
    "select file_id, n as n_tokens, length(content) as chars from toks", toks=v.TOKENS_SQL))
def segments(spark, sf):
    return v.corpus(spark, sf).segments.select("file_id", "n_tokens", F.length("content").alias("chars"))


@query("postings", v.with_views(
    "select term, file_id, count(*) as tf, min(n) as n_tokens, string_agg(cast(pos as varchar), ',' order by pos) as positions"
    " from (select file_id, n, unnest(tk) as term, generate_subscripts(tk, 1) - 1 as pos from toks) group by term, file_id",
    toks=v.TOKENS_SQL))
def postings(spark, sf):
    return ix.build_postings(v.corpus(spark, sf).segments).select(
        "term", "file_id", "tf", "n_tokens", F.array_join("positions", ",").alias("positions"))


@query("term_stats", v.with_views(
    "select term, count(distinct file_id) as df from (select file_id, unnest(tk) as term from toks) group by term",
    toks=v.TOKENS_SQL))
def term_stats(spark, sf):
    return ix.term_stats(ix.build_postings(v.corpus(spark, sf).segments)).select("term", "df")


@query("bm25_global_stats", v.with_views(
    "select count(*) as n_docs, round(avg(n), 6) as avg_tokens from toks", toks=v.TOKENS_SQL))
def bm25_global_stats(spark, sf):
    return v.corpus(spark, sf).statistics().select("n_docs", F.round("avg_tokens", 6).alias("avg_tokens"))


@query("name_trigrams", v.with_views(
    "select distinct file_id, substr(lower(file_name), cast(i as int), 3) as trigram from"
    " (select file_id, file_name, unnest(range(1, length(file_name) - 1)) as i from files)"))
def name_trigrams(spark, sf):
    return ix.build_name_trigrams(v.corpus(spark, sf).files)


@query("substring_by_grams", v.with_views(
    "select distinct b.needle, f.file_id from files f join (select distinct regexp_extract(lower(text), '[a-z]+') as needle"
    " from benchmark) b on contains(lower(f.file_name), b.needle) where b.needle <> ''"))
def substring_by_grams(spark, sf):
    needles = v.table(spark, sf, "benchmark").select(
        F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("needle")).where("needle != ''").distinct()
    return ix.substring_join(needles, "needle", v.corpus(spark, sf).files, "file_id", F.col("file_name"))


@query("cjk_bigrams", v.with_views(
    "select file_id, count(*) as n, count(distinct g) as n_distinct, min(g) as first, max(g) as last from ("
    " select file_id, substr(run, cast(i as int), 2) as g from (select file_id, run, unnest(range(1, length(run))) as i"
    f" from (select file_id, unnest(regexp_extract_all(content, '[぀-ゟ]{{2,}}')) as run from kana))) group by file_id",
    kana=v.kana_sql()))
def cjk_bigrams(spark, sf):
    body = v.kana_corpus(spark, sf).segments
    grams = body.select("file_id", tx.once(tx.cjk_bigrams(F.col("content"))).alias("g")).where(F.size("g") > 0)
    # a body's bi-grams are counted where they are; only its distinct ones move, as one row
    rows = grams.select("file_id", F.size("g").alias("n"), tx.once(F.array_distinct("g")).alias("g"))
    rows = rows.select("*", F.array_min("g").alias("first"), F.array_max("g").alias("last"))
    return rows.groupBy("file_id").agg(
        F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("g")))).cast("bigint").alias("n_distinct"),
        F.min("first").alias("first"), F.max("last").alias("last"))


# --- body matches ------------------------------------------------------------

def matches(result):
    return result.matches.where("result_kind = 'file'").select(
        "file_id", "match_rank", F.round("score", 8).alias("score"), "filename_match_level", "relevance_bucket",
        F.round("utility_score", 8).alias("utility_score"), F.round("query_click_score", 8).alias("query_click_score"))


MATCHES_SQL = (
    "select file_id, match_rank, round(score, 8) as score, filename_match_level, relevance_bucket,"
    " round(utility_score, 8) as utility_score, round(query_click_score, 8) as query_click_score from ranked"
)


def request(q, **options):
    return SearchRequest(q=q, as_of=v.AS_OF, **options)


def search_sql(body_sql, groups, q, **options):
    return v.with_views(body_sql, **v.search_views(groups, q=q, **options))


@query("bm25_term", search_sql(
    "select file_id, tf, n as n_tokens, round(score, 8) as score from (select file_id, tf, n, "
    + v.bm25_sql("tf", "n", "df") + " as score from u_0_0, d_0_0, stats where tf > 0)", [["with"]], "with"))
def bm25_term(spark, sf):
    corpus = v.corpus(spark, sf)
    units = mt.body_units([["with"]])
    counts = mt.scan_frequencies(corpus.segments, units)
    (scored,) = mt.match_body(corpus, units)
    return counts.join(scored, "file_id").select(
        "file_id", F.col("tf_0").alias("tf"), "n_tokens", F.round("body_0", 8).alias("score"))


@query("bm25_phrase", search_sql(
    "select file_id, round(score, 8) as score from hits where match_rank = 0", [["of-the"]], "of-the", names=False))
def bm25_phrase(spark, sf):
    (scored,) = mt.match_body(v.corpus(spark, sf), mt.body_units([["of-the"]]))
    return scored.select("file_id", F.round("body_0", 8).alias("score"))


@query("literal_terms", search_sql(MATCHES_SQL, [["mail2"], ["the"]], "mail2 the"))
def literal_terms(spark, sf):
    return matches(search(v.corpus(spark, sf), request("mail2 the")))


@query("search_and_terms", search_sql(MATCHES_SQL, [["the"], ["and"]], "the and"))
def search_and_terms(spark, sf):
    return matches(search(v.corpus(spark, sf), request("the and")))


@query("search_indexed", search_sql(MATCHES_SQL, [["the"], ["and"]], "the and"))
def search_indexed(spark, sf):
    return matches(search(v.stored_corpus(spark, sf), request("the and")))


@query("search_exclude_terms", search_sql(
    MATCHES_SQL + " where not (contains(lower(file_name), 'hand')"
    " or contains(lower(folder_path), 'hand') or contains(lower(content), 'hand'))",
    [["with"], ["of"]], "with -hand of"))
def search_exclude_terms(spark, sf):
    return matches(search(v.corpus(spark, sf), request("with -hand of")))


@query("search_synonyms", search_sql(MATCHES_SQL, [["und", "with", "avec"], ["de"]], "und de"))
def search_synonyms(spark, sf):
    return matches(search(v.corpus(spark, sf), request("und de", synonyms=(("with", "UND", "avec"), ("und", "nicht")))))


@query("search_body_only", search_sql(MATCHES_SQL, [["que"], ["la"]], "que la", names=False))
def search_body_only(spark, sf):
    return matches(search(v.corpus(spark, sf), request("que la", target="body")))


@query("name_match_levels", search_sql(MATCHES_SQL, [["the"], ["en"]], "the en", body=False))
def name_match_levels(spark, sf):
    return matches(search(v.corpus(spark, sf), request("the en", target="filename")))


@query("title_alias_matches", search_sql(MATCHES_SQL, [["alias"], ["src7"]], "alias src7", body=False))
def title_alias_matches(spark, sf):
    return matches(search(v.corpus(spark, sf), request("alias src7", target="filename")))


@query("search_existing", search_sql(
    MATCHES_SQL, [["the"]], "the", scope="starts_with(normalized_path, '/corpus/src1/')"))
def existing(spark, sf):
    return matches(search_existing(v.corpus(spark, sf), "the", "/corpus/src1", as_of=v.AS_OF))


@query("bigram_search", v.with_views(
    "select file_id, round(score, 8) as score from (select file_id, "
    + v.bm25_sql("tf", "n", "df") + " as score from u, (select count(*) as df from u), stats)",
    kana=v.kana_sql(),
    toks=f"select file_id, content, len(regexp_extract_all(content, {v.WORDS})) as n from kana where regexp_matches(content, '\\S')",
    stats="select count(*) as n_docs, avg(n) as avg_len from toks",
    u="select file_id, n, (length(content) - length(replace(content, 'とくお', ''))) // 3 as tf from toks where contains(content, 'とくお')"))
def bigram_search(spark, sf):
    corpus = v.kana_corpus(spark, sf).indexed()
    units = [u for u in mt.body_units([["とくお"]]) if u.mode == "bigram"]
    (scored,) = mt.match_body(corpus, units)
    return scored.select("file_id", F.round("bigram_0", 8).alias("score"))


@query("qualify_hits", search_sql(
    "select q.file_id, q.n_terms, b.match_rank, round(b.score, 8) as score from"
    " (select file_id, count(distinct term_index) as n_terms from hits group by file_id having count(distinct term_index) = 2) q"
    " join (select file_id, match_rank, score from (select *, row_number() over (partition by file_id order by match_rank, score) as rn from hits) where rn = 1) b"
    " on b.file_id = q.file_id", [["the"], ["for"]], "the for"))
def qualify_hits(spark, sf):
    """Hits held as rows, one table per branch, united, counted and reduced."""
    corpus = v.corpus(spark, sf)
    branches = []
    for i, term in enumerate(["the", "for"]):
        (scored,) = mt.match_body(corpus, mt.body_units([[term]]))
        branches.append(scored.select("file_id", F.lit(i).alias("term_index"), F.lit(mt.BODY).alias("match_rank"), F.col("body_0").alias("score")))
        for rank, column in ((mt.NAME, F.col("file_name")), (mt.TITLE, F.col("title")), (mt.ALIAS, F.array_join("aliases", "\n"))):
            branches.append(corpus.files.where(F.lower(column).contains(term)).select(
                "file_id", F.lit(i).alias("term_index"), F.lit(rank).alias("match_rank"), F.lit(sc.NAME_SCORE).alias("score")))
    hits = mt.union_hits(*branches)
    return mt.qualify(hits, 2).join(mt.best_hit(hits), "file_id").select(
        "file_id", "n_terms", "match_rank", F.round("score", 8).alias("score"))


# --- ranks and pages ---------------------------------------------------------


@query("relevance_buckets", search_sql(
    "select file_id, match_rank, round(score, 8) as score, relevance_bucket from best", [["of"]], "of"))
def relevance_buckets(spark, sf):
    corpus = v.corpus(spark, sf)
    matched = mt.match_files(corpus, corpus.files, request("of"))
    return rk.relevance_bucket(matched, "counted").select(
        "file_id", "match_rank", F.round("score", 8).alias("score"), "relevance_bucket")


def page_sql(order, limit, offset, groups, q, **options):
    return search_sql(
        f"select row_number() over (order by {order}) + {offset} as position, * from (select file_id, normalized_path as full_path,"
        f" relevance_bucket, round(utility_score, 8) as utility_score, filename_match_level, has_top_tag, query_click_score,"
        f" mtime, created_at, match_rank, score, importance, clicks from ranked order by {order} limit {limit} offset {offset})",
        groups, q, **options)


def only_page(sql):
    return f"select position, file_id, full_path, relevance_bucket, utility_score from ({sql})"


def page_of(result):
    return result.page().select(
        "position", "file_id", "full_path", "relevance_bucket", F.round("utility_score", 8).alias("utility_score"))


@query("default_rank_page", only_page(page_sql(v.DEFAULT_ORDER, 20, 20, [["the"], ["and"]], "the and")))
def default_rank_page(spark, sf):
    # Files only: the folder part of the merge has a query of its own.
    found = search(v.corpus(spark, sf), request("the and", limit=20, offset=20, include_snippets=False))
    return page_of(found)


@query("explicit_sort_page", only_page(page_sql(
    "match_rank, score, importance desc, mtime asc, file_id desc", 25, 0, [["for"]], "for", names=False)))
def explicit_sort_page(spark, sf):
    return page_of(search(v.corpus(spark, sf), request(
        "for", target="body", sort_by="modified", sort_order="asc", limit=25, include_snippets=False)))


@query("merged_sort_page", only_page(page_sql("clicks desc, file_id desc", 25, 0, [["with"]], "with")))
def merged_sort_page(spark, sf):
    return page_of(search(v.corpus(spark, sf), request("with", sort_by="click_count", limit=25, include_snippets=False)))


@query("page_total", search_sql(
    "select count(*) as total, greatest(least(20, count(*) - 40), 0) as returned, 60 < count(*) as has_more,"
    " case when 60 < count(*) then 60 end as next_offset from best", [["der"]], "der", names=False))
def page_total(spark, sf):
    return search(v.corpus(spark, sf), request("der", target="body", limit=20, offset=40)).info()


@query("utility_scores", v.with_views(
    "select file_id, round(0.55 * (c / (c + 10.0)) + 0.25 * least(greatest(importance / 1000.0, 0.0), 1.0)"
    f" + 0.20 / (1.0 + greatest({v.AS_OF} - mtime, 0.0) / 7776000.0), 8) as utility from"
    " (select *, click_count + imported_click_count as c from files)"))
def utility_scores(spark, sf):
    clicks = F.col("click_count") + F.col("imported_click_count")
    return v.documents(spark, sf).select(
        "file_id", F.round(sc.utility(clicks, F.col("importance"), F.col("mtime"), v.AS_OF), 8).alias("utility"))


@query("query_affinity",
    "select normalized_query, file_id, round((1.0 * click_count / (click_count + 2.0)) * (1.0 / (1.0 +"
    f" greatest({v.AS_OF} - last_clicked_at, 0.0) / 2592000.0)), 8) as affinity from ({v.QUERY_CLICKS_SQL})")
def query_affinity(spark, sf):
    return v.query_clicks(spark, sf).select(
        "normalized_query", "file_id",
        F.round(sc.query_affinity(F.col("click_count"), F.col("last_clicked_at"), v.AS_OF), 8).alias("affinity"))


def _metrics(spark, sf):
    events = v.table(spark, sf, "events").groupBy("user_id")
    count = lambda kind: F.count_if(F.col("event_type") == kind).cast("string")
    return events.agg(
        count("view").alias("accessCount"), count("click").alias("backlinkCount"),
        (F.max(v.epoch()) * 1000).cast("string").alias("lastOpenedAt"),
        (F.min(v.epoch()) * 1000).cast("string").alias("modifiedAt"),
        count("signup").alias("outgoingLinkCount"), count("purchase").alias("attachmentCount"),
        count("error").alias("headingCount"), F.lit("x").alias("tagCount"))


IMPORTANCE_SQL = f"""
select user_id, round(1000 * (0.28 * least(ln(1 + c) / ln(51), 1.0) + 0.22 * least(ln(1 + v) / ln(51), 1.0)
  + 0.08 * least(ln(1 + s) / ln(51), 1.0) + 0.05 * least(ln(1 + e) / ln(51), 1.0) + 0.05 * least(ln(1 + p) / ln(51), 1.0)
  + case when hi <= {v.AS_OF} * 1000 then 0.16 * pow(0.5, ({v.AS_OF} * 1000 - hi) / 86400000.0 / 21) else 0 end
  + case when lo <= {v.AS_OF} * 1000 then 0.1 * pow(0.5, ({v.AS_OF} * 1000 - lo) / 86400000.0 / 45) else 0 end), 4) as importance,
  v as access
from (select user_id, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'click') as c,
  count(*) filter (event_type = 'signup') as s, count(*) filter (event_type = 'purchase') as p,
  count(*) filter (event_type = 'error') as e, max(epoch_us(ts)) / 1000.0 as hi, min(epoch_us(ts)) / 1000.0 as lo
  from events group by user_id)
"""


@query("importance_scores", f"select user_id, importance from ({IMPORTANCE_SQL})")
def importance_scores(spark, sf):
    return _metrics(spark, sf).select("user_id", F.round(sc.importance(F.col, v.AS_OF), 4).alias("importance"))


@query("import_metrics", v.with_views(
    "select f.file_id, coalesce(m.access, case when starts_with(f.normalized_path, '/corpus/src3/') then 0 else f.imported_click_count end) as imported_click_count,"
    " coalesce(m.importance, case when starts_with(f.normalized_path, '/corpus/src3/') then 0 else round(f.importance, 4) end) as importance"
    " from files f left join m on m.user_id = f.file_id and starts_with(f.normalized_path, '/corpus/src3/')", m=IMPORTANCE_SQL))
def import_access_metrics(spark, sf):
    files = v.corpus(spark, sf).files
    paths = files.where("startswith(normalized_path, '/corpus/src3/')").select(F.col("file_id").alias("user_id"), "normalized_path")
    metrics = _metrics(spark, sf).join(paths, "user_id").drop("user_id")
    return import_metrics(files, metrics, "/corpus/src3", v.AS_OF).select(
        "file_id", "imported_click_count", F.round("importance", 4).alias("importance"))


# --- scopes and exclusions ---------------------------------------------------


def scoped(spark, sf, **options):
    return so.scope_files(v.corpus(spark, sf).files, request("x", **options), v.targets(spark, sf)).select("file_id", "normalized_path")


@query("scope_prefix_depth", v.with_views(
    "select file_id, normalized_path from files where starts_with(normalized_path, '/corpus/src1/')"
    " and length(normalized_path) - length(replace(normalized_path, '/', '')) - 3 <= 1"))
def scope_prefix_depth(spark, sf):
    return scoped(spark, sf, full_path="/corpus/src1", max_depth=1)


@query("scope_dates", v.with_views(
    "select file_id, normalized_path from files where mtime >= epoch(timestamp '2024-01-03') and mtime < epoch(timestamp '2024-01-06')"))
def scope_dates(spark, sf):
    return scoped(spark, sf, date_field="modified", date_from=date(2024, 1, 3), date_to=date(2024, 1, 5))


@query("scope_ext", v.with_views("select file_id, normalized_path from files where file_ext in ('.md', '.json')"))
def scope_ext(spark, sf):
    return scoped(spark, sf, types="md, json unknown")


@query("scope_targets", v.with_views(
    "select file_id, normalized_path from files f where exists (select 1 from targets t where t.is_enabled"
    " and starts_with(f.normalized_path, concat(t.full_path, '/')))", targets=v.TARGETS_SQL))
def scope_targets(spark, sf):
    return scoped(spark, sf, search_all=False)


@query("exclude_rules", v.with_views(
    "select file_id, normalized_path from files f where not (list_has_any(regexp_extract_all(lower(normalized_path), '[a-z0-9]+'), ['src2', 'the', 'txt'])"
    " or contains(lower(normalized_path), 'é') or starts_with(normalized_path, '/corpus/src5/') or contains(normalized_path, '/src6/en/'))"))
def exclude_rules(spark, sf):
    rules = ["src2", "The", "txt", "é", "/corpus/src5", "src6/en", "src7/."]
    return so.exclude_paths(v.corpus(spark, sf).files, rules).select("file_id", "normalized_path")


@query("exclude_rules_below_root", v.with_views(
    "select file_id, normalized_path from files f where starts_with(normalized_path, '/corpus/src1/')"
    " and not list_has_any(regexp_extract_all(lower(substr(normalized_path, 14)), '[a-z0-9]+'), ['corpus', 'en', 'src1'])"))
def exclude_rules_below_root(spark, sf):
    files = v.corpus(spark, sf).files.where(px.under(F.col("normalized_path"), "/corpus/src1"))
    return so.exclude_paths(files, ["corpus", "src1", "en"], "/corpus/src1").select("file_id", "normalized_path")


@query("url_exclude", "select page_id, url from pages where not (contains(lower(url), 'spam-farm') or contains(lower(url), '/de/'))")
def url_exclude(spark, sf):
    return v.table(spark, sf, "pages").where(~rl.excluded_url(F.col("url"), ["Spam-Farm", "/de/"])).select("page_id", "url")


@query("filter_results", v.with_views(
    "select file_id, file_ext from files where file_ext = '.md' and contains(folder_path, '/src1') and not contains(folder_path, '/fr')"))
def filter_results(spark, sf):
    rows = v.corpus(spark, sf).files.withColumn("folder_path", px.parent_folder(F.col("normalized_path"), F.col("file_name")))
    kept = so.filter_ext(rows, "md")
    return so.filter_paths(kept, "/SRC1", ["/fr"], "folder_path").select("file_id", "file_ext")


# --- patterns, folders, names ------------------------------------------------


@query("regex_search", v.with_views(
    "select 'file' as result_kind, normalized_path as full_path, case when regexp_matches(file_name, 'th[ae]r+|src1[0-2]', 'i') then 2 else 0 end as filename_match_level, mtime"
    " from files where (regexp_matches(content, 'th[ae]r+|src1[0-2]', 'i') or regexp_matches(file_name, 'th[ae]r+|src1[0-2]', 'i'))"
    " and not (contains(lower(content), 'wher') or contains(lower(file_name), 'wher') or contains(lower(folder_path), 'wher'))"
    " union all select 'folder', folder_path, 0, mtime from (select folder_path, mtime, row_number() over (partition by folder_path order by has_top_tag desc,"
    " click_count + imported_click_count desc, mtime desc, file_id desc) as n from files where regexp_matches(folder_path, 'th[ae]r+|src1[0-2]', 'i')"
    " and not (contains(lower(content), 'wher') or contains(lower(file_name), 'wher') or contains(lower(folder_path), 'wher'))) where n = 1"))
def regex_search(spark, sf):
    found = search(v.corpus(spark, sf), request("th[ae]r+|src1[0-2] -wher", regex=True))
    return found.matches.select("result_kind", "full_path", "filename_match_level", "mtime")


@query("folder_search", v.with_views(
    "select -row_number() over (order by folder_path) as folder_id, folder_path, max(created_at) as created_at, max(mtime) as mtime"
    " from files where contains(folder_path, 'src1') and not contains(folder_path, '/en') group by folder_path"))
def folder_search(spark, sf):
    hits = fo.folder_hits(v.corpus(spark, sf).files, ["SRC1"], ["/en"])
    numbered = rk.number_rows(hits, [F.col("folder_path")], "n")
    return numbered.select((-F.col("n")).alias("folder_id"), "folder_path", "created_at", "mtime")


@query("search_with_folders", v.with_views(
    "select result_kind, full_path, mtime from (select 'file' as result_kind, normalized_path as full_path, mtime from ranked"
    " union all select 'folder', folder_path, max(mtime) from files where contains(folder_path, 'src1') and contains(folder_path, 'en') group by folder_path)",
    **v.search_views([["src1"], ["en"]], q="src1 en", body=False)))
def search_with_folders(spark, sf):
    found = search(v.corpus(spark, sf), request("src1 en", target="filename_and_folder"))
    return found.matches.select("result_kind", "full_path", "mtime")


@query("name_only_search", v.with_views(
    "select row_number() over (order by date_modified desc, kind, file_id desc, path) as position, name, path, type, date_modified from ("
    " select name, path, type, date_modified, kind, file_id from ("
    " select file_name as name, normalized_path as path, 'file' as type, mtime as date_modified, 0 as kind, file_id from ranked"
    " union all select regexp_extract(folder_path, '[^/]*$'), folder_path, 'directory', max(mtime), 1, -1 from files where contains(folder_path, 'en') group by folder_path)"
    " order by date_modified desc, kind, file_id desc, path limit 100)",
    **v.search_views([["en"]], q="en", body=False)))
def name_only_search(spark, sf):
    return search_names(v.corpus(spark, sf), "en", sort_by="modified").select("position", "name", "path", "type", "date_modified")


@query("name_search_total", v.with_views(
    "select count(*) as total from (select file_id from ranked union all select -1 from files where contains(folder_path, 'en') group by folder_path)",
    **v.search_views([["en"]], q="en", body=False)))
def name_search_total(spark, sf):
    from lodestone.plans.search import search_names_info

    return search_names_info(v.corpus(spark, sf), "en").select("total")


# --- snippets ----------------------------------------------------------------

ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("snippets_literal", v.with_views(
    "select file_id, concat(case when b > 0 then '...' else '' end, regexp_replace("
    + ESCAPED.format("substr(content, cast(b + 1 as int), cast(e - b as int))")
    + ", '(with)', '<mark>\\1</mark>', 'gi'), case when e < length(content) then '...' else '' end) as snippet from ("
    " select file_id, content, greatest(s - 48, 0) as b, least(s + 4 + 48, length(content)) as e from ("
    " select file_id, content, strpos(lower(content), 'with') - 1 as s from files where contains(lower(content), 'with')))"))
def snippets_literal(spark, sf):
    body = v.corpus(spark, sf).segments
    return body.select("file_id", sn.literal_snippet(F.col("content"), ["with"]).alias("snippet")).where("snippet is not null")


@query("snippets_page", only_page(page_sql(v.DEFAULT_ORDER, 20, 0, [["of"]], "of")).replace(
    "select position, file_id, full_path, relevance_bucket, utility_score from", "select position, file_id, true as is_marked from", 1))
def snippets_page(spark, sf):
    rows = search(v.corpus(spark, sf), request("of", limit=20)).page()
    return rows.select("position", "file_id", F.col("snippet").contains("<mark>").alias("is_marked"))


@query("snippets_regex", v.with_views(
    "select file_id, concat(case when b > 0 then '...' else '' end, " + ESCAPED.format("substr(content, cast(b + 1 as int), cast(s - b as int))")
    + ", '<mark>', " + ESCAPED.format("m") + ", '</mark>', " + ESCAPED.format("substr(content, cast(s + length(m) + 1 as int), cast(e - s - length(m) as int))")
    + ", case when e < length(content) then '...' else '' end) as snippet from ("
    " select *, greatest(s - 48, 0) as b, least(s + length(m) + 48, length(content)) as e from ("
    " select file_id, content, regexp_extract(content, '(?i)whe[nr]+') as m, length(string_split_regex(content, '(?i)whe[nr]+')[1]) as s"
    " from files where regexp_matches(content, '(?i)whe[nr]+')))"))
def snippets_regex(spark, sf):
    body = v.corpus(spark, sf).segments.where(F.col("content").rlike("(?i)whe[nr]+"))
    return body.select("file_id", sn.regex_snippet(F.col("content"), "whe[nr]+").alias("snippet"))


@query("snippets_names", v.with_views(
    "select file_id, concat('ファイル名一致: <mark>', " + ESCAPED.format("file_name") + ", '</mark>" + sn.NAME_ONLY_NOTE + "') as snippet from files where contains(lower(file_name), 'en')"))
def snippets_names(spark, sf):
    rows = v.corpus(spark, sf).files.where(F.lower("file_name").contains("en"))
    return rows.select("file_id", sn.name_snippet(F.col("file_name")).alias("snippet"))


@query("snippets_tokens", v.with_views(
    "select file_id, concat(case when b > 1 then ' ... ' else '' end, regexp_replace(" + ESCAPED.format("array_to_string(p[b:b + 35], ' ')")
    + ", '(with)', '<mark>\\1</mark>', 'gi'), case when b + 35 < len(p) then ' ... ' else '' end) as snippet from ("
    " select *, greatest(spot - 18, 1) as b from (select file_id, p, list_position(list_transform(p, lambda x: contains(lower(x), 'with')), true) as spot"
    " from (select file_id, string_split_regex(content, '\\s+') as p from files)) where spot > 0)"))
def snippets_tokens(spark, sf):
    body = v.corpus(spark, sf).segments
    return body.select("file_id", sn.token_snippet(F.col("content"), ["with"]).alias("snippet")).where("snippet is not null")


@query("text_fragments",
    "select page_id, concat(url, '#:~:text=', url_encode(w)) as link from (select page_id, url, regexp_extract(html, '<title>([a-zA-Z]+ [a-zA-Z]+)', 1) as w from pages) where w <> ''")
def text_fragments(spark, sf):
    pages = v.table(spark, sf, "pages").withColumn("w", F.regexp_extract("html", "<title>([a-zA-Z]+ [a-zA-Z]+)", 1)).where("w != ''")
    marked = F.concat(F.lit("a <mark>"), "w", F.lit("</mark> b"))
    return pages.select("page_id", ux.text_fragment_url(F.col("url"), marked).alias("link"))


@query("html_round_trip", "select page_id, trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) as heading,"
    " " + ESCAPED.format("html") + " as escaped from pages")
def html_round_trip(spark, sf):
    pages = v.table(spark, sf, "pages")
    heading = tx.strip_html(tx.html_escape(F.regexp_replace(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), "<[^>]+>", "")))
    return pages.select("page_id", heading.alias("heading"), tx.html_escape(F.col("html")).alias("escaped"))


# --- query preparation -------------------------------------------------------


@query("parse_terms",
    "select item_id, array_to_string(list_filter(t, lambda x: not starts_with(x, 'th')), ' ') as included, array_to_string(list_filter(t, lambda x: starts_with(x, 'th')), ' ') as excluded"
    " from (select item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as t from benchmark)")
def parse_terms(spark, sf):
    """Benchmark texts as queries; words that begin with ``th`` are turned into exclusions."""
    texts = v.table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", r"(^|\s)(th)", "$1-$2").alias("q"))
    return texts.select("item_id", F.array_join(tm.include_terms(F.col("q")), " ").alias("included"),
                        F.array_join(tm.exclude_terms(F.col("q")), " ").alias("excluded"))


@query("term_routes",
    "select term, regexp_matches(term, '[A-Za-z]') and regexp_matches(term, '[0-9]') or starts_with(term, '-') as is_literal"
    " from (select distinct unnest(string_split_regex(text, '\\s+')) as term from documents) where term <> ''")
def term_routes(spark, sf):
    terms = v.table(spark, sf, "documents").select(F.explode(tm.raw_terms(F.col("text"))).alias("term")).distinct()
    return terms.select("term", tm.needs_literal_match(F.col("term")).alias("is_literal"))


@query("query_keys", "select conv_id, turn, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') as normalized_query from conversations")
def query_keys(spark, sf):
    return v.table(spark, sf, "conversations").select("conv_id", "turn", tm.normalize_query("text").alias("normalized_query"))


SYNONYM_LINES_SQL = "select item_id as group_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as members from benchmark"


def synonym_table(spark, sf):
    """The words of every benchmark text as a synonym group."""
    from lodestone.sources.rules import synonym_rules

    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    lines = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("group_id"), F.array_join(words, " ,").alias("value"))
    return synonym_rules(lines)


@query("synonym_groups", f"select group_id, term from (select group_id, unnest(members) as term from ({SYNONYM_LINES_SQL}))")
def synonym_groups(spark, sf):
    return synonym_table(spark, sf).select("group_id", "term")


@query("expand_synonyms",
    f"with g as ({SYNONYM_LINES_SQL}), r as (select group_id, unnest(members) as term from g), claim as (select term, min(group_id) as group_id from r group by term),"
    " t as (select conv_id * 1000 + turn as query_id, unnest(w) as term, generate_subscripts(w, 1) - 1 as term_index from (select conv_id, turn, regexp_extract_all(lower(text), '[a-z]+')[1:3] as w from conversations))"
    " select distinct query_id, term_index, term from (select query_id, term_index, term from t union all"
    " select query_id, term_index, r.term from t join claim on claim.term = t.term join r on r.group_id = claim.group_id)")
def expand_synonyms(spark, sf):
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), 1, 3)
    terms = v.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.posexplode(words).alias("term_index", "term"))
    return tm.expand_terms(terms, synonym_table(spark, sf)).select("query_id", "term_index", "term")


@query("highlight_terms", "select item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' ') as terms from benchmark")
def highlight_terms(spark, sf):
    words = F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), F.lit(1))
    folded = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.array(w, F.upper(w)))
    rows = v.table(spark, sf, "benchmark").where(F.size(words) >= 0)
    kept = F.array_sort(F.transform(tm.highlight_terms(folded), lambda w: F.lower(w)))
    return rows.select("item_id", F.array_join(kept, " ").alias("terms"))


# --- batch -------------------------------------------------------------------

BATCH_SQL = v.with_views(
    f"""select query_id, file_id, match_rank, round(score, 8) as score,
      cast(11 - floor(cume_dist() over (partition by query_id order by match_rank, score) * 10 + 0.999999) as int) as relevance_bucket from (
      select query_id, file_id, min(match_rank) as match_rank, arg_min(score, (match_rank, score)) as score from (
        select t.query_id, t.term, u.file_id, 0 as match_rank, {v.bm25_sql('u.tf', 'u.n', 'd.df')} as score, t.n_terms
        from terms t join u on u.term = t.word join d on d.term = t.word, stats
        union all select t.query_id, t.term, f.file_id, r, 1000000.0, t.n_terms from terms t
          join names f on contains(f.name, lower(t.term)))
      group by query_id, file_id having count(distinct term) = any_value(n_terms))""",
    toks=v.TOKENS_SQL,
    stats="select count(*) as n_docs, avg(n) as avg_len from toks",
    u="select file_id, any_value(n) as n, term, count(*) as tf from (select file_id, n, unnest(tk) as term from toks) group by file_id, term",
    d="select term, count(*) as df from u group by term",
    names="select file_id, lower(file_name) as name, 2 as r from files union all select file_id, lower(title), 3 from files union all select file_id, lower(aliases), 4 from files where aliases is not null",
    terms="""select query_id, term, term as word, count(*) over (partition by query_id) as n_terms from (
      select distinct conv_id * 1000 + turn as query_id, unnest(regexp_extract_all(lower(text), '[a-z]+')[1:3]) as term from conversations)""",
)


def batch_queries(spark, sf):
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), 1, 3)
    return v.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.array_join(F.array_distinct(words), " ").alias("q"))


@query("batch_search", BATCH_SQL)
def batch_search(spark, sf):
    """The first words of every conversation turn, searched for in one job."""
    corpus = v.stored_corpus(spark, sf).with_(query_clicks=None)
    return search_many(corpus, batch_queries(spark, sf), as_of=v.AS_OF).select(
        "query_id", "file_id", "match_rank", F.round("score", 8).alias("score"), "relevance_bucket")


@query("batch_passages", v.with_views(
    "select item_id, file_id from (select b.item_id, t.file_id from (select item_id, list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as ws from benchmark) b,"
    f" toks t where list_has_all(t.tk, flatten(list_transform(b.ws, lambda w: regexp_extract_all(lower(w), {v.WORDS}))))"
    f" and len(list_filter(b.ws, lambda w: len(regexp_extract_all(lower(w), {v.WORDS})) > 1 and not contains(concat(' ', array_to_string(t.tk, ' '), ' '), concat(' ', array_to_string(regexp_extract_all(lower(w), {v.WORDS}), ' '), ' ')))) = 0)",
    toks=v.TOKENS_SQL))
def batch_passages(spark, sf):
    """Whole benchmark passages as body queries: files that hold every word of one."""
    corpus = v.stored_corpus(spark, sf)
    queries = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    found = search_many(corpus, queries, target="body", as_of=v.AS_OF)
    return found.select(F.col("query_id").alias("item_id"), "file_id")


@query("extension_lists", v.with_views("select file_id, file_ext, 'content' as kind from files"))
def extension_lists(spark, sf):
    files = v.corpus(spark, sf).files
    found = ext.resolve_extension(F.col("file_name"), ext.known_extensions())
    return files.select("file_id", found.alias("file_ext"), ext.extension_kind(found).alias("kind"))
