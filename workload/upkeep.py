"""Corpus upkeep: diffs, deletions, roots, reports, refresh, click streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.functions import rules as rl
from lodestone.operators import folders as fo
from lodestone.operators import maintain as mn
from lodestone.operators import rank as rk
from lodestone.operators import reports as rp
from lodestone.operators import scope as so
from lodestone.plans.refresh import refresh, refresh_stored, refresh_targets
from lodestone.plans.search import search
from lodestone.session import scratch_path
from lodestone.sources.corpus import read_corpus, write_corpus
from lodestone.streaming import clicks as ck
from workload import views as v
from workload.registry import query
from workload.searching import request

LISTED = {"listing": v.LISTING_SQL}
GONE = "not exists (select 1 from listing l where l.normalized_path = f.normalized_path)"


def files_of(spark, sf):
    return v.corpus(spark, sf).files


@query("snapshot_diff", v.with_views(
    "select coalesce(f.normalized_path, l.normalized_path) as normalized_path, case when f.normalized_path is null then 'new'"
    " when l.normalized_path is null then 'missing' when f.mtime = l.mtime and f.size = l.size and f.last_error is null then 'unchanged' else 'changed' end as change"
    " from files f full join listing l on l.normalized_path = f.normalized_path", **LISTED))
def snapshot_diff(spark, sf):
    return mn.diff_snapshot(files_of(spark, sf), v.listing(spark, sf))


@query("digest_diff", v.with_views(
    "select coalesce(f.normalized_path, l.normalized_path) as normalized_path, case when f.normalized_path is null then 'new'"
    " when l.normalized_path is null then 'missing' when f.mtime = l.mtime and f.size = l.size and f.last_error is null then 'unchanged' else 'changed' end as change"
    " from files f full join later l on l.normalized_path = f.normalized_path",
    listing=v.LISTING_SQL,
    later="select normalized_path, mtime, size from listing where starts_with(normalized_path, '/corpus/src1') or starts_with(normalized_path, '/corpus/new/')"
    " union all select normalized_path, mtime, size from files where not starts_with(normalized_path, '/corpus/src1')"))
def digest_diff(spark, sf):
    """A later state in which most folders are as they were: their rows are compared by digests only."""
    changed, files = v.listing(spark, sf), files_of(spark, sf)
    path, columns = F.col("normalized_path"), ("normalized_path", "mtime", "size")
    later = changed.where(path.startswith("/corpus/src1") | path.startswith("/corpus/new/")).select(*columns)
    return mn.digest_diff(files, later.unionByName(files.where(~path.startswith("/corpus/src1")).select(*columns)))


@query("run_statistics", v.with_views(
    "select count(*) filter (change <> 'missing') as files, count(*) filter (change in ('new', 'changed') and not bad) as writes,"
    " count(*) filter (change = 'unchanged') as skipped, count(*) filter (change = 'missing') as removed, count(*) filter (bad) as errors from ("
    " select case when f.normalized_path is null then 'new' when l.normalized_path is null then 'missing'"
    " when f.mtime = l.mtime and f.size = l.size and f.last_error is null then 'unchanged' else 'changed' end as change,"
    " coalesce(l.file_ext = '.json' and (f.normalized_path is null or f.mtime <> l.mtime or f.size <> l.size), false) as bad"
    " from files f full join listing l on l.normalized_path = f.normalized_path)", **LISTED))
def run_statistics(spark, sf):
    listing, files = v.listing(spark, sf), files_of(spark, sf)
    diff = mn.diff_snapshot(files, listing)
    old = files.select("normalized_path", F.struct("mtime", "size").alias("old"))
    failed = listing.join(old, "normalized_path", "left").where(
        "file_ext = '.json' and (old is null or old.mtime <> mtime or old.size <> size)")
    return rp.run_statistics(diff, failed)


@query("missing_rows", v.with_views(f"select file_id, normalized_path from files f where {GONE}", **LISTED))
def missing_rows(spark, sf):
    return mn.missing_rows(files_of(spark, sf), v.listing(spark, sf), root="/corpus").select("file_id", "normalized_path")


@query("scoped_delete", v.with_views(
    f"select file_id, normalized_path from files f where not ({GONE} and starts_with(normalized_path, '/corpus/src1/') and file_ext in ('.md', '.excalidraw.md')"
    " and not list_has_any(regexp_extract_all(lower(normalized_path), '[a-z0-9]+'), ['fr', 'the']))", **LISTED))
def scoped_delete(spark, sf):
    return mn.scoped_delete(files_of(spark, sf), v.listing(spark, sf), root="/corpus/src1", depth=3, extensions=[".md"], rules=["fr", "the"]
                            ).select("file_id", "normalized_path")


@query("scoped_delete_shallow", v.with_views("select count(*) as n from files"))
def scoped_delete_shallow(spark, sf):
    """A refresh of level 1 has no say over files two levels down: nothing goes."""
    kept = mn.scoped_delete(files_of(spark, sf), v.listing(spark, sf), root="/corpus", depth=1)
    return kept.agg(F.count("*").alias("n"))


@query("failures_latest", f"select normalized_path, arg_max(error_message, last_failed_at) as error_message, max(last_failed_at) as last_failed_at from ({v.FAILURES_SQL}) group by normalized_path")
def failures_latest(spark, sf):
    return mn.latest_failures(v.failures(spark, sf)).select("normalized_path", "error_message", "last_failed_at")


LATEST_SQL = f"select normalized_path, max(last_failed_at) as last_failed_at from ({v.FAILURES_SQL}) group by normalized_path"


@query("failure_list", f"select row_number() over (order by last_failed_at desc, normalized_path) as position, normalized_path from ({LATEST_SQL})")
def failure_list(spark, sf):
    ordered = rp.failure_list(mn.latest_failures(v.failures(spark, sf)))
    return rk.number_rows(ordered, rp.FAILURES_NEWEST(), "position").select("position", "normalized_path")


@query("clear_failures", f"select normalized_path from ({LATEST_SQL}) where not (starts_with(normalized_path, '/corpus/src1/') and not ends_with(normalized_path, '1.md'))")
def clear_failures(spark, sf):
    latest = mn.latest_failures(v.failures(spark, sf))
    again = latest.where(F.col("normalized_path").endswith("1.md"))
    return mn.clear_failures(latest, again, root="/corpus/src1").select("normalized_path")


@query("apply_diff", v.with_views(
    "select normalized_path, mtime, size, click_count, imported_click_count from ("
    " select l.normalized_path, l.mtime, l.size, coalesce(f.click_count, 0) as click_count, coalesce(f.imported_click_count, 0) as imported_click_count"
    " from listing l left join files f on f.normalized_path = l.normalized_path)", **LISTED))
def apply_diff(spark, sf):
    files, listing = files_of(spark, sf), v.listing(spark, sf)
    from lodestone.operators.index import build_files

    todo = mn.diff_snapshot(files, listing).where("change in ('new', 'changed')").select("normalized_path")
    fresh = build_files(listing.join(todo, "normalized_path", "left_semi").withColumn("source_type", F.lit("local")))
    gone = mn.missing_rows(files, listing, root="/corpus").select("normalized_path")
    return mn.apply_diff(files, fresh, gone).select("normalized_path", "mtime", "size", "click_count", "imported_click_count")


LISTED_TERMS_SQL = v.with_views(
    f"select term, count(distinct normalized_path) as df from (select normalized_path, unnest(regexp_extract_all(lower(content), {v.WORDS})) as term from listing) group by term", **LISTED)


def refreshed_path(spark, sf):
    """A stored corpus with the later listing on top of it as a delta."""

    def make():
        path = scratch_path(spark, "delta")
        write_corpus(v.corpus(spark, sf), path)
        refresh_stored(path, _as_text(v.listing(spark, sf)), "/corpus", v.AS_OF)
        return path

    return v.kept(spark, sf, "delta", make)


@query("refresh_stored_delta", LISTED_TERMS_SQL)
def refresh_stored_delta(spark, sf):
    """Term counts of a base merged with a delta."""
    return read_corpus(spark, refreshed_path(spark, sf)).terms.where("kind = 'word'").select("term", "df")


@query("refresh_stored_files", v.with_views(
    "select l.normalized_path, l.mtime, l.size, coalesce(f.click_count, 0) as click_count from listing l left join files f on f.normalized_path = l.normalized_path", **LISTED))
def refresh_stored_files(spark, sf):
    return read_corpus(spark, refreshed_path(spark, sf)).files.select("normalized_path", "mtime", "size", "click_count")


@query("rebuilt_index", LISTED_TERMS_SQL)
def rebuilt_index(spark, sf):
    """Term counts of an index made anew from the merged bodies."""
    return read_corpus(spark, refreshed_path(spark, sf)).rebuilt().terms.where("kind = 'word'").select("term", "df")


@query("refresh_incremental", LISTED_TERMS_SQL)
def refresh_incremental(spark, sf):
    """Term counts after a refresh: those of the listing, though most rows were kept."""
    done = refresh(v.corpus(spark, sf).indexed(), _as_text(v.listing(spark, sf)), "/corpus", v.AS_OF)
    return done.corpus.terms.where("kind = 'word'").select("term", "df")


def _as_text(listing):
    """Listing rows whose body is given as text and needs no reader."""
    return listing.withColumn("source_type", F.lit("local"))


#: Stored rows that a refresh of their own enabled root answers for: its depth, extensions and rules.
MINE_SQL = """
  starts_with(normalized_path, '/corpus/src1/') and ends_with(normalized_path, '.md')
  or starts_with(normalized_path, '/corpus/src2/en/') and not contains(normalized_path, '/the-')
"""


@query("refresh_targets", v.with_views(
    f"""select l.normalized_path, l.size from listing l where starts_with(l.normalized_path, '/corpus/src1/') or starts_with(l.normalized_path, '/corpus/src2/en/')
    union all select f.normalized_path, f.size from files f
    where not (starts_with(normalized_path, '/corpus/src1/') or starts_with(normalized_path, '/corpus/src2/en/'))
      or (not ({MINE_SQL}) and {GONE})""", **LISTED))
def refresh_targets_query(spark, sf):
    """Three roots: extensions, rules and depth of their own, one disabled, one too shallow to see a file."""
    rows = [("/corpus/src1", True, [], 5, [".md"]), ("/corpus/src2/en", True, ["the"], 5, None), ("/corpus/src4", True, [], 0, None), ("/corpus/src3", False, [], 5, None)]
    layout = "full_path string, is_enabled boolean, exclude_rules array<string>, index_depth int, selected_extensions array<string>"
    targets = spark.createDataFrame(rows, layout).withColumn("source_type", F.lit("local"))
    root = F.when(F.col("normalized_path").startswith("/corpus/src1/"), "/corpus/src1").when(F.col("normalized_path").startswith("/corpus/src2/en/"), "/corpus/src2/en")
    listing = _as_text(v.listing(spark, sf)).withColumn("root", root).where("root is not null")
    done = refresh_targets(v.corpus(spark, sf), targets, listing, v.AS_OF)
    return done.corpus.files.select("normalized_path", "size")


@query("needs_refresh",
    "select full_path, last_indexed_at is null or exclude_rules <> 'old' or index_depth <> 5 or index_version < 1"
    f" or {v.AS_OF} - last_indexed_at > 6000 as needs_refresh from ({v.TARGETS_SQL})")
def needs_refresh(spark, sf):
    return mn.needs_refresh(v.targets(spark, sf), 100, ["old"], 5, [".md", ".json"], v.AS_OF).select("full_path", "needs_refresh")


@query("mark_fresh", f"select full_path, case when full_path = '/corpus/src4' then {v.AS_OF} else last_indexed_at end as last_indexed_at,"
    f" case when full_path = '/corpus/src4' then 7 else indexed_file_count end as indexed_file_count from ({v.TARGETS_SQL})")
def mark_fresh(spark, sf):
    return mn.mark_fresh(v.targets(spark, sf), "/corpus/src4", v.AS_OF, ["old"], 5, [".md"], 7).select("full_path", "last_indexed_at", "indexed_file_count")


@query("root_coverage", v.with_views(
    "select p.folder_path as path, (select arg_max(t.full_path, length(t.full_path)) from targets t where t.is_enabled and (p.folder_path = t.full_path or starts_with(p.folder_path, concat(t.full_path, '/')))) as covering_root"
    " from (select distinct folder_path from files union select '/elsewhere') p", targets=v.TARGETS_SQL))
def root_coverage(spark, sf):
    folders = files_of(spark, sf).select(px.parent_folder(F.col("normalized_path"), F.col("file_name")).alias("path")).distinct()
    folders = folders.unionByName(folders.limit(1).select(F.lit("/elsewhere").alias("path")))
    return so.covering_root(folders.withColumn("source_type", F.lit("local")), v.targets(spark, sf)).select("path", "covering_root")


@query("assert_covered", v.with_views(
    "select folder_path as path, exists (select 1 from targets t where t.is_enabled and (p.folder_path = t.full_path or starts_with(p.folder_path, concat(t.full_path, '/')))) as is_allowed"
    " from (select distinct folder_path from files) p", targets=v.TARGETS_SQL))
def assert_covered(spark, sf):
    folders = files_of(spark, sf).select(px.parent_folder(F.col("normalized_path"), F.col("file_name")).alias("path")).distinct()
    return mn.assert_covered(folders.withColumn("source_type", F.lit("local")), v.targets(spark, sf)).select("path", "is_allowed")


@query("overlapping_roots", v.with_views(
    "select p.path, t.full_path as root from (select distinct folder_path as path from files where contains(folder_path, 'src1') union select '/corpus') p join targets t"
    " on p.path = t.full_path or starts_with(p.path, concat(t.full_path, '/')) or starts_with(t.full_path, concat(p.path, '/'))", targets=v.TARGETS_SQL))
def overlapping_roots(spark, sf):
    folder = px.parent_folder(F.col("normalized_path"), F.col("file_name"))
    folders = files_of(spark, sf).select(folder.alias("path")).where("path like '%src1%'")
    above = files_of(spark, sf).select(F.regexp_extract("normalized_path", "^(/[^/]*)", 1).alias("path"))
    return so.overlapping_roots(folders.unionByName(above).distinct(), v.targets(spark, sf))


DOOMED = "(starts_with(normalized_path, '/corpus/src2/') or starts_with(normalized_path, '/corpus/src3/en/'))"


@query("delete_targets", v.with_views(
    f"select 'file' as kind, normalized_path as name, cast(file_id as double) as value from files where not {DOOMED}"
    f" union all select 'failure', normalized_path, last_failed_at from ({LATEST_SQL}) where not {DOOMED}"
    " union all select 'target', full_path, case when full_path in ('/corpus/src2', '/corpus/src2/en', '/corpus/src2/fr', '/corpus/src3', '/corpus/src3/en') then null else last_indexed_at end from targets",
    targets=v.TARGETS_SQL))
def delete_targets(spark, sf):
    targets = v.targets(spark, sf)
    doomed = targets.where("full_path in ('/corpus/src2', '/corpus/src3/en')").select(F.col("full_path").alias("path"))
    files, failed, marked = mn.delete_targets(files_of(spark, sf), mn.latest_failures(v.failures(spark, sf)), targets, doomed)
    return (
        files.select(F.lit("file").alias("kind"), F.col("normalized_path").alias("name"), F.col("file_id").cast("double").alias("value"))
        .unionByName(failed.select(F.lit("failure").alias("kind"), F.col("normalized_path").alias("name"), F.col("last_failed_at").alias("value")))
        .unionByName(marked.select(F.lit("target").alias("kind"), F.col("full_path").alias("name"), F.col("last_indexed_at").alias("value")))
    )


@query("delete_files", v.with_views("select file_id from files where not exists (select 1 from labels l where l.doc_id = file_id and l.toxic = 1)"))
def delete_files(spark, sf):
    ids = v.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return mn.delete_files(files_of(spark, sf), ids).select("file_id")


@query("auto_exclude", f"select full_path, exclude_rules || coalesce(',' || found, '') as exclude_rules from ({v.TARGETS_SQL}) t left join"
    f" (select concat('/corpus/src', user_id % 20) as root, string_agg(distinct concat('/corpus/src', user_id % 20, '/en/f', user_id), ',' order by concat('/corpus/src', user_id % 20, '/en/f', user_id)) as found"
    " from events where event_type = 'error' and user_id % 3 = 0 group by 1) u on u.root = t.full_path")
def auto_exclude(spark, sf):
    failed = v.table(spark, sf, "events").where("event_type = 'error' and user_id % 3 = 0")
    root = F.concat(F.lit("/corpus/src"), F.col("user_id") % 20)
    unreachable = failed.select(root.alias("root"), F.concat(root, F.lit("/en/f"), "user_id").alias("path"))
    return mn.auto_exclude(v.targets(spark, sf), unreachable).select("full_path", F.array_join("exclude_rules", ",").alias("exclude_rules"))


@query("merge_target_rules", f"select full_path, replace(concat(exclude_rules, ',dist,/corpus/Tmp'), 'old,', '') as exclude_rules from ({v.TARGETS_SQL})")
def merge_target_rules(spark, sf):
    merged = mn.merge_target_rules(v.targets(spark, sf), ["OLD", "build"], rl.merge_rules(["dist", "Dist"], ["/corpus/Tmp"]))
    return merged.select("full_path", F.array_join("exclude_rules", ",").alias("exclude_rules"))


@query("backfill_metadata", v.with_views(
    "select file_id, case when file_ext = '.md' then concat('About ', word) else title end as title,"
    " case when file_ext = '.md' then file_id % 8 = 0 else has_top_tag end as has_top_tag,"
    " case when file_ext = '.md' then concat(word, ' a', chr(10), 'b') else coalesce(aliases, '') end as aliases"
    " from (select *, regexp_extract(lower(content), '[a-z]+') as word from files)"))
def backfill_metadata(spark, sf):
    docs = v.documents(spark, sf)
    word = F.regexp_extract(F.lower("content"), "[a-z]+", 0)
    head = F.concat(F.lit("---\ntitle: \"About "), word, F.lit("\"\naliases:\n  - "), word, F.lit(" a\n  - b, b\ntags: ["),
                    F.when(F.col("file_id") % 8 == 0, "x, #Top").otherwise("topmost"), F.lit("]\n---\n"))
    bodies = docs.select("file_id", F.concat(head, "content").alias("content"))
    return mn.backfill_metadata(files_of(spark, sf), bodies).select(
        "file_id", "title", "has_top_tag", F.coalesce(F.array_join("aliases", "\n"), F.lit("")).alias("aliases"))


# --- reports -----------------------------------------------------------------


@query("folder_rollup", v.with_views(
    "select full_path, sum(direct) as indexed_file_count, max(last_indexed_at) as last_indexed_at from ("
    " select folder_path as full_path, count(*) as direct, max(indexed_at) as last_indexed_at from files group by 1"
    " union all select regexp_replace(folder_path, '/[^/]*$', ''), 0, max(indexed_at) from files f where exists (select 1 from targets t where t.last_indexed_at is not null"
    "   and t.full_path = regexp_replace(folder_path, '/[^/]*$', '')) and not exists (select 1 from targets t where t.last_indexed_at is not null and t.full_path = folder_path) group by 1"
    ") group by full_path", targets=v.TARGETS_SQL))
def folder_rollup(spark, sf):
    return fo.folder_rollup(files_of(spark, sf), v.targets(spark, sf))


@query("indexed_folders", v.with_views(
    "select row_number() over (order by n desc, folder_path) as position, folder_path as full_path from (select folder_path, count(*) as n from files group by 1)"))
def indexed_folders(spark, sf):
    folders = rp.folder_list_order(rp.indexed_folders(files_of(spark, sf), v.targets(spark, sf).where("false")))
    return rk.number_rows(folders, rp.FOLDERS_LARGEST(), "position").select("position", "full_path")


@query("indexed_pages",
    "select row_number() over (order by url) as position, url as full_path, 1 as indexed_file_count from"
    " (select distinct regexp_replace(regexp_replace(url, '#.*$', ''), '\\s', '') as url from pages)")
def indexed_pages(spark, sf):
    from lodestone.operators.index import build_files
    from lodestone.sources.documents import from_pages

    files = build_files(from_pages(v.table(spark, sf, "pages"), v.AS_OF).withColumn("indexed_at", F.lit(v.AS_OF)))
    pages = rp.indexed_pages(files)
    return rk.number_rows(pages, rp.PAGES_LATEST(), "position").select("position", "full_path", "indexed_file_count")


@query("corpus_status", v.with_views(
    "select source_type, count(*) as total_files, count(last_error) as error_count, sum(size) as total_bytes, max(indexed_at) as last_indexed_at from files group by source_type"))
def corpus_status(spark, sf):
    return rp.corpus_status(files_of(spark, sf))


@query("registered_roots", f"select row_number() over (order by is_enabled desc, full_path) as position, full_path, indexed_file_count from ({v.TARGETS_SQL})")
def registered_roots(spark, sf):
    return rk.number_rows(rp.registered_roots(v.targets(spark, sf)), rp.ROOTS(), "position").select("position", "full_path", "indexed_file_count")


@query("synonym_conflicts",
    "with r as (select item_id as group_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as term from benchmark),"
    " x as (select distinct lower(regexp_extract(text, '^[A-Za-z]+')) as w from conversations)"
    " select term, count(distinct group_id) as groups, min(group_id) as winning_group, term in (select w from x) as is_excluded from r group by term"
    " having count(distinct group_id) > 1 or term in (select w from x)")
def synonym_conflicts(spark, sf):
    from lodestone.sources.rules import exclusion_rules
    from workload.searching import synonym_table

    first_word = F.regexp_extract("text", "^[A-Za-z]+", 0)
    lines = v.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("position"), first_word.alias("value"))
    return rp.synonym_conflicts(synonym_table(spark, sf), exclusion_rules(lines))


@query("exclusion_rule_table", "select any_value(word) as rule, false as is_path from (select lower(w) as k, arg_min(w, item_id) as word from"
    " (select item_id, regexp_extract(text, '^[A-Za-z]+') as w from benchmark) where w <> '' group by lower(w)) group by k")
def exclusion_rule_table(spark, sf):
    from lodestone.sources.rules import exclusion_rules

    lines = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("position"), F.regexp_extract("text", "^[A-Za-z]+", 0).alias("value"))
    return exclusion_rules(lines).select("rule", "is_path")


# --- clicks ------------------------------------------------------------------


@query("click_counters", v.QUERY_CLICKS_SQL)
def click_counters(spark, sf):
    return rp.click_counters(v.click_events(spark, sf))[1]


@query("click_totals", v.with_views(
    "select f.file_id, f.click_count + coalesce(c.n, 0) as click_count from files f left join"
    f" (select file_id, count(*) as n from ({v.CLICK_EVENTS_SQL}) group by 1) c on c.file_id = f.file_id"))
def click_totals(spark, sf):
    per_file, _ = rp.click_counters(v.click_events(spark, sf))
    return rp.apply_clicks(files_of(spark, sf), per_file).select("file_id", "click_count")


@query("click_stream", v.QUERY_CLICKS_SQL)
def click_stream(spark, sf):
    """The click table drained as a stream; the totals equal the batch ones."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events*.parquet")
    third = F.col("event_id") % 3
    clicks = events.where("event_type = 'click'").select(
        "event_id", F.col("user_id").alias("file_id"),
        F.when(third == 0, "the").when(third == 1, "the and").otherwise("with").alias("normalized_query"),
        F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("ts"))
    path = scratch_path(spark, "clicks")
    job = ck.write_counters(clicks, path, f"{path}-state").trigger(availableNow=True).start()
    job.awaitTermination()
    return ck.read_counters(spark, path)[1]


@query("search_after_refresh", v.with_views(
    "select normalized_path as full_path from listing where contains(lower(content), 'grownword')", **LISTED))
def search_after_refresh(spark, sf):
    done = refresh(v.corpus(spark, sf).indexed(), _as_text(v.listing(spark, sf)), "/corpus", v.AS_OF)
    return search(done.corpus, request("grownword", target="body")).matches.select("full_path")

