"""Text extraction, pages and links, records, paths, generated corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import frontmatter as fm
from lodestone.functions import paths as px
from lodestone.functions import urls as ux
from lodestone.operators import extract as xt
from lodestone.operators import links as lk
from lodestone.operators import match as mt
from lodestone.operators import records as rc
from lodestone.plans.search import search, to_results
from lodestone.request import SearchRequest
from lodestone.sources import generator as gn
from lodestone.sources.corpus import Corpus
from lodestone.sources.documents import from_pages, split_failures
from lodestone.sources.records import from_json_records, read_access_metrics
from workload import views as v
from workload.registry import query
from workload.searching import request

FETCHED = 1706700000.0


def docs(spark, sf):
    return v.table(spark, sf, "documents")


# --- text extraction ---------------------------------------------------------


@query("decode_text", "select doc_id, replace(text, chr(13), chr(10)) as content from documents")
def decode_text(spark, sf):
    """Text bytes with a broken byte put between two characters."""
    raw = F.encode(F.concat("text", F.lit("|")), "UTF-8")
    broken = F.concat(F.encode(F.substring("text", 1, 5), "UTF-8"), F.unhex(F.lit("C3")), F.unhex(F.lit("FF")),
                      F.encode(F.expr("substring(text, 6)"), "UTF-8"), F.unhex(F.lit("E282")))
    rows = docs(spark, sf).select("doc_id", F.when(raw.isNotNull(), broken).alias("bytes"))
    return rows.select("doc_id", xt.decode_utf8(F.col("bytes")).alias("content"))


@query("markdown_links", "select doc_id, concat(lang, ' http://', source, '/a(b).png then ', text, ' ! pic C:/x(1).png') as content from documents")
def markdown_links(spark, sf):
    text = F.concat(F.lit("["), "lang", F.lit("](http://"), "source", F.lit("/a(b).png) then "), "text", F.lit(" ! ![pic](C:/x(1).png)"))
    return docs(spark, sf).select("doc_id", xt.flatten_markdown(text).alias("content"))


@query("json_values", "select event_id, concat(event_type, chr(10), json_extract_string(props, '$.k'), chr(10), 'true', chr(10), user_id) as content from events")
def json_values(spark, sf):
    text = F.concat(F.lit('{"a": "'), "event_type", F.lit(' ", "p": '), "props", F.lit(', "n": null, "l": [true, {"u": '), "user_id", F.lit("}]}"))
    return v.table(spark, sf, "events").select("event_id", xt.json_values_text(text).alias("content"))


@query("embedded_json", "select event_id, concat(json_extract_string(props, '$.k'), chr(10), user_id) as content from events")
def embedded_json(spark, sf):
    text = F.concat(F.lit('<svg content="'), F.replace("props", F.lit('"'), F.lit("&quot;")), F.lit('"> {broken ['), "user_id", F.lit("] </svg>"))
    return v.table(spark, sf, "events").select("event_id", xt.embedded_json_values_text(text).alias("content"))


@query("xml_text", "select doc_id, case when doc_id % 9 = 0 then '' else concat(lang, chr(10), source) end as content from documents")
def xml_text(spark, sf):
    text = F.concat(F.lit("<a><b k='v'> "), "lang", F.lit(" </b>  <c>"), "source", F.when(F.col("doc_id") % 9 == 0, "</a>").otherwise("</c></a>"))
    return docs(spark, sf).select("doc_id", xt.xml_node_text(text).alias("content"))




@query("front_matter", "select doc_id, regexp_extract(lower(text), '[a-z]+') as title, concat(lang, '|', source) as aliases, doc_id % 2 = 0 as has_top_tag from documents")
def front_matter(spark, sf):
    word = F.regexp_extract(F.lower("text"), "[a-z]+", 0)
    head = F.concat(F.lit("---\r\nTitle: '"), word, F.lit("'\r\nalias: "), "lang", F.lit("\naliases: ["), "source", F.lit(", "), "lang",
                    F.lit("]\ntags:\n  - note\n  - "), F.when(F.col("doc_id") % 2 == 0, "#TOP").otherwise("stop"), F.lit("\n---\n"), "text")
    rows = docs(spark, sf).select("doc_id", head.alias("t"))
    return rows.select("doc_id", fm.front_matter_title(F.col("t")).alias("title"),
                       F.array_join(fm.front_matter_aliases(F.col("t")), "|").alias("aliases"), fm.has_pin_tag(F.col("t")).alias("has_top_tag"))


def raw_files(spark, sf):
    """Documents as files of many formats; every sixth has none that can be read here."""
    kind = F.col("doc_id") % 6
    name = F.concat(F.lit("Doc"), "doc_id", F.element_at(F.array(*map(F.lit, [".MD", ".txt", ".json", ".excalidraw.md", ".png", ".pdf"])), (kind + 1).cast("int")))
    body = F.when(kind == 2, F.concat(F.lit('{"x": "'), "source", F.lit('"}'))).when(kind == 3, F.concat(F.lit("[a](b) "), "text")).otherwise(F.col("text"))
    return docs(spark, sf).select(F.concat(F.lit("/raw/"), name).alias("normalized_path"), name.alias("file_name"), F.encode(body, "UTF-8").alias("bytes"),
                                  F.lit(v.AS_OF).alias("created_at"), F.lit(v.AS_OF).alias("mtime"), F.col("n_chars").alias("size"))


RAW_SQL = ("select concat('/raw/Doc', doc_id, ['.MD', '.txt', '.json', '.excalidraw.md', '.png', '.pdf'][(doc_id % 6 + 1)::int]) as normalized_path, doc_id % 6 as k,"
           " case doc_id % 6 when 2 then source when 3 then concat('a b ', text) when 4 then null when 5 then null else text end as content from documents")


@query("extract_files", f"select normalized_path, ['.md', '.txt', '.json', '.excalidraw.md', '.png'][(k + 1)::int] as file_ext, content from ({RAW_SQL}) where k < 5")
def extract_files(spark, sf):
    good, _ = split_failures(xt.extract_text(raw_files(spark, sf)), v.AS_OF)
    return good.select("normalized_path", "file_ext", "content")


@query("extraction_failures", f"select normalized_path, 'Unsupported extension: .pdf' as error_message, {v.AS_OF} as last_failed_at from ({RAW_SQL}) where k = 5")
def extraction_failures(spark, sf):
    _, bad = split_failures(xt.extract_text(raw_files(spark, sf)), v.AS_OF)
    return bad.select("normalized_path", "error_message", "last_failed_at")


# --- pages and links ---------------------------------------------------------

PLAIN = ("trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({0},"
         " '<!--.*?-->', ' ', 'gs'), '(?s)<title>.*?</title>|<style>.*?</style>|<script>.*?</script>', ' ', 'g'), '<[^>]*>', ' ', 'g'),"
         " '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))")


@query("page_extract",
    "select page_id, trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&')) as title, " + PLAIN.format("html") + " as content,"
    " array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') as links from pages")
def page_extract(spark, sf):
    pages = xt.extract_pages(v.table(spark, sf, "pages"))
    return pages.select("page_id", "title", "content", F.array_join("links", " ").alias("links"))


URL = "regexp_replace(regexp_replace(url, '#.*$', ''), '\\s', '')"


@query("normalize_urls", f"select page_id, {URL} as url, regexp_extract(url, '://([^/]*)', 1) as host from pages")
def normalize_urls(spark, sf):
    shouted = F.concat(F.upper(F.regexp_extract("url", "^[a-z]+://[^/]*", 0)), F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    return v.table(spark, sf, "pages").select("page_id", ux.normalize_url(shouted).alias("url"), ux.url_host(F.col("url")).alias("host"))


@query("url_names", "select page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) as name,"
    " regexp_extract(url, '^(https?://.*/)[^/]*$', 1) as scope from (select page_id, regexp_replace(url, '[?#].*$', '') as url from pages)")
def url_names(spark, sf):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return v.table(spark, sf, "pages").select("page_id", ux.url_name(F.col("url")).alias("name"), ux.url_scope(bare).alias("scope"))


@query("web_search",
    "select page_id from pages where regexp_matches(lower(" + PLAIN.format("html") + "), '(^|[^\\p{L}\\p{N}])thing([^\\p{L}\\p{N}]|$)')")
def web_search(spark, sf):
    pages = v.table(spark, sf, "pages")
    corpus = Corpus.of(from_pages(pages, FETCHED), stage=True)
    found = search(corpus, request("thing", source_type="web", target="body")).matches
    keyed = pages.select("page_id", ux.normalize_url(F.col("url")).alias("full_path"))
    return keyed.join(found.select("full_path"), "full_path", "left_semi").select("page_id")


@query("page_links", f"select distinct src_url, concat(regexp_extract(src_url, '^https?://[^/]*'), link) as dst_url from (select {URL} as src_url,"
    " unnest(regexp_extract_all(html, 'href=\"([^\"#?]*)\"', 1)) as link from pages) where starts_with(link, '/') and not contains(link, '//')")
def page_links(spark, sf):
    edges = lk.page_links(lk.pages_with_links(v.table(spark, sf, "pages")))
    path = ux.url_path(F.col("dst_url"))
    return edges.where(path.isNotNull())


@query("page_scope", f"select url, arg_max(scope_url, [2, 1, 0][(page_id % 3 + 1)::int]) as scope_url from (select page_id, {URL} as url, case page_id % 3 when 0 then concat(regexp_extract(url, '^https?://[^/]*'), '/', regexp_extract(url, '^https?://[^/]*/([^/]*)/', 1), '/')"
    " when 1 then concat(regexp_extract(url, '^https?://[^/]*'), '/')"
    " else case when ends_with(regexp_replace(url, '[?#].*$', ''), '/') then " + URL + " else regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(https?://.*/)[^/]*$', 1) end end as scope_url from pages) group by url")
def page_scope(spark, sf):
    """Every third page has JSON-LD breadcrumbs, every third markup ones, the rest none."""
    pages = v.table(spark, sf, "pages")
    section = F.regexp_extract("url", r"^https?://[^/]*/([^/]*)/", 1)
    ld = F.concat(F.lit('{"@graph": [{"@type": "BreadcrumbList", "itemListElement": ["/", {"item": {"@id": "/'), section, F.lit('/"}}, "http://elsewhere.org/"]}]}'))
    k = F.col("page_id") % 3
    none = F.array().cast("array<string>")
    rows = pages.select("url", F.when(k == 0, F.array(F.lit("not json"), ld)).otherwise(none).alias("json_ld_blocks"),
                        F.when(k != 2, F.array(F.lit("/"), F.lit("#here"))).otherwise(none).alias("breadcrumb_links"))
    return lk.page_scope(rows)


@query("crawl_frontier",
    f"with recursive links as ({v.TREE_LINKS_SQL}), walk as (select url, 0 as depth from pages where page_id = 0 union select dst_url, depth + 1 from walk join links on src_url = url"
    " where depth < 6 and not contains(lower(dst_url), 'spam-farm')) select url, min(depth) as depth from walk group by url")
def crawl_frontier(spark, sf):
    seeds = v.table(spark, sf, "pages").where("page_id = 0")
    return lk.crawl_frontier(v.tree_links(spark, sf), seeds, 6, ["spam-farm"])


PAGES_OF_A_ROOT = 12


@query("crawl_many_roots",
    f"with recursive links as ({v.TREE_LINKS_SQL}), hosts as (select regexp_extract(url, '^[a-z]+://[^/]+') as root, arg_min(url, page_id) as url from pages group by 1),"
    " walk as (select root, url, 0 as depth from hosts where not contains(lower(url), 'spam-farm') union select root, dst_url, depth + 1 from walk join links on src_url = url"
    " where depth < 5 and not contains(lower(dst_url), 'spam-farm')),"
    " first as (select root, url, min(depth) as depth from walk group by root, url)"
    f" select root, url, depth from first qualify row_number() over (partition by root order by depth, url) <= {PAGES_OF_A_ROOT}")
def crawl_many_roots(spark, sf):
    """From the first page of every host at once, each with a quota of pages."""
    pages = v.table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("root"))
    roots = pages.groupBy("root").agg(F.min_by("url", "page_id").alias("url"))
    return lk.crawl_roots(v.tree_links(spark, sf), roots, 5, ["spam-farm"], PAGES_OF_A_ROOT)


@query("linked_pages", f"select page_id from pages where url in (select dst_url from ({v.TREE_LINKS_SQL}) where contains(src_url, '/en/'))")
def linked_pages(spark, sf):
    links = v.tree_links(spark, sf).where("src_url like '%/en/%'").select(ux.normalize_url(F.col("dst_url")).alias("dst_url"))
    return lk.stored_targets(links, v.table(spark, sf, "pages")).select("page_id")


# --- records -----------------------------------------------------------------


def records(spark, sf):
    """Events as JSON records."""
    body = F.concat(F.lit('{"id": '), "event_id", F.lit(', "title": "'), "event_type", F.lit(' of '), "user_id", F.lit('", "link": "http://click/'),
                    "user_id", F.lit('", "props": '), "props", F.lit("}"))
    return v.table(spark, sf, "events").select(F.col("event_id").alias("position"), body.alias("record"))


RECORDS_SQL = "select event_id, concat('id: ', event_id, ' title: ', event_type, ' of ', user_id, ' k: ', json_extract_string(props, '$.k')) as t, user_id, event_type from events"


@query("record_search", f"select -greatest(event_id, 1) as file_id, concat(event_type, ' of ', user_id) as file_name, concat('http://click/', user_id) as record_link,"
    f" regexp_replace(t, '(title|14)', '<mark>\\1</mark>', 'g') as snippet from ({RECORDS_SQL}) where contains(t, '14') and contains(t, 'title') and not contains(t, 'click')")
def record_search(spark, sf):
    return rc.search_records(records(spark, sf), "14 -click title").select("file_id", "file_name", "record_link", "snippet")


@query("flat_records", "select event_id, concat('kind: ', event_type, ' who: ', user_id) as t from events")
def flat_records(spark, sf):
    body = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "URL": "x", "who": '), "user_id", F.lit("}"))
    return v.table(spark, sf, "events").select("event_id", rc.record_text(body).alias("t"))


@query("json_records", "select user_id, count(*) as records, min(event_id) as first_id, max(event_id) as last_id from events group by user_id")
def json_records(spark, sf):
    """Events of a user packed as one document, a list or a list under a key, and unpacked again."""
    packed = v.table(spark, sf, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(F.concat(F.lit('{"e": '), "event_id", F.lit("}")))), F.lit("]")).alias("l"))
    k = F.col("user_id") % 4
    doc = F.when(k == 0, F.col("l")).when(k == 1, F.concat(F.lit('{"tasks": '), "l", F.lit("}"))).when(k == 2, F.concat(F.lit('{"tasks": 1, "data": '), "l", F.lit("}"))).otherwise(F.concat(F.lit('{"items": '), "l", F.lit("}")))
    rows = from_json_records(packed.select("user_id", doc.alias("payload")))
    event = F.get_json_object("record", "$.e").cast("bigint")
    return rows.groupBy("user_id").agg(F.count("*").alias("records"), F.min(event).alias("first_id"), F.max(event).alias("last_id"))


@query("access_metrics", "select concat('/vault/n', user_id, '.md') as normalized_path, count(*) as access_count, case when user_id % 2 = 0 then count(*) filter (event_type = 'click') end as backlinks from events group by user_id")
def access_metrics(spark, sf):
    """One metrics document per user: structures for even ones, plain counts for odd ones."""
    stats = v.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("c"))
    name = F.concat(F.lit('"n'), "user_id", F.lit('.md": '))
    rich = F.concat(F.lit('{"fileMetrics": {'), name, F.lit('{"accessCount": '), "n", F.lit(', "backlinkCount": '), "c", F.lit("}}}"))
    plain = F.concat(F.lit('{"accessCounts": {'), name, "n", F.lit("}}"))
    read = read_access_metrics(stats.select(F.when(F.col("user_id") % 2 == 0, rich).otherwise(plain).alias("payload")), "/vault")
    return read.select("normalized_path", F.col("accessCount").cast("bigint").alias("access_count"), F.col("backlinkCount").cast("bigint").alias("backlinks"))


@query("union_records", v.with_views(
    f"select 'local' as source_type, file_id from ranked union all select 'record', -greatest(event_id, 1) from ({RECORDS_SQL}) where contains(t, 'error')",
    **v.search_views([["error"]], q="error")))
def union_records(spark, sf):
    found = search(v.corpus(spark, sf), request("error")).matches.where("result_kind = 'file'")
    return rc.union_records(found, rc.search_records(records(spark, sf), "error")).select("source_type", "file_id")


BOTH_SQL = f"""select file_id, clicks from ranked union all
  select -greatest(event_id, 1), 0 from ({RECORDS_SQL}) where contains(t, 'error')"""


def documents_and_records(spark, sf):
    from lodestone.plans.search import search_with_records

    asked = request("error", sort_by="click_count", limit=30, offset=10)
    return search_with_records(v.corpus(spark, sf), asked, rc.search_records(records(spark, sf), "error"))


@query("merged_records_page", v.with_views(
    f"select row_number() over (order by clicks desc, file_id desc) as position, file_id from ({BOTH_SQL}) qualify position between 11 and 40",
    **v.search_views([["error"]], q="error")))
def merged_records_page(spark, sf):
    """Documents and records in one order, and a page of it."""
    return documents_and_records(spark, sf).page().select("position", "file_id")


@query("merged_records_total", v.with_views(
    f"select count(*) as total, 30 as returned, true as has_more, 40 as next_offset from ({BOTH_SQL})", **v.search_views([["error"]], q="error")))
def merged_records_total(spark, sf):
    return documents_and_records(spark, sf).info()


@query("union_records_capped", v.with_views(
    "select source_type, count(*) as n from (select 'local' as source_type from (select * from ranked limit 1000)"
    f" union all select 'record' from (select * from ({RECORDS_SQL}) where contains(t, 'error') limit 1000)) group by 1",
    **v.search_views([["the"]], q="the", names=False)))
def union_records_capped(spark, sf):
    """The interactive merge: the first 1,000 of each side."""
    found = search(v.corpus(spark, sf), request("the", target="body"))
    both = rc.union_records(found.matches, rc.search_records(records(spark, sf), "error"), found.keys, cap=1000)
    return both.groupBy("source_type").agg(F.count("*").alias("n"))


# --- paths -------------------------------------------------------------------


@query("path_functions", v.with_views(
    "select file_id, normalized_path as path, folder_path as folder, regexp_extract(folder_path, '[^/]*$') as folder_name,"
    " substr(file_name, 1, length(file_name) - length(file_ext)) as stem, 2 as depth from files"))
def path_functions(spark, sf):
    files = v.corpus(spark, sf).files
    messy = F.concat(F.regexp_replace("normalized_path", "(?<=.)/", "//"), F.lit("/../x/.././"), "file_name", F.lit("/"))
    folder = px.parent_folder(F.col("normalized_path"), F.col("file_name"))
    return files.select("file_id", px.normalize_path(messy).alias("path"), folder.alias("folder"), px.folder_name(folder).alias("folder_name"),
                        px.name_stem(F.col("file_name"), F.col("file_ext")).alias("stem"), px.relative_depth(F.lit("/CORPUS/"), folder).alias("depth"))


@query("result_rows", v.with_views(
    "select file_id, normalized_path as full_path, clicks as click_count, filename_match_level >= 2 as filename_match_priority, strftime(make_timestamp((mtime * 1000000)::bigint), '%Y-%m-%d %H:%M:%S') as mtime from ranked",
    **v.search_views([["la"]], q="la", names=True)))
def result_rows(spark, sf):
    found = search(v.corpus(spark, sf), request("la")).matches.where("result_kind = 'file'")
    return to_results(found).select("file_id", "full_path", "click_count", "filename_match_priority", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"))


# --- generated corpus --------------------------------------------------------

SHAPE = gn.Shape(total_files=30_000, folders=300, target_folder=42, target_every=50, global_every=20)
HIT = "(event_id // 100 = 42 and event_id % 100 % 50 = 0) or event_id % 20 = 0"


def numbers(spark, sf):
    return v.table(spark, sf, "events").select(F.col("event_id").alias("id"))


@query("generated_corpus",
    f"select event_id + 1 as file_id, printf('/benchmark/folder_%06d/sub_%03d/file_%05d.md', event_id // 100, event_id % 100 // 1000, event_id % 100) as normalized_path,"
    f" concat('alpha ', case when {HIT} then 'needle ' else '' end, 'benchmark document ', event_id + 1) as content from events")
def generated_corpus(spark, sf):
    return gn.generate_corpus(spark, SHAPE, numbers(spark, sf)).select("file_id", "normalized_path", "content")


@query("expected_hits", f"select count(*) filter (({HIT}) and event_id // 100 = 42) as target_hits, count(*) filter ({HIT}) as global_hits from events")
def expected_hits(spark, sf):
    return gn.expected_hits(numbers(spark, sf), SHAPE)


@query("generated_hits", f"select count(*) as total, count(*) filter (event_id // 100 = 42) as in_target from events where {HIT}")
def generated_hits(spark, sf):
    """The same numbers found by searching the generated corpus."""
    corpus = Corpus.of(gn.generate_corpus(spark, SHAPE, numbers(spark, sf)))
    found = mt.match_files(corpus, corpus.files, SearchRequest("needle", target="body"))
    inside = F.col("normalized_path").startswith(SHAPE.target_root + "/")
    return found.agg(F.count("*").alias("total"), F.count_if(inside).alias("in_target"))
