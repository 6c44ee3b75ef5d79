"""The given tables seen as a corpus, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, scratch_path, spread
from lodestone.sources.corpus import Corpus, read_corpus, write_corpus
from lodestone.sources.documents import from_documents

# Fixed clock of all time-dependent scores: 2024-02-01 00:00 UTC.
AS_OF = 1706745600.0
START = 1704067200
ALPHABET, KANA = "abcdefghijklmnopqrst", "あいうえおかきくけこさしすせそたちつてと"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def epoch(ts: str = "ts"):
    """Seconds of a zone-less timestamp read as UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") / 1e6


def extension():
    n = F.col("doc_id") % 4
    return F.when(n == 0, ".md").when(n == 1, ".txt").when(n == 2, ".excalidraw.md").otherwise(".json")


_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make):
    """``make()`` once per application: queries share what was derived from the tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows, derived once and then read from the shared folder."""
    return kept(spark, sf_dir, "documents", lambda: cut_lineage(derived_documents(spark, sf_dir)))


def derived_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows of the ``documents`` table, with clicks of events and pins of labels."""
    docs = table(spark, sf_dir, "documents")
    clicks = (
        table(spark, sf_dir, "events")
        .where("event_type = 'click'")
        .groupBy(F.col("user_id").alias("doc_id"))
        .agg(F.count("*").alias("clicks"))
    )
    pins = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(clicks, "doc_id", "left").join(pins, "doc_id", "left")
    n = F.col("doc_id")
    word = F.regexp_extract(F.lower("text"), "[a-z]+", 0)
    name = F.concat(word, F.lit("-"), n.cast("string"), extension())
    return from_documents(
        rows,
        {
            "file_id": n,
            "source_type": F.lit("local"),
            "normalized_path": F.concat_ws("/", F.lit("/corpus"), "source", "lang", name),
            "file_name": name,
            "file_ext": extension(),
            "created_at": F.lit(START) + n * 600,
            "mtime": F.lit(START) + n * 600 + (n % 97) * 3600,
            "click_count": F.coalesce("clicks", F.lit(0)),
            "imported_click_count": n % 4,
            "importance": (n % 1000).cast("double"),
            "has_top_tag": (F.coalesce("quality", F.lit(0)) == 1) & (n % 10 == 0),
            "title": F.when(n % 3 == 0, F.concat(F.upper("lang"), F.lit(" "), word)).otherwise(""),
            "aliases": F.when(n % 7 == 0, F.array(F.concat(F.lit("alias "), "source"), F.col("lang"))),
            "size": F.col("n_chars"),
            "indexed_at": F.lit(AS_OF) - (n % 50) * 60,
            "last_error": F.when(n % 111 == 5, F.lit("broken")),
            "content": F.col("text"),
        },
    )


FILES_SQL = f"""
select d.doc_id as file_id, 'local' as source_type,
  concat('/corpus/', d.source, '/', d.lang, '/', d.file_name) as normalized_path,
  d.file_name, d.file_ext,
  cast({START} + d.doc_id * 600 as double) as created_at,
  cast({START} + d.doc_id * 600 + (d.doc_id % 97) * 3600 as double) as mtime,
  coalesce(e.clicks, 0) as click_count, d.doc_id % 4 as imported_click_count,
  cast(d.doc_id % 1000 as double) as importance,
  (coalesce(l.quality, 0) = 1 and d.doc_id % 10 = 0) as has_top_tag,
  case when d.doc_id % 3 = 0 then concat(upper(d.lang), ' ', d.word) else '' end as title,
  case when d.doc_id % 7 = 0 then concat('alias ', d.source, chr(10), d.lang) else '' end as aliases,
  d.n_chars as size, {AS_OF} - (d.doc_id % 50) * 60 as indexed_at,
  case when d.doc_id % 111 = 5 then 'broken' end as last_error, d.text as content,
  concat('/corpus/', d.source, '/', d.lang) as folder_path
from (
  select *, concat(word, '-', cast(doc_id as varchar), file_ext) as file_name from (
    select *, regexp_extract(lower(text), '[a-z]+') as word,
      case doc_id % 4 when 0 then '.md' when 1 then '.txt' when 2 then '.excalidraw.md' else '.json' end as file_ext
    from documents)
) d
left join (select user_id, count(*) as clicks from events where event_type = 'click' group by user_id) e
  on e.user_id = d.doc_id
left join labels l on l.doc_id = d.doc_id
"""
WORDS = r"'[\p{L}\p{N}]+'"


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.of(documents(spark, sf_dir), query_clicks=query_clicks(spark, sf_dir))


def stored_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus written to the shared folder with its index, and read back."""

    def make() -> Corpus:
        path = scratch_path(spark, "corpus")
        write_corpus(corpus(spark, sf_dir), path, body_grams=True)
        return read_corpus(spark, path)

    return kept(spark, sf_dir, "corpus", make)


def kana_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The same documents with Latin letters turned into kana: runs of CJK text."""
    docs = documents(spark, sf_dir)
    return Corpus.of(docs.withColumn("content", F.translate(F.lower("content"), ALPHABET, KANA)))


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click rows (event_id, file_id, normalized_query, clicked_at)."""
    third = F.col("event_id") % 3
    query = F.when(third == 0, "the").when(third == 1, "the and").otherwise("with")
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'click'")
        .select("event_id", F.col("user_id").alias("file_id"), query.alias("normalized_query"), epoch().alias("clicked_at"))
    )


def query_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        click_events(spark, sf_dir)
        .groupBy("normalized_query", "file_id")
        .agg(F.count("*").alias("click_count"), F.max("clicked_at").alias("last_clicked_at"))
    )


CLICK_EVENTS_SQL = """
select event_id, user_id as file_id,
  case event_id % 3 when 0 then 'the' when 1 then 'the and' else 'with' end as normalized_query,
  epoch_us(ts) / 1e6 as clicked_at
from events where event_type = 'click'
"""
QUERY_CLICKS_SQL = f"""
select normalized_query, file_id, count(*) as click_count, max(clicked_at) as last_clicked_at
from ({CLICK_EVENTS_SQL}) group by all
"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots derived from the documents: every source folder, and some language folders."""
    docs = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    settings = [
        F.lit("local").alias("source_type"),
        (F.col("k") % 3 != 0).alias("is_enabled"),
        F.when(F.col("k") % 4 == 0, F.array(F.lit("old"), F.lit("/corpus/tmp"))).otherwise(F.array(F.lit("old"))).alias("exclude_rules"),
        F.when(F.col("k") % 5 == 0, 3).otherwise(5).alias("index_depth"),
        F.array(F.lit(".json"), F.lit(".md")).alias("selected_extensions"),
        F.when(F.col("k") % 6 != 1, F.lit(AS_OF) - F.col("k") * 600.0).alias("last_indexed_at"),
        F.col("n").alias("indexed_file_count"),
        F.when(F.col("k") % 7 == 0, 0).otherwise(1).alias("index_version"),
    ]
    by_source = docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("k", number)
    by_lang = (
        docs.where("lang in ('en', 'fr')")
        .groupBy("source", "lang")
        .agg(F.count("*").alias("n"))
        .withColumn("k", number + 1)
    )
    roots = by_source.select(F.concat(F.lit("/corpus/"), "source").alias("full_path"), *settings)
    return roots.unionByName(
        by_lang.select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang").alias("full_path"), *settings)
    )


TARGETS_SQL = f"""
select full_path, 'local' as source_type, k % 3 <> 0 as is_enabled,
  case when k % 4 = 0 then 'old,/corpus/tmp' else 'old' end as exclude_rules,
  case when k % 5 = 0 then 3 else 5 end as index_depth,
  case when k % 6 <> 1 then {AS_OF} - k * 600.0 end as last_indexed_at,
  n as indexed_file_count, case when k % 7 = 0 then 0 else 1 end as index_version
from (
  select concat('/corpus/', source) as full_path, count(*) as n,
    cast(regexp_extract(source, '[0-9]+') as int) as k from documents group by source
  union all
  select concat('/corpus/', source, '/', lang), count(*), cast(regexp_extract(source, '[0-9]+') as int) + 1
  from documents where lang in ('en', 'fr') group by source, lang
)
"""


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as extraction failures, many per path."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    name = F.concat(F.lit("f"), F.col("user_id"), F.lit(".md"))
    return rows.select(
        F.concat(F.lit("/corpus/src"), F.col("user_id") % 20, F.lit("/en/"), name).alias("normalized_path"),
        name.alias("file_name"),
        F.concat(F.lit("error "), F.col("event_id")).alias("error_message"),
        epoch().alias("last_failed_at"),
    )


FAILURES_SQL = """
select concat('/corpus/src', user_id % 20, '/en/f', user_id, '.md') as normalized_path,
  concat('f', user_id, '.md') as file_name, concat('error ', event_id) as error_message,
  epoch_us(ts) / 1e6 as last_failed_at
from events where event_type = 'error'
"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later state of the documents: some gone, some touched, some grown, some new."""
    docs = documents(spark, sf_dir)
    n = F.col("file_id")
    columns = ("normalized_path", "file_name", "file_ext", "created_at", "mtime", "size", "content")
    later = docs.where(n % 20 != 0).select(
        "normalized_path",
        "file_name",
        "file_ext",
        "created_at",
        F.when(n % 20 == 1, F.col("mtime") + 60).otherwise(F.col("mtime")).alias("mtime"),
        F.when(n % 20 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(n % 20 == 2, F.concat("content", F.lit(" grownword"))).otherwise(F.col("content")).alias("content"),
    )
    fresh = docs.where(n % 20 == 3).select(
        F.concat(F.lit("/corpus/new/"), "file_name").alias("normalized_path"), *columns[1:]
    )
    return later.unionByName(fresh)


LISTING_SQL = """
select normalized_path, file_name, file_ext, created_at,
  case when file_id % 20 = 1 then mtime + 60 else mtime end as mtime,
  case when file_id % 20 = 2 then size + 1 else size end as size,
  case when file_id % 20 = 2 then concat(content, ' grownword') else content end as content
from files where file_id % 20 <> 0
union all
select concat('/corpus/new/', file_name), file_name, file_ext, created_at, mtime, size, content
from files where file_id % 20 = 3
"""


def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between stored pages: page i leads to pages 2i+1 and 2i+2."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    child = pages.select(F.floor((F.col("page_id") - 1) / 2).alias("parent"), F.col("url").alias("dst_url")).where("page_id > 0")
    return child.join(pages, F.col("parent") == F.col("page_id")).select(F.col("url").alias("src_url"), "dst_url")


TREE_LINKS_SQL = """
select p.url as src_url, c.url as dst_url from pages c join pages p
  on p.page_id = (c.page_id - 1) // 2 where c.page_id > 0
"""


def with_views(body: str, **extra: str) -> str:
    """SQL text over the derived views."""
    views = {"files": FILES_SQL, **extra}
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in views.items()) + "\n" + body


TOKENS_SQL = f"""
select file_id, lower(content) as lc, content, regexp_extract_all(lower(content), {WORDS}) as tk,
  len(regexp_extract_all(lower(content), {WORDS})) as n
from files where regexp_matches(content, '\\S')
"""


def bm25_sql(tf: str, n: str, df: str) -> str:
    return (
        f"(-greatest(ln((n_docs - {df} + 0.5) / ({df} + 0.5)), 1e-6) * ({tf} * 2.2)"
        f" / ({tf} + 1.2 * (0.25 + 0.75 * {n} / avg_len)))"
    )


def search_views(groups: list[list[str]], scope: str = "true", body: bool = True, names: bool = True, q: str = "") -> dict[str, str]:
    """Views scoped, hits, best (one row per matching file) of an AND search."""
    views = {
        "toks": TOKENS_SQL,
        "stats": "select count(*) as n_docs, avg(n) as avg_len from toks",
        "scoped": f"select * from files where {scope}",
    }
    branches = []
    for i, group in enumerate(groups):
        for j, term in enumerate(group):
            low = term.lower().replace("'", "''")
            literal = term.startswith("-") or (any(c.isdigit() for c in term) and any(c.isascii() and c.isalpha() for c in term))
            words = "".join(c if c.isalnum() else " " for c in term.lower()).split()
            if body and literal:
                branches.append(f"select file_id, {i} as term_index, 0 as match_rank, 0.0::double as score from toks where contains(lc, '{low}')")
            elif body and words:
                if len(words) == 1:
                    count = f"len(list_filter(tk, lambda x: x = '{words[0]}'))"
                else:
                    wanted = "[" + ", ".join(f"'{w}'" for w in words) + "]"
                    count = f"len(list_filter(range(1, n + 1), lambda i: tk[i:i + {len(words) - 1}] = {wanted}))"
                views[f"u_{i}_{j}"] = f"select file_id, n, {count} as tf from toks where contains(lc, '{words[0]}')"
                views[f"d_{i}_{j}"] = f"select count(*) as df from u_{i}_{j} where tf > 0"
                branches.append(
                    f"select file_id, {i} as term_index, 0 as match_rank, {bm25_sql('tf', 'n', 'df')} as score from u_{i}_{j}, d_{i}_{j}, stats where tf > 0"
                )
            if names:
                for rank, column in ((2, "file_name"), (3, "title"), (4, "aliases")):
                    branches.append(f"select file_id, {i} as term_index, {rank} as match_rank, 1000000.0::double as score from files where contains(lower({column}), '{low}')")
    n = len(groups)
    low_q = q.lower().replace("'", "''")
    views["hits"] = "\nunion all\n".join(branches)
    # one row for each file and term, with the fields that hold the term
    views["fields"] = """
      select file_id, term_index, bool_or(match_rank = 2) as in_name, bool_or(match_rank = 3) as in_title,
        bool_or(match_rank = 4) as in_alias from hits group by file_id, term_index"""
    views["terms_in"] = """
      select file_id, count(*) as terms, count_if(in_name) as names, count_if(in_title) as titles, count_if(in_alias) as others
      from fields group by file_id"""
    stem = "lower(left(f.file_name, length(f.file_name) - length(f.file_ext)))"
    views["qualified"] = f"""
      select f.file_id, greatest(
        if(names = {n}, 6 + contains(lower(f.file_name), '{low_q}')::int + ({stem} = '{low_q}')::int, 0),
        if(titles = {n}, 4 + (lower(f.title) = '{low_q}')::int, 0),
        if(others = {n}, 3, 0), if(names > 0, 2, 0), if(titles + others > 0, 1, 0)) as filename_match_level
      from terms_in t join scoped f on f.file_id = t.file_id where terms = {n}"""
    views["best"] = """
      select file_id, top.match_rank as match_rank, top.score as score, filename_match_level,
        11 - cast(floor(10.0 * count(*) over (order by top.match_rank, top.score) / count(*) over () + 0.999999) as int) as relevance_bucket
      from (select q.file_id, any_value(filename_match_level) as filename_match_level,
              min({'match_rank': h.match_rank, 'score': h.score}) as top
            from hits h join qualified q on q.file_id = h.file_id group by q.file_id)"""
    views["affinity"] = f"""
      select file_id, (click_count / (click_count + 2.0)) / (1.0 + greatest({AS_OF} - last_clicked_at, 0.0) / (30 * 86400.0)) as query_click_score
      from ({QUERY_CLICKS_SQL}) where normalized_query = '{low_q}'"""
    views["ranked"] = f"""
      select b.*, f.* exclude (file_id, click_count), f.click_count + f.imported_click_count as clicks,
        0.55 * ((f.click_count + f.imported_click_count) / (f.click_count + f.imported_click_count + 10.0))
        + 0.25 * least(greatest(f.importance / 1000.0, 0.0), 1.0)
        + 0.20 / (1.0 + greatest({AS_OF} - f.mtime, 0.0) / 7776000.0) as utility_score,
        coalesce(a.query_click_score, 0.0) as query_click_score
      from best b join files f on f.file_id = b.file_id left join affinity a on a.file_id = b.file_id"""
    return views


DEFAULT_ORDER = (
    "filename_match_level desc, has_top_tag desc, query_click_score desc, relevance_bucket desc,"
    " utility_score desc, mtime desc, file_id desc"
)


def kana_sql() -> str:
    return f"select file_id, translate(lower(content), '{ALPHABET}', '{KANA}') as content from files"


