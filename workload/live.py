"""Listings of folders and streams of them, readers in SQL, rule tables, statistics of a refresh."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import exclusions as ec
from lodestone.operators import extract as ex
from lodestone.plans.refresh import refresh
from lodestone.session import scratch_path
from lodestone.sources import documents as ds
from lodestone.streaming import refresh as rf
from workload import views as v
from workload.registry import query


def written(rows, root: str) -> None:
    """Each row's content under its path below ``root``; tasks write what they hold."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


_NAME = "case doc_id % 3 when 0 then '_n' when 1 then '.n' else 'n' end"


@query("listed_files",
    f"select concat('/', source, case when doc_id % 4 = 0 then '/.hidden/' else '/' end, {_NAME}, cast(doc_id as varchar), case when doc_id % 2 = 0 then '.md' else '.txt' end) as path,"
    " case when doc_id % 5 = 0 then 0 else cast(strlen(coalesce(text, '')) as bigint) end as size from documents")
def listed_files(spark, sf):
    """The documents as files of all names, empty ones too, written and listed again."""
    n = F.col("doc_id")
    folder = F.concat("source", F.when(n % 4 == 0, "/.hidden/").otherwise("/"))
    name = F.concat(F.when(n % 3 == 0, "_n").when(n % 3 == 1, ".n").otherwise("n"), n.cast("string"), F.when(n % 2 == 0, ".md").otherwise(".txt"))
    rows = v.table(spark, sf, "documents").select(F.concat(folder, name).alias("path"), F.when(n % 5 != 0, F.col("text")).alias("content"))
    root = scratch_path(spark, "tree")
    written(rows, root)
    found = ds.list_files(spark, root, with_bytes=False)
    below = F.regexp_replace("normalized_path", F.lit(r"^.*/tree-[0-9a-f]+"), F.lit(""))
    return found.select(below.alias("path"), "size")


#: Three listings ten minutes apart; a path is gone after a quarter of an hour without a sight of it.
TIMES = ("2024-01-01 00:00:00", "2024-01-01 00:10:00", "2024-01-01 00:20:00")


@query("refresh_stream", v.with_views(
    "select coalesce(f.normalized_path, l.normalized_path) as normalized_path, case when f.normalized_path is null then 'new'"
    " when l.normalized_path is null then 'gone' when f.mtime = l.mtime and f.size = l.size then 'unchanged' else 'changed' end as change"
    " from files f full join listing l on l.normalized_path = f.normalized_path", listing=v.LISTING_SQL))
def refresh_stream(spark, sf):
    """The documents, then their later state twice, as a stream of listings: what the second one tells, and what is gone by the third."""
    states = [v.documents(spark, sf), v.listing(spark, sf), v.listing(spark, sf)]
    root = scratch_path(spark, "listings")
    layout = "normalized_path string, mtime double, size bigint, listed_at timestamp"
    for k, (state, at) in enumerate(zip(states, TIMES, strict=True)):
        rows = state.select("normalized_path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("bigint").alias("size"), F.lit(at).cast("timestamp").alias("listed_at"))
        rows.coalesce(1).write.parquet(f"{root}/in/{k}")
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    changes = rf.path_changes(stream, "15 minutes").writeStream.format("parquet").option("path", f"{root}/out")
    changes.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(rf.CHANGES).parquet(f"{root}/out")
    return told.where((F.col("listed_at") == F.lit(TIMES[1]).cast("timestamp")) | (F.col("change") == "gone")).select("normalized_path", "change")


# --- readers in SQL, rule tables ---------------------------------------------


def _lines(data: bytes):
    """A reader of its own: every line is a piece; it gives up at a word it doesn't like."""
    for line in data.decode().split("\n"):
        if "licen" in line.lower():
            raise ValueError("unreadable line")
        yield line


@query("custom_extractor",
    "select doc_id, cast(i - 1 as int) as piece, case when bad is null or i < bad then line end as text, case when i = bad then 'unreadable line' end as error from ("
    " select doc_id, line, i, min(case when contains(lower(line), 'licen') then i end) over (partition by doc_id) as bad from ("
    "  select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)))"
    " where bad is null or i <= bad")
def custom_extractor(spark, sf):
    """A reader of a user's own, called from SQL text: one row per piece, errors in their row."""
    ex.piece_function(spark, "lines_of", {".rec": _lines})
    v.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes")).createOrReplaceTempView("recorded")
    return spark.sql("select r.doc_id, p.piece, p.text, p.error from recorded r, lateral lines_of(concat('f', r.doc_id, '.rec'), r.bytes) p")


@query("observed_statistics", v.with_views(
    "select count(*) filter (change <> 'missing') as files, count(*) filter (change in ('new', 'changed')) - count(*) filter (bad) as writes,"
    " count(*) filter (change = 'unchanged') as skipped, count(*) filter (change = 'missing') as removed, count(*) filter (bad) as errors from ("
    " select case when f.normalized_path is null then 'new' when l.normalized_path is null then 'missing'"
    " when f.mtime = l.mtime and f.size = l.size and f.last_error is null then 'unchanged' else 'changed' end as change,"
    " coalesce(ends_with(l.normalized_path, '.json') and (f.normalized_path is null or f.mtime <> l.mtime or f.size <> l.size or f.last_error is not null), false) as bad"
    " from files f full join listing l on l.normalized_path = f.normalized_path)", listing=v.LISTING_SQL))
def observed_statistics(spark, sf):
    """A refresh from bytes counts itself while it writes its diff and reads its files; a third of the files has no reader."""
    unread = F.when(F.col("file_ext") == ".json", F.concat("file_name", F.lit(".pdf"))).otherwise(F.col("file_name"))
    listing = v.listing(spark, sf).withColumns({"bytes": F.encode("content", "UTF-8"), "file_name": unread})
    return refresh(v.corpus(spark, sf), listing.drop("content"), "/corpus", v.AS_OF).statistics


@query("many_rules", v.with_views(
    "select file_id, normalized_path from files f where not exists (select 1 from names where name in (select unnest(regexp_extract_all(lower(f.normalized_path), '[a-z0-9]+') || string_split(lower(f.normalized_path), '/'))))"
    " and not exists (select 1 from paths where starts_with(f.normalized_path, path || '/') or f.normalized_path = path)",
    names="select 'order' || o_orderkey as name from orders union select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) from benchmark",
    paths="select normalized_path as path from files where file_id % 9 = 4 union select '/corpus/' || source || '/fr' from documents where doc_id % 40 = 7"))
def many_rules(spark, sf):
    """Names of all orders, all words of the benchmark and thousands of paths as one rule table."""
    orders = v.table(spark, sf, "orders").select(F.concat(F.lit("order"), "o_orderkey").alias("rule"))
    words = v.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("rule"))
    files = v.documents(spark, sf)
    paths = files.where("file_id % 9 = 4").select(F.col("normalized_path").alias("rule"))
    folders = v.table(spark, sf, "documents").where("doc_id % 40 = 7").select(F.concat(F.lit("/corpus/"), "source", F.lit("/fr")).alias("rule"))
    rules = orders.unionByName(words).unionByName(paths).unionByName(folders)
    return ec.matched(files, rules, F.col("normalized_path")).where("not excluded").select("file_id", "normalized_path")
