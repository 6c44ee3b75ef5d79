"""The tables of a corpus, and how they are stored.

A stored corpus is one Parquet table for each of its tables, in folders by ``version``. The first version holds all rows; a
refresh adds a version with the rows that changed and the ids whose older rows they replace. Readers take each
row that no later version replaces. A version counts once it stands in the table ``versions``, which is written last: a
job that fails leaves nothing that is read, and the next one overwrites what it left. One job writes at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schemas as sch
from lodestone.operators import grams as gr
from lodestone.operators import index as ix
from lodestone.session import cut_lineage


@dataclass(frozen=True)
class Corpus:
    files: DataFrame
    segments: DataFrame
    postings: DataFrame | None = None
    terms: DataFrame | None = None
    stats: DataFrame | None = None
    failures: DataFrame | None = None
    query_clicks: DataFrame | None = None
    targets: DataFrame | None = None
    grams: DataFrame | None = None
    gram_counts: DataFrame | None = None
    #: Whether the grams tell about bodies too, not of names and words only.
    body_grams: bool = False

    @staticmethod
    def of(docs: DataFrame, stage: bool = False, **tables: DataFrame) -> Corpus:
        """Corpus over document rows (file columns and ``content``).

        ``stage`` keeps the rows in the shared folder first; use it where they come
        from a costly extraction, which files and segments would both repeat.
        """
        docs = cut_lineage(docs) if stage else docs
        return Corpus(ix.build_files(docs), ix.build_segments(docs), **tables)

    def statistics(self) -> DataFrame:
        return self.stats if self.stats is not None else ix.corpus_stats(self.segments)

    def indexed(self) -> Corpus:
        """The same corpus with postings, term counts and statistics.

        Bodies and postings are kept as tables: many steps of a search read them.
        """
        segments = cut_lineage(self.segments)
        blocks = cut_lineage(ix.build_blocks(segments))
        return replace(
            self,
            segments=segments,
            postings=ix.postings_of(blocks),
            terms=ix.block_term_stats(blocks),
            stats=ix.corpus_stats(segments),
        )

    def rebuilt(self) -> Corpus:
        """Postings, counts and statistics made anew from the stored bodies."""
        return replace(self, postings=None, terms=None, stats=None).indexed()

    def with_grams(self, bodies: bool = True) -> Corpus:
        """The same corpus with grams of names, words and (``bodies``) texts, for patterns and substrings."""
        blocks = cut_lineage(gr.gram_blocks(self.files, self.segments if bodies else None, self.terms))
        return replace(self, grams=gr.grams_of(blocks), gram_counts=cut_lineage(gr.gram_counts(blocks)), body_grams=bodies)

    def with_(self, **tables) -> Corpus:
        return replace(self, **tables)


def _laid_out(df: DataFrame, name: str, parts: int) -> DataFrame:
    """Order a table on disk by what its readers filter on.

    Files are ranges: row-group statistics then prune, and one huge folder is spread over as many
    files as it needs. Bodies go to folders by a hash of their id, which a page of results can name.
    Blocks of postings and grams are dealt by a hash of the term and the block's first holder, and sorted by term in
    each file: page statistics prune, a very common term lies in all files, and no sampling pass makes the blocks twice.
    """
    if name in BLOCKS:
        keys, first = BLOCKS[name]
        return df.repartition(parts, *keys, F.expr(first)).sortWithinPartitions(*keys)
    if name == "segments":
        # Ids are spread evenly by their hash, so this needs no sampling pass.
        # Inside a folder they lie by id, so the ids of a page open few row groups.
        placed = df.withColumn("bucket", ix.id_bucket(F.col("file_id")))
        return placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "file_id")
    order = {
        "files": ["source_type", "normalized_path"],
        "terms": ["kind", "term"],
        "gram_counts": ["kind", "gram"],
    }.get(name)
    if order is None:
        return df
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


#: Tables that hold lists: what they are sorted by, and what tells blocks of a key apart. Terms go first, kinds are few.
BLOCKS = {"postings": (["term", "kind"], "xxhash64(get(file_ids, 0))"), "grams": (["kind", "gram"], "xxhash64(get(terms, 0), get(file_ids, 0))")}
#: How they are read as rows.
ROWS_OF = {"postings": ix.postings_of, "grams": gr.grams_of}
LAYOUTS = {
    "files": sch.FILES,
    "segments": sch.STORED_SEGMENTS,
    "postings": sch.POSTING_BLOCKS,
    "terms": sch.TERM_STATS,
    "totals": sch.TOTALS,
    "failures": sch.FAILURES,
    "query_clicks": sch.QUERY_CLICKS,
    "targets": sch.TARGETS,
    "grams": sch.GRAM_BLOCKS,
    "gram_counts": sch.GRAM_COUNTS,
    "replaced": sch.REPLACED,
    "versions": sch.VERSIONS,
}
#: Folders inside a version.
FOLDERS = {"files": "source_type", "segments": "bucket"}
#: Tables whose rows belong to a file, and the kind of replacement that takes them away.
REPLACED_BY = {"files": "file", "segments": "body", "postings": "body"}


def _write(df: DataFrame, name: str, path: str, version: int, parts: int | None = None) -> None:
    writer = (_laid_out(df, name, parts) if parts else df).write.mode("overwrite")
    if name in FOLDERS:
        writer = writer.partitionBy(FOLDERS[name])
    writer.parquet(f"{path}/{name}/version={version}")


def _stored(spark: SparkSession, path: str, name: str, versions: list[int]) -> DataFrame:
    """The stored rows of some versions of a table, with their version."""
    schema = T.StructType([*LAYOUTS[name].fields, T.StructField("version", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("version").isin(versions))


def _rows(spark: SparkSession, path: str, name: str, versions: list[int]) -> DataFrame:
    """The same, with a row for each member of a list of postings or grams."""
    stored = _stored(spark, path, name, versions)
    return ROWS_OF[name](stored, "version") if name in ROWS_OF else stored


def _versions(spark: SparkSession, path: str) -> list:
    """(version, whole, given) of the versions that count, in order: one row for each refresh since the corpus was written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.schema(sch.VERSIONS).parquet(f"{path}/versions/*").orderBy("number").collect()


def latest_version(spark: SparkSession, path: str) -> int | None:
    return max((v.number for v in _versions(spark, path)), default=None)


def _declare(spark: SparkSession, path: str, version: int, whole: bool, given: list[str]) -> None:
    row = spark.createDataFrame([(version, whole, sorted(given))], sch.VERSIONS)
    _write(row.coalesce(1), "versions", path, version)


def totals_of(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("double").alias("tokens"))


def write_corpus(corpus: Corpus, path: str, parts: int | None = None, body_grams: bool = False) -> int:
    """Store a corpus as a version that holds all rows, and return the version.

    Bodies are written first; postings, counts and statistics are then derived from
    what was written, so no input is read or parsed twice. Grams of names and words are always stored; those of
    bodies, which patterns are looked up by, on demand: they take about as much room as the postings.
    """
    spark = corpus.files.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    version = (latest_version(spark, path) or 0) + 1
    body_grams = body_grams or corpus.body_grams

    def write(df: DataFrame, name: str) -> DataFrame:
        _write(df, name, path, version, parts)
        return _stored(spark, path, name, [version]).drop("version")

    files, segments = write(corpus.files, "files"), write(corpus.segments, "segments")
    postings = write(ix.blocks_of(corpus.postings) if corpus.postings is not None else ix.build_blocks(segments), "postings")
    terms = write(ix.block_term_stats(postings), "terms")
    write(totals_of(segments), "totals")
    grams = write(gr.gram_blocks(files, segments if body_grams else None, terms), "grams")
    write(gr.gram_counts(grams), "gram_counts")
    given = ["grams", *(["body_grams"] if body_grams else [])]
    for name in ("failures", "query_clicks", "targets"):
        if getattr(corpus, name) is not None:
            write(getattr(corpus, name), name)
            given.append(name)
    _declare(spark, path, version, True, given)
    return version


@dataclass(frozen=True)
class Changed:
    """What a refresh changed. ``replaced`` holds (file_id, kind); ``terms`` and ``totals`` are signed changes."""

    files: DataFrame
    segments: DataFrame
    postings: DataFrame
    replaced: DataFrame
    terms: DataFrame
    totals: DataFrame
    failures: DataFrame | None = None


def write_changes(changed: Changed, path: str) -> int:
    """Add what changed as the next version, and return it."""
    spark = changed.files.sparkSession
    version = latest_version(spark, path) + 1
    given = [f.name for f in fields(changed) if getattr(changed, f.name) is not None]
    for name in given:
        rows = getattr(changed, name)
        _write(ix.single_blocks(rows) if name == "postings" else rows, name, path, version)
    _declare(spark, path, version, False, given)
    return version


def compact(spark: SparkSession, path: str, parts: int | None = None) -> int:
    """Write the merged rows as a version of their own; readers start there. Older folders stay for readers that use them."""
    return write_corpus(read_corpus(spark, path), path, parts)


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    """The newest whole version and what changed since."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no corpus at {path}")
    first = max(v.number for v in versions if v.whole)
    since = [v for v in versions if v.number >= first]
    base, later = since[0], since[1:]
    numbers = [v.number for v in since]

    def rows(name: str, at: list[int] = numbers) -> DataFrame:
        return _rows(spark, path, name, at)

    def newest(name: str) -> DataFrame | None:
        at = [v.number for v in since if name in v.given]
        return rows(name, at[-1:]).drop("version") if at else None

    sums = rows("totals").agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
    tables = {
        "stats": sums.select("n_docs", F.try_divide("tokens", "n_docs").alias("avg_tokens")),
        **{name: newest(name) for name in ("failures", "query_clicks", "targets")},
    }
    if not later:
        tables |= {name: rows(name).drop("version") for name in (*REPLACED_BY, "terms")}
        if "grams" in base.given:
            tables |= {name: rows(name).drop("version") for name in ("grams", "gram_counts")}
        return Corpus(**tables, body_grams="body_grams" in base.given)

    changes = [v.number for v in later]
    gone = rows("replaced", changes).groupBy("file_id", "kind").agg(F.max("version").alias("gone"))
    for name, kind in REPLACED_BY.items():
        of_kind = gone.where(F.col("kind") == kind).select("file_id", "gone")
        alive = rows(name).join(of_kind, "file_id", "left").where("gone is null or version >= gone")
        layout = sch.POSTINGS if name == "postings" else LAYOUTS[name]
        tables[name] = alive.drop("gone", "version").select(*layout.fieldNames())
    tables["terms"] = rows("terms").groupBy("kind", "term").agg(F.sum("df").alias("df")).where("df > 0")
    if "grams" in base.given:
        # What changed is cut on reading; the counts of the whole version go on choosing which gram to ask for.
        changed = cut_lineage(gone.select("file_id").unionByName(rows("files", changes).select("file_id")).unionByName(rows("segments", changes).select("file_id")).distinct())
        some = lambda df: df.join(changed, "file_id", "left_semi")
        bodies = some(tables["segments"]) if "body_grams" in base.given else None
        new = gr.build_grams(some(tables["files"]), bodies, rows("terms", changes).where("df > 0"))
        old = rows("grams", [first]).drop("version").join(changed, "file_id", "left_anti")
        tables |= {"grams": old.unionByName(new), "gram_counts": rows("gram_counts", [first]).drop("version")}
    return Corpus(**tables, body_grams="body_grams" in base.given)
