"""Refresh of one or more roots: diff, extract what changed, and bring the corpus in line or add a version."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone import schemas as sch
from lodestone.operators import index as ix
from lodestone.operators import maintain as mn
from lodestone.operators import reports as rp
from lodestone.operators import scope as so
from lodestone.operators.extract import extract_text
from lodestone.session import cut_lineage
from lodestone.sources.corpus import Changed, Corpus, read_corpus, write_changes
from lodestone.sources.documents import split_failures


@dataclass(frozen=True)
class Refresh:
    corpus: Corpus
    diff: DataFrame
    statistics: DataFrame


def refresh(
    corpus: Corpus,
    listing: DataFrame,
    root: str,
    as_of: float,
    depth: int | None = None,
    extensions: Iterable[str] | None = None,
    rules: Iterable[str] = (),
    delete_missing: bool = True,
) -> Refresh:
    """Bring the corpus in line with a listing of ``root``.

    ``listing`` holds path, name, times and size and either ``bytes`` or ``content``.
    Only new and changed rows are extracted; bodies and postings of all others are kept
    as they are. Rows outside the scope of the refresh are never deleted, and none at all
    without ``delete_missing``: the listing is then only a part of what exists.
    """
    scope = {"root": root, "depth": depth, "extensions": extensions, "rules": list(rules)}
    return _refresh(corpus, listing, as_of, lambda rows: _of_scope(rows, scope), delete_missing)


def _of_scope(rows: DataFrame, scope: dict) -> DataFrame:
    ext = F.col("file_ext") if "file_ext" in rows.columns else None
    return rows.where(mn.responsible(F.col("normalized_path"), file_ext=ext, **scope))


@dataclass(frozen=True)
class Changes:
    """What a refresh found and read; every table is small beside the corpus."""

    diff: DataFrame
    updated: DataFrame  # file rows, new ones and changed ones under the id they had
    errors: DataFrame  # stored file rows that failed now
    gone: DataFrame
    dropped: DataFrame  # ids whose stored bodies go
    bodies: DataFrame
    failed: DataFrame
    failures: DataFrame
    statistics: DataFrame  # counted while the diff and the extraction were written


def _changes(
    corpus: Corpus, listing: DataFrame, as_of: float, mine: Callable[[DataFrame], DataFrame], delete_missing: bool
) -> Changes:
    """``mine`` keeps the rows (of files or failures) that the refresh is responsible for."""
    seen = listing.select("normalized_path")
    gone = mine(corpus.files).join(seen, "normalized_path", "left_anti").select("normalized_path")
    if not delete_missing:
        gone = gone.where(F.lit(False))
    # What is listed, and what is missing inside the scope; nothing else is compared.
    compared = corpus.files.join(seen.unionByName(gone), "normalized_path", "left_semi")
    # A whole listing is compared by folders first; a part of one names what may have changed itself.
    compare = mn.digest_diff if delete_missing else mn.diff_snapshot
    changes = Observation()
    diff = cut_lineage(compare(compared, listing).observe(changes, *rp.change_counts()))
    todo = diff.where(F.col("change").isin("new", "changed"))
    work = listing.join(todo.select("normalized_path"), "normalized_path", "left_semi")
    if "bytes" in listing.columns:
        work = extract_text(work)
    else:
        work = work.withColumn("error", F.lit(None).cast("string"))
    # Extraction is the costly step and three tables follow from it.
    reading = Observation()
    extracted = cut_lineage(work.drop("bytes").observe(reading, rp.error_count()))
    docs, failed = split_failures(extracted, as_of)
    fresh = ix.build_files(docs.withColumn("indexed_at", F.lit(as_of)))
    gone = diff.where("change = 'missing'").select("normalized_path")
    updated = cut_lineage(mn.record_errors(mn.carried_over(corpus.files, fresh), failed))
    known = corpus.files.join(failed.select("normalized_path"), "normalized_path", "left_semi")
    errors = mn.record_errors(known.join(updated.select("normalized_path"), "normalized_path", "left_anti"), failed)

    # Bodies follow their file by id: an updated file keeps the id it had.
    replaced = docs.join(updated.select("normalized_path", F.col("file_id").alias("kept_id")), "normalized_path")
    removed = corpus.files.join(gone, "normalized_path", "left_semi").select("file_id")
    failures = failed
    if corpus.failures is not None:
        cleared = mine(corpus.failures).select("normalized_path") if delete_missing else seen
        failures = mn.latest_failures(corpus.failures.join(cleared, "normalized_path", "left_anti").unionByName(failed))
    return Changes(
        diff, updated, errors, gone,
        dropped=cut_lineage(replaced.select(F.col("kept_id").alias("file_id")).unionByName(removed)),
        bodies=ix.build_segments(replaced.withColumn("file_id", F.col("kept_id"))),
        failed=failed,
        failures=failures,
        statistics=rp.observed_statistics(corpus.files.sparkSession, changes.get, reading.get),
    )


def _refresh(
    corpus: Corpus, listing: DataFrame, as_of: float, mine: Callable[[DataFrame], DataFrame], delete_missing: bool = True
) -> Refresh:
    found = _changes(corpus, listing, as_of, mine, delete_missing)
    again = found.updated.unionByName(found.errors)
    touched = again.select("normalized_path").unionByName(found.gone)
    files = cut_lineage(corpus.files.join(touched, "normalized_path", "left_anti").unionByName(again))
    segments = mn.delete_files(corpus.segments.select(*sch.SEGMENTS.fieldNames()), found.dropped).unionByName(found.bodies)
    postings = None
    if corpus.postings is not None:
        postings = mn.delete_files(corpus.postings, found.dropped).unionByName(ix.build_postings(found.bodies))
    new = corpus.with_(
        files=files,
        segments=segments,
        postings=postings,
        terms=None if postings is None else ix.term_stats(postings),
        stats=None if corpus.stats is None else ix.corpus_stats(segments),
        failures=found.failures,
    )
    return Refresh(new, found.diff, found.statistics)


def _changed(corpus: Corpus, found: Changes) -> Changed:
    """The changes as tables to be stored: new rows, replaced ids, signed counts."""
    again = cut_lineage(found.updated.unionByName(found.errors))
    removed = corpus.files.join(found.gone, "normalized_path", "left_semi").select("file_id")
    bodies = cut_lineage(found.bodies)
    postings = cut_lineage(ix.build_postings(bodies))
    signed = F.col("df") * F.col("sign")
    old = corpus.postings.join(found.dropped, "file_id", "left_semi")
    terms = ix.term_stats(postings).withColumn("sign", F.lit(1)).unionByName(ix.term_stats(old).withColumn("sign", F.lit(-1)))
    was = corpus.segments.join(found.dropped, "file_id", "left_semi").select("n_tokens", F.lit(-1).alias("sign"))
    counted = bodies.select("n_tokens", F.lit(1).alias("sign")).unionByName(was)
    replaced = again.select("file_id").unionByName(removed).select("file_id", F.lit("file").alias("kind"))
    return Changed(
        files=again,
        replaced=replaced.unionByName(found.dropped.select("file_id", F.lit("body").alias("kind"))),
        segments=bodies.withColumn("bucket", ix.id_bucket(F.col("file_id"))),
        postings=postings,
        terms=terms.groupBy("kind", "term").agg(F.sum(signed).alias("df")).where("df <> 0"),
        totals=counted.agg(
            F.coalesce(F.sum("sign"), F.lit(0)).cast("bigint").alias("n_docs"),
            F.coalesce(F.sum(F.col("sign") * F.col("n_tokens")), F.lit(0)).cast("double").alias("tokens"),
        ),
        failures=found.failures,
    )


def refresh_stored(
    path: str, listing: DataFrame, root: str, as_of: float, delete_missing: bool = True, depth: int | None = None,
    extensions: Iterable[str] | None = None, rules: Iterable[str] = (),
) -> Refresh:
    """Refresh a stored corpus. Only what changed is written, as the next version."""
    spark = listing.sparkSession
    scope = {"root": root, "depth": depth, "extensions": extensions, "rules": list(rules)}
    corpus = read_corpus(spark, path)
    found = _changes(corpus, listing, as_of, lambda rows: _of_scope(rows, scope), delete_missing)
    write_changes(_changed(corpus, found), path)
    return Refresh(read_corpus(spark, path), found.diff, found.statistics)


def refresh_targets(corpus: Corpus, targets: DataFrame, listings: DataFrame, as_of: float) -> Refresh:
    """Refresh every enabled root in one job.

    ``listings`` is the union of the roots' listings with a ``root`` column; roots do
    not overlap. Each stored row is judged by the depth, extensions and rules of its own
    root, so deletion is one anti-join; rows and failures of no enabled root stay.
    """
    enabled = targets.where("is_enabled")
    roots = enabled.select(F.col("full_path").alias("root"))
    listed = listings.join(roots, "root", "left_semi").drop("root")
    return _refresh(corpus, listed, as_of, lambda rows: _of_targets(rows, enabled))


def _of_targets(rows: DataFrame, enabled: DataFrame) -> DataFrame:
    """Rows that a refresh of their own root would visit."""
    settings = enabled.select(
        F.col("full_path").alias("covering_root"), "index_depth", "selected_extensions", "exclude_rules"
    )
    keyed = rows.select(F.col("normalized_path").alias("path"), F.lit("local").alias("source_type"))
    if "source_type" in rows.columns:
        keyed = rows.select(F.col("normalized_path").alias("path"), "source_type")
    covered = so.covering_root(keyed.distinct(), enabled).where("is_covered").join(settings, "covering_root")
    # Rule lists are settings: a few distinct ones, tested as columns.
    lists = [r[0] for r in enabled.select(F.coalesce("exclude_rules", F.array().cast("array<string>"))).distinct().collect()]
    visited = covered.where(mn.responsible_by_target(F.col("path"), lists))
    return rows.join(visited.select(F.col("path").alias("normalized_path")), "normalized_path", "left_semi")
