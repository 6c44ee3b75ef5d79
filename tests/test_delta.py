"""Versions: what a stored refresh writes, what readers see, compaction, and what a failed job leaves."""

import os

import pytest

from lodestone import SearchRequest, refresh_stored, search, write_corpus
from lodestone.sources import corpus as cp
from lodestone.sources.corpus import compact, latest_version, read_corpus

AS_OF = 1_706_745_600.0
LISTING = "normalized_path string, file_name string, file_ext string, created_at double, mtime double, size bigint, content string"


def listing(spark, *rows):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[1], "." + p.rsplit(".", 1)[1], 1.0, m, len(t), t) for p, m, t in rows], LISTING)


def tables(corpus):
    """Comparable rows of all tables of a corpus."""
    stats = corpus.stats.first()
    return {
        "files": sorted((r.file_id, r.normalized_path, r.mtime, r.click_count) for r in corpus.files.collect()),
        "segments": sorted((r.file_id, r.content) for r in corpus.segments.collect()),
        "postings": sorted((r.kind, r.term, r.file_id, r.tf) for r in corpus.postings.collect()),
        "terms": sorted((r.kind, r.term, r.df) for r in corpus.terms.collect()),
        "stats": (stats.n_docs, round(stats.avg_tokens, 9)),
    }


@pytest.fixture
def stored(spark, make_corpus, tmp_path):
    path = str(tmp_path / "corpus")
    docs = [(f"/r/f{i}.md", f"word{i % 7} common 寿司{i} body", {"mtime": 1.0, "click_count": i, "size": 5}) for i in range(200)]
    write_corpus(make_corpus(*docs), path)
    return path, [(p, 1.0, t) for p, t, _ in docs]


def unchanged(rows):
    return [(p, m, "xxxxx") for p, m, _ in rows]  # size 5, so that nothing is read again


def test_deltas_equal_a_rebuild(spark, make_corpus, stored):
    path, rows = stored
    kept = unchanged(rows[2:])
    refresh_stored(path, listing(spark, *kept, ("/r/f0.md", 2.0, "changed words"), ("/r/new.md", 1.0, "fresh 寿司 text")), "/r", AS_OF)
    refresh_stored(path, listing(spark, ("/r/new.md", 3.0, "fresh again"), ("/r/f5.md", 4.0, "fifth")), "/r", AS_OF, delete_missing=False)
    assert latest_version(spark, path) == 3
    merged = read_corpus(spark, path)
    rebuilt = merged.with_(postings=None, terms=None, stats=None).rebuilt()
    assert tables(merged) == tables(rebuilt)
    rows_of = {r.normalized_path: r for r in merged.files.collect()}
    assert len(rows_of) == 200 and "/r/f1.md" not in rows_of and rows_of["/r/f5.md"].click_count == 5
    found = search(merged, SearchRequest("fresh", target="body", as_of=AS_OF)).page().collect()
    assert [(r.file_name, r.snippet) for r in found] == [("new.md", "<mark>fresh</mark> again")]
    before = tables(merged)
    compact(spark, path)
    after = read_corpus(spark, path)
    assert latest_version(spark, path) == 4 and tables(after) == before
    refresh_stored(path, listing(spark, ("/r/f9.md", 9.0, "ninth")), "/r", AS_OF, delete_missing=False)
    assert ("word", "ninth", 1) in tables(read_corpus(spark, path))["terms"]


def test_a_small_refresh_writes_few_rows(spark, stored):
    path, rows = stored
    refresh_stored(path, listing(spark, ("/r/f3.md", 2.0, "one two"), ("/r/f4.md", 2.0, "three")), "/r", AS_OF, delete_missing=False)
    counts = {t: spark.read.parquet(f"{path}/{t}/version=2").count() for t in ("files", "segments", "replaced", "postings")}
    assert counts == {"files": 2, "segments": 2, "replaced": 4, "postings": 3}
    again = refresh_stored(path, listing(spark, ("/r/f3.md", 2.0, "one two")), "/r", AS_OF, delete_missing=False)
    assert again.statistics.first().writes == 0


def test_what_a_failed_job_leaves_is_not_read(spark, stored, monkeypatch):
    path, _ = stored
    before = tables(read_corpus(spark, path))
    new = listing(spark, ("/r/f3.md", 2.0, "one two"))

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(cp, "_declare", broken)
    with pytest.raises(RuntimeError):
        refresh_stored(path, new, "/r", AS_OF, delete_missing=False)
    monkeypatch.undo()
    assert latest_version(spark, path) == 1 and os.path.isdir(f"{path}/files/version=2") and tables(read_corpus(spark, path)) == before
    refresh_stored(path, listing(spark, ("/r/f9.md", 2.0, "nine")), "/r", AS_OF, delete_missing=False)
    after = tables(read_corpus(spark, path))
    assert latest_version(spark, path) == 2 and ("word", "nine", 1) in after["terms"] and not [t for t in after["terms"] if t[1] == "two"]


def test_an_empty_corpus_is_stored(spark, make_corpus, tmp_path):
    path = str(tmp_path / "none")
    write_corpus(make_corpus(("/a/b.md", "x")).with_(files=make_corpus(("/a/b.md", "x")).files.limit(0), segments=make_corpus(("/a/b.md", "x")).segments.limit(0)), path)
    assert read_corpus(spark, path).files.count() == 0
    refresh_stored(path, listing(spark, ("/r/a.md", 2.0, "first word")), "/r", AS_OF)
    assert read_corpus(spark, path).stats.first().n_docs == 1
