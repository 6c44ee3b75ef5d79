"""Stored postings and grams: lists on disk, rows for readers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone import Corpus, read_corpus, write_corpus
from lodestone.operators import grams as gr
from lodestone.operators import index as ix
from lodestone.sources.corpus import compact

KANA = "あいう えお かき"
TEXTS = ["the cat and the hat", "The end", "cat! " * 3 + KANA, "été Straße-9", KANA + " the", "...", ""]


def corpus_of(spark, n: int) -> Corpus:
    rows = [(i, f"/r/f{i}.md", f"f{i}.md", ".md", TEXTS[i % len(TEXTS)]) for i in range(n)]
    docs = spark.createDataFrame(rows, "file_id bigint, normalized_path string, file_name string, file_ext string, content string")
    return Corpus.of(docs.coalesce(2).withColumn("source_type", F.lit("local")))


def as_set(df) -> list:
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_a_term_has_one_stored_row_for_many_files(spark, tmp_path):
    """Neither the shuffle nor the sort of a stored corpus meets every pair of a term, or a gram, and a file."""
    corpus, path = corpus_of(spark, 210), str(tmp_path / "c")
    write_corpus(corpus, path, parts=3, body_grams=True)
    read = read_corpus(spark, path)
    flat = ix.build_postings(corpus.segments)
    assert as_set(read.postings) == as_set(flat) and flat.count() > 500
    assert spark.read.parquet(f"{path}/postings").count() * 10 < flat.count()
    assert as_set(read.terms) == as_set(ix.term_stats(flat))
    assert spark.read.parquet(f"{path}/grams").count() * 5 < read.grams.count()
    assert as_set(read.gram_counts) == as_set(read.grams.groupBy("kind", "gram").agg(F.count("*").alias("n")))


def test_grams_are_those_of_each_text(spark):
    corpus = corpus_of(spark, 7)
    found = as_set(gr.build_grams(corpus.files, corpus.segments, spark.createDataFrame([("word", "été9")], "kind string, term string")))
    texts = {r.file_id: r.content.lower() for r in corpus.segments.collect()}
    printable = lambda g: all(" " <= c <= "~" for c in g)
    bodies = {("body", t[i : i + 3], str(k), "None") for k, t in texts.items() for i in range(len(t) - 2) if printable(t[i : i + 3])}
    cut = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    words = {("term", g, "None", "été9") for g in cut("été9")}
    names = {("name", g, str(r.file_id), "None") for r in corpus.files.collect() for x in (r.file_name, r.title or "", *(r.aliases or [])) for g in cut(x.lower())}
    assert found == sorted(bodies | words | names)


def test_blocks_of_many_pieces(monkeypatch):
    """A block ends with its pieces, a text of many tokens is a piece of its own; the rows are the same."""
    lists = [["a", "b", "a"], ["c"] * 50, ["", "a"], [], ["b"], ["a", "c"] * 4]
    columns = [pa.array(range(6)), pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, pa.list_(pa.string()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["file_id", "n_tokens", "tokens"])

    def rows(blocks) -> list:
        return sorted(
            (i, b["term"], tf, n, b["positions"][at : at + tf])
            for b in blocks for i, tf, n, at in zip(b["file_ids"], b["tfs"], b["lengths"], b["starts"])
        )

    made = lambda: [b for x in ix._block_tokens(iter([batch, batch.slice(0, 0)])) for b in x.to_pylist()]
    flat = sorted((r["file_id"], r["term"], r["tf"], r["n_tokens"], r["positions"]) for b in ix._group_tokens(iter([batch])) for r in b.to_pylist())
    assert len(made()) == 3 and rows(made()) == flat
    monkeypatch.setattr(ix, "TOKENS_AT_ONCE", 4)
    monkeypatch.setattr(ix, "TOKENS_OF_BLOCKS", 4)
    assert len(made()) > 3 and rows(made()) == flat


def test_bigrams_are_cut_from_runs(spark, monkeypatch):
    """A worker gets runs, not a row of bi-grams made by position; places and pieces are those of the bi-grams."""
    rows = [(i, t, len(t)) for i, t in enumerate(["あいう x えお あい", "かき" * 40, "x", "あいあい々", "寿司 寿司"])]
    segments = spark.createDataFrame(rows, "file_id bigint, content string, n_tokens int").coalesce(1)
    flat = as_set(ix.build_postings(segments))
    assert as_set(ix.postings_of(ix.build_blocks(segments))) == flat and ("bigram", "あい", "0", "2", "11", "[0, 5]") in flat
    lists = pa.array([["あいう", "えお"], [], ["かき" * 40], ["あいあい"]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([1] * 4, pa.int32()), lists], names=["file_id", "n_tokens", "tokens"])
    whole = [b for x in ix._block_bigrams(iter([batch])) for b in x.to_pylist()]
    assert {b["term"]: (b["file_ids"], b["tfs"], b["positions"]) for b in whole}["あい"] == ([0, 3], [1, 2], [0, 0, 2])
    monkeypatch.setattr(ix, "TOKENS_AT_ONCE", 4)
    monkeypatch.setattr(ix, "TOKENS_OF_BLOCKS", 4)
    pieces = [b for x in ix._block_bigrams(iter([batch])) for b in x.to_pylist()]
    assert len(pieces) > len(whole) and "transform" not in ix.build_blocks(segments)._jdf.queryExecution().optimizedPlan().toString()


def test_given_postings_are_stored_as_they_are(spark, tmp_path):
    corpus, path = corpus_of(spark, 30).indexed(), str(tmp_path / "c")
    write_corpus(corpus, path, parts=2)
    assert as_set(read_corpus(spark, path).postings) == as_set(corpus.postings)
    compact(spark, path, parts=2)
    assert as_set(read_corpus(spark, path).postings) == as_set(corpus.postings)


def test_only_lists_that_are_asked_for_are_read(spark, tmp_path):
    corpus, path = corpus_of(spark, 14), str(tmp_path / "c")
    write_corpus(corpus, path, parts=2)
    counts = read_corpus(spark, path).postings.where("kind = 'word' and term = 'the'").select("file_id", "tf")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "tfs" in read and "positions" not in read and "EqualTo(term,the)" in plan
