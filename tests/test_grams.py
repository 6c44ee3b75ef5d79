"""Stored grams: conditions of patterns, candidates, names, what a refresh leaves in them."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import SearchRequest, read_corpus, refresh_stored, search, search_many, write_corpus
from lodestone.functions import patterns as pt
from lodestone.operators import grams as gr
from lodestone.operators import index as ix
from lodestone.operators import match as mt
from lodestone.plans import batch
from lodestone.session import scratch_path

BODIES = [
    ("/a/license.md", "The MIT Licence and a licenſe with a long s"), ("/a/mail.md", "write to mail12@example.org, see K9"), ("/b/kelvin.md", "300 Kelvin of ice"),
    ("/b/apache.txt", "Apache   License"), ("/b/none.txt", "Nothing to see here"), ("/c/über.md", "ÜBER licensing İstanbul"), ("/c/empty.md", "x"), ("/c/blank.md", " "),
]
PATTERNS = [
    "licen[cs]e", "mail[0-9]+@", "apache +licen", "(mit|isc) licen[cs]e", "th[ae]r", "colou?r|noth(ing)?", "x", ".*", "[0-9]{2}@exam", r"\bkelvin\b", "üb.r", "is(tan)+bul",
    r"\Q12@\E", "(?:to|see) here", "s(?!ee)", "licen(?=ſ)", "[^x]cence", "a.{2,3}license", r"\w+@", "",
]


@pytest.fixture(scope="module")
def stored(spark, make_corpus):
    path = scratch_path(spark, "grams")
    write_corpus(make_corpus(*BODIES), path, parts=2, body_grams=True)
    return path, read_corpus(spark, path)


def fulfilled(condition, text):
    if condition is None:
        return True
    if isinstance(condition, str):
        return condition in text
    return (all if isinstance(condition, pt.All) else any)(fulfilled(p, text) for p in condition.parts)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([p for p in PATTERNS if p and "\\Q" not in p]).flatmap(lambda p: st.tuples(st.just(p), st.from_regex(re.compile(p, re.I | re.A)))))
def test_every_match_fulfils_its_condition(sample):
    pattern, text = sample
    folded = text.translate(str.maketrans(*gr.FOLDED)).lower()
    assert fulfilled(pt.needs(pattern), folded)


def test_conditions():
    assert pt.needs("licen[cs]e") == pt.Any(("licence", "license"))
    assert pt.needs("foo.*bar") == pt.All(("foo", "bar"))
    assert pt.needs("ab+cd") == "bcd" and pt.needs("abx?cd") is None and pt.needs("(abc){0,2}") is None
    for unclear in ("(?x)a b c", "[a[bc]]def", r"\x41bcd", "[a-z&&[^b]]cde", "abc**", "a(b", "abc)", "["):
        assert pt.needs(unclear) is None, unclear


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if p])
def test_pattern_search_equals_the_scan(stored, make_corpus, pattern):
    request = SearchRequest(pattern, regex=True, as_of=1.0)
    plain = {r.full_path for r in search(make_corpus(*BODIES), request).matches.collect()}
    assert {r.full_path for r in search(stored[1], request).matches.collect()} == plain


def test_a_pattern_names_few_bodies(stored):
    found = gr.pattern_files(stored[1], "mail[0-9]+@")
    assert found.count() == 1
    assert gr.pattern_files(stored[1], "e.*") is None and gr.pattern_files(stored[1], "nowhere to be found").count() == 0


def test_the_scan_opens_fewer_files(spark, make_corpus):
    """A lookup by grams reads the folders of its candidates, of the grams the row groups of what it asks for."""
    docs = [(f"/d/f{k}.md", f"text number{k} " + ("needle9" if k == 77 else "")) for k in range(300)]
    path = scratch_path(spark, "fewer")
    write_corpus(make_corpus(*docs), path, parts=4, body_grams=True)
    corpus = read_corpus(spark, path)
    bodies = gr.bodies_of(corpus.segments, gr.pattern_files(corpus, "needle[0-9]"))
    opened = lambda df: df.select(F.input_file_name()).distinct().count()
    plan = bodies._jdf.queryExecution().executedPlan().toString()
    assert bodies.count() == 1 and opened(corpus.segments) > 40 and opened(bodies) == 1 and "PushedFilters: [IsNotNull(file_id), EqualTo(file_id,78)" in plan
    rows = corpus.grams.where("kind = 'body' and gram = 'ne9'")
    assert "PushedFilters" in rows._jdf.queryExecution().executedPlan().toString() and opened(rows) <= 1


def test_small_ids_find_their_folder(spark, make_corpus):
    path = scratch_path(spark, "small")
    write_corpus(make_corpus(*[(f"/d/f{k}.md", f"body {k}") for k in range(200)]), path, parts=2)
    segments = read_corpus(spark, path).segments
    for k in (1, 7, 150):
        assert [r.content for r in ix.bodies_of(segments, [k]).collect()] == [f"body {k - 1}"]


def test_names_by_grams(stored, make_corpus):
    for q in ("li", "Über", "e m", "apache txt", "ke", "zzz", "md"):
        for target in ("filename", "filename_and_folder"):
            request = SearchRequest(q, target=target, as_of=1.0)
            want = {(r.full_path, r.filename_match_level) for r in search(make_corpus(*BODIES), request).matches.collect()}
            assert {(r.full_path, r.filename_match_level) for r in search(stored[1], request).matches.collect()} == want, q


def test_batch_cuts_no_grams(spark, stored, make_corpus):
    queries = spark.createDataFrame([(1, "license"), (2, "see here"), (3, "mail12"), (4, "über"), (5, "e"), (6, "12@exam")], "query_id int, q string")
    want = search_many(make_corpus(*BODIES).indexed(), queries, as_of=1.0).select("query_id", "file_id", "match_rank").collect()
    found = search_many(stored[1], queries, as_of=1.0).select("query_id", "file_id", "match_rank")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))


def test_batch_limit_is_cut_in_every_task(spark, stored):
    queries = spark.createDataFrame([(1, "e")], "query_id int, q string")
    plan = search_many(stored[1], queries, as_of=1.0, limit=2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan) and re.search(r"WindowGroupLimit .*Final", plan)


def test_refreshed_corpus_finds_by_grams(spark, make_corpus):
    path = scratch_path(spark, "again")
    write_corpus(make_corpus(*BODIES), path, parts=2, body_grams=True)
    new = [("/a/mail.md", "no address any more"), ("/b/fresh.md", "a fresh sublicense"), ("/b/apache.txt", "Apache   License")]
    listing = make_corpus(*new).files.join(spark.createDataFrame(new, "normalized_path string, content string"), "normalized_path")
    listing = listing.withColumn("mtime", F.col("mtime") + F.when(F.col("normalized_path") == "/a/mail.md", 5).otherwise(0))
    refresh_stored(path, listing, "/", 2_000_000_000.0, delete_missing=False)
    corpus = read_corpus(spark, path)
    paths = lambda p: {r.full_path for r in search(corpus, SearchRequest(p, regex=True, target="body", as_of=1.0)).matches.collect()}
    assert paths("mail[0-9]+@") == set() and "/b/fresh.md" in paths("sublicen[cs]e") and paths("address any") == {"/a/mail.md"}


# --- phrases from their rarest word -------------------------------------------


def test_leads_and_followers():
    units = [mt.Unit(0, "of-the-moon", "phrase"), mt.Unit(1, "the", "phrase"), mt.Unit(2, "of-us", "phrase")]
    counts = {("word", "of"): 100, ("word", "the"): 90, ("word", "moon"): 3, ("word", "us"): 50}
    leads, slow = mt.followers(units, counts)
    assert leads == {("word", "moon"), ("word", "us")}
    assert slow == set()  # "the" is a term of its own, "of" is not much more frequent than "us"
    assert mt.followers(units[:1], counts)[1] == {("word", "of"), ("word", "the")}


def test_phrases_start_from_the_rarest_word(spark, make_corpus):
    docs = [(f"/d/f{k}.md", "the cat of the house " * 3 + ("of the moon" if k % 40 == 0 else "")) for k in range(200)]
    corpus = make_corpus(*docs).indexed()
    units = mt.body_units([["of-the-moon"], ["the-cat"]])
    found = mt.posting_frequencies(corpus.postings, units, corpus.terms)
    plain = mt.scan_frequencies(corpus.segments, units)
    order = ["file_id", "n_tokens", "tf_0", "tf_1"]
    assert sorted(map(tuple, found.select(order).collect())) == sorted(map(tuple, plain.select(order).collect()))
    only = mt.posting_frequencies(corpus.postings, units[:1], corpus.terms)
    assert only.count() == 5
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and re.search(r"BroadcastHashJoin.*LeftSemi", plan)
    phrases = spark.createDataFrame([("a", "word", ["of", "the", "moon"]), ("b", "word", ["moon", "of"]), ("c", "word", ["the", "the"])], "term string, kind string, tokens array<string>")
    with_counts = sorted(map(tuple, batch.phrase_hits(corpus.postings, phrases, corpus.terms).collect()))
    assert with_counts == sorted(map(tuple, batch.phrase_hits(corpus.postings, phrases).collect())) and len(with_counts) == 5


def test_frequent_words_are_asked_for_by_file(spark, make_corpus):
    """A frequent word's postings meet only the files that hold a phrase's rarest word, not every phrase it is part of."""
    corpus = make_corpus(*((f"/d/{k}.md", f"the the word{k} the end{k % 3} the") for k in range(12))).indexed()
    tokens = [["the", f"word{k}"] for k in range(12)] + [["the", "the"], ["end1"], ["the", "end2", "the"], ["word3", "the", "end1"], ["no", "the"], ["the", "the", "the"]]
    phrases = spark.createDataFrame([(" ".join(t), "word", t) for t in tokens], "term string, kind string, tokens array<string>")
    found = batch.phrase_hits(corpus.postings, phrases, corpus.terms)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line]
    assert any("file_id" in line for line in joins)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, batch.phrase_hits(corpus.postings, phrases).collect())) and len(got) == 12 + 12 + 4 + 4


def test_a_batch_reads_no_body_for_words(spark, make_corpus):
    """Where words, phrases and bi-grams stand is known from the postings; bodies are for literals and excluded terms."""
    corpus = make_corpus(
        ("/d/a.md", "quick red fox well-known 寿司が"), ("/d/fox.md", "red red paint"), ("/d/c2.md", "quick quick fox code7b"), ("/d/e.md", None), ("/d/red-fox.md", "known well")
    ).indexed()
    rows = [(1, "quick fox"), (2, "red fox"), (3, "well-known"), (4, "寿司が"), (5, "red"), (6, "fox fox"), (7, "quick code7b"), (8, "quick -paint red"), (9, "fox -code7"), (10, "red -fox")]
    queries = spark.createDataFrame(rows, "query_id int, q string")
    ask = lambda c, q: sorted((r.query_id, r.file_name, r.match_rank, round(r.score, 9), r.filename_match_level, r.relevance_bucket) for r in batch.search_many(c, q).collect())
    got = ask(corpus, queries)
    assert ask(corpus.with_(segments=corpus.segments.limit(0)), queries.where("query_id <= 6")) == [r for r in got if r[0] <= 6]
    for number, q in rows[6:9]:
        found = search(corpus, SearchRequest(q, full_path="/d")).matches.where("result_kind = 'file'").collect()
        want = sorted((number, r.file_name, r.match_rank, round(r.score, 9), r.filename_match_level, r.relevance_bucket) for r in found)
        assert [r for r in got if r[0] == number] == want, q
