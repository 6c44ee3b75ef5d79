"""Search behaviour on small hand-written corpora."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestone import SearchRequest, search, search_existing, search_names
from lodestone.functions.terms import history_key, split_query
from lodestone.operators import rank as rk
from lodestone.operators.match import body_units, match_body

AS_OF = 1_706_745_600.0


def ask(q, **options):
    options.setdefault("as_of", AS_OF)
    return SearchRequest(q=q, **options)


def test_name_levels_order(make_corpus, names_of):
    corpus = make_corpus(
        ("/d/alpha-only.md", "beta"),
        ("/d/alpha-notes-beta.md", "x"),
        ("/d/memo-alpha beta-2026.md", "x"),
        ("/d/alpha beta.md", "x"),
    )
    found = search(corpus, ask("alpha beta"))
    assert names_of(found) == ["alpha beta.md", "memo-alpha beta-2026.md", "alpha-notes-beta.md", "alpha-only.md"]
    levels = {r.file_name: r.filename_match_level for r in found.matches.collect()}
    assert sorted(levels.values(), reverse=True) == [8, 7, 6, 2]


def test_japanese_bigrams_scan_and_index_agree(make_corpus):
    corpus = make_corpus(("/d/a.md", "今日はお寿司が食べたい。"), ("/d/b.md", "寿 司"), ("/d/c.md", "寿。司"))
    for c in (corpus, corpus.indexed()):
        rows = search(c, ask("寿司")).page().collect()
        assert [r.file_name for r in rows] == ["a.md"]
        assert "<mark>寿司</mark>" in rows[0].snippet
        assert rows[0].match_rank == 1


def test_synonyms_first_group_wins(make_corpus, names_of):
    corpus = make_corpus(("/d/a.md", "新しいスマートフォンを買う"), ("/d/b.md", "無関係"))
    groups = (("スマートフォン", "スマホ", "モバイル"), ("スマホ", "無関係"))
    assert names_of(search(corpus, ask("スマホ", synonyms=groups))) == ["a.md"]


def test_terms_may_meet_in_different_fields(make_corpus, names_of):
    corpus = make_corpus(("/d/クラリネット.md", "好きな楽器について"), ("/d/ピアノ.md", "楽器"))
    assert names_of(search(corpus, ask("クラリネット 楽器"))) == ["クラリネット.md"]


def test_excluded_and_escaped_terms(make_corpus, names_of):
    corpus = make_corpus(("/d/a.md", "alpha beta"), ("/d/b.md", "alpha"), ("/beta/c.md", "alpha"), ("/d/d.md", "has -beta flag"))
    assert names_of(search(corpus, ask("alpha -beta"))) == ["b.md"]
    assert names_of(search(corpus, ask("\\-beta"))) == ["d.md"]
    assert names_of(search(corpus, ask("-beta", target="body"))) == ["d.md"]
    assert split_query("a -b \\-c -") == (["a", "-c", "-"], ["b"])
    assert split_query("-a -b") == (["-a", "-b"], [])


def test_punctuation_is_a_phrase(make_corpus, names_of):
    corpus = make_corpus(("/d/a.md", "say hello-world foo/bar c++ [test]"), ("/d/b.md", "world hello"))
    for c in (corpus, corpus.indexed()):
        assert names_of(search(c, ask("hello-world"))) == ["a.md"]
        assert names_of(search(c, ask("[test]"))) == ["a.md"]
        assert names_of(search(c, ask("foo/bar"))) == ["a.md"]


def test_letters_with_digits_match_inside_words(make_corpus, names_of):
    corpus = make_corpus(("/d/a.md", "song.xmp3y"), ("/d/b.md", "mp 3"))
    for c in (corpus, corpus.indexed()):
        assert names_of(search(c, ask("mp3", target="body"))) == ["a.md"]


def test_short_dense_body_beats_clicks(make_corpus, names_of):
    corpus = make_corpus(
        ("/d/dense.md", "needle"),
        ("/d/sparse.md", "needle " + "filler " * 400, {"click_count": 1000}),
        ("/d/other.md", "nothing"),
    )
    assert names_of(search(corpus, ask("needle", target="body"))) == ["dense.md", "sparse.md"]


def test_query_clicks_are_learned(spark, make_corpus, names_of):
    clicks = spark.createDataFrame(
        [(history_key(" ＡＬＰＨＡ "), 1, 3, AS_OF)], "normalized_query string, file_id bigint, click_count bigint, last_clicked_at double"
    )
    corpus = make_corpus(("/d/a.md", "alpha " + "x " * 50), ("/d/b.md", "alpha"), query_clicks=clicks)
    assert names_of(search(corpus, ask("alpha", target="body"))) == ["a.md", "b.md"]
    assert names_of(search(corpus, ask("other alpha".split()[1] + "x", target="body"))) == []


def test_page_past_the_end_keeps_the_total(make_corpus):
    corpus = make_corpus(*[(f"/d/{i}.md", "word") for i in range(5)])
    found = search(corpus, ask("word", target="body", limit=2, offset=10))
    assert found.page().collect() == []
    assert tuple(found.info().first()) == (5, 0, False, None)
    middle = search(corpus, ask("word", target="body", limit=2, offset=2)).info().first()
    assert tuple(middle) == (5, 2, True, 4)


def test_extensions_are_distinct(make_corpus, names_of):
    corpus = make_corpus(("/d/a.md", "word"), ("/d/b.excalidraw.md", "word"), ("/d/c.dio.svg", "word"), ("/d/word.svg", None))
    assert names_of(search(corpus, ask("word", types="md"))) == ["a.md"]
    assert names_of(search(corpus, ask("word", types=".excalidraw.md"))) == ["b.excalidraw.md"]
    assert names_of(search(corpus, ask("word", types="svg"))) == ["word.svg"]


def test_title_and_alias_ranks(make_corpus):
    corpus = make_corpus(
        ("/d/1.md", "---\ntitle: Grand Plan\n---\nbody"),
        ("/d/2.md", "---\naliases: [plan b, other]\ntags: [Top]\n---\nbody"),
    )
    rows = {r.file_name: r for r in search(corpus, ask("plan", target="filename")).matches.collect()}
    assert (rows["1.md"].segment_type, rows["1.md"].filename_match_level) == ("title", 4)
    assert (rows["2.md"].segment_type, rows["2.md"].filename_match_level) == ("alias", 3)
    assert rows["2.md"].has_top_tag and not rows["1.md"].has_top_tag
    exact = search(corpus, ask("grand plan", target="filename")).matches.first()
    assert exact.filename_match_level == 5


def test_folders_join_the_results(make_corpus):
    corpus = make_corpus(("/work/alpha/one.md", "x"), ("/work/alpha/two.md", "alpha"), ("/work/beta/3.md", "x"))
    rows = search(corpus, ask("alpha")).page().orderBy("position").collect()
    assert [(r.result_kind, r.file_name) for r in rows] == [("file", "two.md"), ("folder", "alpha")]
    assert rows[1].snippet == "フォルダー名一致: /work/<mark>alpha</mark>"
    names = search_names(corpus, "alpha").collect()
    assert [(r.name, r.type) for r in names] == [("alpha", "directory")]


def test_rules_apply_below_the_target_only(make_corpus, names_of):
    corpus = make_corpus(("/old/work/a.md", "word"), ("/old/work/build/b.md", "word"), ("/old/work/.git/c.md", "word"))
    rules = ("old", "build", ".git")
    assert names_of(search(corpus, ask("word", full_path="/old/work", exclude_rules=rules))) == ["a.md"]
    assert names_of(search(corpus, ask("word", exclude_rules=rules))) == []
    assert names_of(search_existing(corpus, "word", "/old/work", as_of=AS_OF)) == ["a.md"]


def test_days_are_inclusive(make_corpus, names_of):
    at = lambda day, hour: 1_704_067_200.0 + (day - 1) * 86_400 + hour * 3600
    corpus = make_corpus(*[(f"/d/{d}-{h}.md", "word", {"created_at": at(d, h)}) for d, h in ((1, 23), (2, 0), (3, 23), (4, 0))])
    found = search(corpus, ask("word", date_from=date(2024, 1, 2), date_to=date(2024, 1, 3), sort_by="created", sort_order="asc"))
    assert sorted(names_of(found)) == ["2-0.md", "3-23.md"]


def test_scope_without_path_uses_targets(spark, make_corpus, names_of):
    layout = "full_path string, source_type string, is_enabled boolean"
    docs = (("/a/1.md", "word"), ("/a/sub/2.md", "word"), ("/b/3.md", "word"), ("/ab/4.md", "word"))
    enabled = spark.createDataFrame([("/a", "local", True), ("/a/sub", "local", True), ("/b", "local", False)], layout)
    assert sorted(names_of(search(make_corpus(*docs, targets=enabled), ask("word", search_all=False)))) == ["1.md", "2.md"]
    none = spark.createDataFrame([("/b", "local", False)], layout)
    assert names_of(search(make_corpus(*docs, targets=none), ask("word", search_all=False))) == ["3.md"]
    assert names_of(search(make_corpus(*docs, targets=none.where("false")), ask("word", search_all=False))) == []


def test_regex_search(make_corpus):
    corpus = make_corpus(("/work/a.md", "order A-17 & more"), ("/work/A-1.md", None), ("/x99/c.md", "none"), ("/work/d.md", "a-2 skip"))
    rows = search(corpus, ask(r"a-\d+ -skip", regex=True)).page().orderBy("position").collect()
    assert [r.file_name for r in rows] == ["A-1.md", "a.md"]
    assert rows[1].snippet == "order <mark>A-17</mark> &amp; more"
    assert rows[0].snippet == "ファイル名一致: <mark>A-1</mark>.md"
    folders = search(corpus, ask(r"x\d+", regex=True)).page().collect()
    assert [(r.result_kind, r.full_path) for r in folders] == [("folder", "/x99")]
    with pytest.raises(ValueError):
        search(corpus, ask("(", regex=True))


def test_explicit_orders(make_corpus, names_of):
    corpus = make_corpus(
        ("/d/a.md", "word", {"mtime": 3.0, "importance": 1.0}),
        ("/d/b.md", "word", {"mtime": 1.0, "importance": 5.0}),
        ("/d/c.md", "word", {"mtime": 2.0, "importance": 5.0}),
    )
    assert names_of(search(corpus, ask("word", target="body", sort_by="modified"))) == ["c.md", "b.md", "a.md"]
    assert names_of(search(corpus, ask("word", sort_by="modified"))) == ["a.md", "c.md", "b.md"]
    assert names_of(search(corpus, ask("word", sort_by="modified", sort_order="asc"))) == ["b.md", "c.md", "a.md"]


def test_buckets_counted_equals_window(spark):
    rows = spark.createDataFrame(
        [(i % 5, 1e6 if i % 5 >= 2 else (0.0 if i % 10 == 0 else -1e-6 - (i * 7919 % 1013) / 1013 / 10 ** (i % 7))) for i in range(5000)],
        "match_rank int, score double",
    )
    a = rk.relevance_bucket(rows, "counted").groupBy("match_rank", "score", "relevance_bucket").count()
    b = rk.relevance_bucket(rows, "window").groupBy("match_rank", "score", "relevance_bucket").count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_overlapping_phrase_is_counted(make_corpus):
    corpus = make_corpus(("/d/a.md", "x-x x, x y"), ("/d/b.md", "zz"), ("/d/c.md", "zz"))
    units = body_units([["x-x"]])
    for c in (corpus, corpus.indexed()):
        (scored,) = match_body(c, units)
        assert [r.file_id for r in scored.collect()] == [1]
    from lodestone.operators.match import posting_frequencies, scan_frequencies

    scan = scan_frequencies(corpus.segments, units).first().tf_0
    assert scan == 3 == posting_frequencies(corpus.indexed().postings, units).first().tf_0


def test_requests_are_checked():
    for bad in (dict(q=""), dict(q="a", limit=0), dict(q="a", limit=1001), dict(q="a", full_path="rel"), dict(q="a", sort_by="x"),
                dict(q="a", date_from=date(2024, 2, 1), date_to=date(2024, 1, 1))):
        with pytest.raises(ValueError):
            SearchRequest(**bad)


def test_snippets_escape_and_mark(make_corpus):
    corpus = make_corpus(("/d/a.md", "<b>" + "x" * 60 + " Needle & 'pin' " + "y" * 100), ("/d/b.md", "needle mark"))
    rows = {r.file_name: r.snippet for r in search(corpus, ask("needle", target="body")).page().collect()}
    assert rows["a.md"].startswith("...x") and rows["a.md"].endswith("y...")
    assert "<mark>Needle</mark> &amp; &#x27;pin&#x27;" in rows["a.md"]
    named = make_corpus(("/d/needle <1>.txt", None))
    assert "<mark>needle &lt;1&gt;.txt</mark>" in search(named, ask("needle")).page().first().snippet
