"""Values and scopes that differ in small ways: metrics, folding, pages of one URL, roots with their own settings."""

import json

from pyspark.sql import functions as F

from lodestone import from_pages, refresh, refresh_targets
from lodestone.functions import scores as sc
from lodestone.functions import terms as tm
from lodestone.functions import urls as ux
from lodestone.operators import reports as rp
from lodestone.operators.extract import extract_pages
from lodestone.sources.records import import_metrics, read_access_metrics
from lodestone.sources.rules import synonym_rules

AS_OF = 1_706_745_600.0
LISTING = "normalized_path string, file_name string, file_ext string, created_at double, mtime double, size bigint, content string"
TARGETS = "full_path string, source_type string, is_enabled boolean, exclude_rules array<string>, index_depth int, selected_extensions array<string>"


def listing(spark, *paths):
    rows = [(p, p.rsplit("/", 1)[1], "." + p.rsplit(".", 1)[1], 1.0, 1.0, 1, "x") for p in paths]
    return spark.createDataFrame(rows, LISTING)


def paths(df):
    return sorted(r.normalized_path for r in df.select("normalized_path").collect())


def test_each_root_deletes_in_its_own_scope(spark, make_corpus):
    stored = ("/on/a.md", "/on/gone.md", "/on/b.txt", "/on/d1/d2/c.md", "/on/old/x.md", "/deep/a/b/c.md", "/deep/n.txt", "/off/o.md", "/else/e.md")
    failed = [(p, p.rsplit("/", 1)[1], "error", 1.0) for p in ("/on/f.md", "/on/f.txt", "/on/d1/d2/f.md", "/deep/f.md", "/off/f.md", "/else/f.md")]
    failures = spark.createDataFrame(failed, "normalized_path string, file_name string, error_message string, last_failed_at double")
    corpus = make_corpus(*((p, "x", {"mtime": 1.0, "size": 1}) for p in stored), failures=failures)
    targets = spark.createDataFrame(
        [
            ("/on", "local", True, ["old"], 0, [".md"]), ("/deep", "local", True, [], 5, None), ("/off", "local", False, [], 5, None),
        ], TARGETS,
    )
    listed = listing(spark, "/on/a.md", "/deep/new.md").withColumn("root", F.regexp_extract("normalized_path", "^(/[a-z]+)/", 1))
    done = refresh_targets(corpus, targets, listed, AS_OF)
    assert paths(done.corpus.files) == sorted({*stored, "/deep/new.md"} - {"/on/gone.md", "/deep/a/b/c.md", "/deep/n.txt"})
    assert paths(done.corpus.failures) == ["/else/f.md", "/off/f.md", "/on/d1/d2/f.md", "/on/f.txt"]
    stats = done.statistics.first()
    assert (stats.files, stats.writes, stats.skipped, stats.removed) == (2, 1, 1, 3)


def test_removed_counts_what_was_removed(spark, make_corpus):
    corpus = make_corpus(*((p, "x", {"mtime": 1.0, "size": 1}) for p in ("/on/a.md", "/on/b.txt", "/on/d/c.md")))
    done = refresh(corpus, listing(spark, "/on/a.md"), "/on", AS_OF, depth=0, extensions=[".md"])
    assert paths(done.corpus.files) == ["/on/a.md", "/on/b.txt", "/on/d/c.md"]
    assert done.statistics.first().removed == 0


def test_metrics_truncate_and_do_not_borrow(spark, make_corpus):
    values = spark.createDataFrame([("3.7",), ("true",), ("12",), ("-4",), ("x",), (None,), ("NaN",), ("1e400",), ("9007199254740993",)], "v string")
    got = [r[0] for r in values.select(sc.non_negative(F.col("v"))).collect()]
    assert got == [3, 1, 12, 0, 0, 0, 0, 0, 9007199254740993]
    doc = {"accessCounts": {"a.md": 9}, "fileMetrics": {"a.md": {"backlinkCount": 3}, "b.md": 4}}
    read = read_access_metrics(spark.createDataFrame([(json.dumps(doc),)], "payload string"), "/v")
    files = make_corpus(("/v/a.md", "x"), ("/v/b.md", "x")).files
    rows = {r.file_name: (r.imported_click_count, round(r.importance, 2)) for r in import_metrics(files, read, "/v", AS_OF).collect()}
    assert rows == {"a.md": (9, 98.72), "b.md": (4, 90.05)}


def test_folding_is_the_same_in_tables_and_requests(spark):
    lines = spark.createDataFrame([(1, "Straße, road,STRASSE"), (2, "road, way"), (3, ""), (4, None)], "group_id int, value string")
    rules = synonym_rules(lines)
    assert [(r.group_id, r.position, r.term) for r in rules.orderBy("group_id", "position").collect()] == [(1, 0, "Straße"), (1, 1, "road"), (2, 0, "road"), (2, 1, "way")]
    terms = spark.createDataFrame([(1, 0, "STRASSE"), (1, 1, "Road"), (2, 0, "none")], "query_id int, term_index int, term string")
    got = {}
    for r in tm.expand_terms(terms, rules).orderBy("query_id", "term_index", "variant_index").collect():
        got.setdefault((r.query_id, r.term_index), []).append(r.term)
    groups = (("Straße", "road"), ("road", "way"))
    assert got == {(1, 0): tm.variants_of("STRASSE", groups), (1, 1): tm.variants_of("Road", groups), (2, 0): ["none"]}
    assert rp.synonym_conflicts(rules, spark.createDataFrame([("STRASSE",)], "rule string")).where("is_excluded").count() == 1


def test_pages_of_one_url_are_one_document(spark):
    pages = spark.createDataFrame(
        [(1, "http://h.example/a#x", "<p>old"), (2, "HTTP://H.example/a", "<p>new"), (3, "http://h.example/b", None), (4, "ftp://no", "x"), (2, "HTTP://H.example/a", "<p>new")],
        "page_id bigint, url string, html string",
    )
    got = from_pages(pages, 1.0).orderBy("normalized_path").collect()
    assert [(r.normalized_path, r.content) for r in got] == [("http://h.example/a", "new"), ("http://h.example/b", "")]
    assert from_pages(pages.drop("page_id"), 1.0).count() == 2


def test_page_parts(spark):
    html = (
        "<title>T &amp; t</title><nav class='Breadcrumb'><a href=/up>Up</a></nav><nav><a href='/n'>N</a><a class=breadcrumb href=/c>C</a></nav>"
        "<script type='application/ld+json'>{\"a\": 1}</script><script>var x</script><svg><text>no</text></svg></svg><p>Body  text"
    )
    row = extract_pages(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).where("url = 'u'").first()
    assert (row.title, row.content) == ("T & t", "Up N C Body text")
    assert (row.links, row.breadcrumb_links, row.json_ld_blocks) == (["/up", "/n", "/c"], ["/up", "/c"], ['{"a": 1}'])


def test_breadcrumb_targets():
    entries = ["http://a/", {"item": "http://b/"}, {"item": {"id": "http://c/", "url": "x"}}, {"url": "http://d/", "item": {"@id": 3}}, 5, {"item": {}}]
    block = json.dumps([{"@type": ["X", "BreadcrumbList"], "itemListElement": entries}, {"@type": "Other", "itemListElement": entries}])
    assert ux._crumbs(block) == ["http://a/", "http://b/", "http://c/", "http://d/"]


def test_scratch_tables_go(spark, make_corpus, tmp_path):
    import os

    from lodestone import SearchRequest, search
    from lodestone.session import scratch, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    corpus = make_corpus(("/r/a.md", "alpha"), ("/r/b.md", "beta alpha")).indexed()
    before = set(os.listdir(folder))
    with scratch(spark):
        assert search(corpus, SearchRequest("alpha", as_of=AS_OF)).matches.count() == 2
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_workers_get_the_package(tmp_path):
    """A query with the repository on the driver's path only."""
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(__file__).parent.parent)
    code = (
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from lodestone.session import ship; ship(spark)\n"
        "from lodestone.functions.terms import casefold\n"
        "print('GOT', spark.createDataFrame([('Straße',)], 't string').select(casefold('t')).first()[0])\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert "GOT strasse" in done.stdout, done.stderr[-800:]


def test_a_pattern_is_judged_by_the_engine_that_runs_it(make_corpus):
    import pytest

    from lodestone import SearchRequest, search

    corpus = make_corpus(("/r/a.md", "alpha1"), ("/r/b.md", "beta"))
    assert search(corpus, SearchRequest(r"\p{Alpha}++\d", regex=True, as_of=AS_OF)).matches.count() == 1
    with pytest.raises(ValueError):
        search(corpus, SearchRequest("(", regex=True, as_of=AS_OF))


def test_search_joins_no_whole_file_table(spark, make_corpus):
    """Every file row that takes part in a join has a name hit or meets an inner join."""
    from lodestone import SearchRequest
    from lodestone.operators import match as mt

    corpus = make_corpus(("/r/alpha.md", "beta"), ("/r/b.md", "alpha beta"), ("/r/c.md", "beta")).indexed()
    matched = mt.match_files(corpus, corpus.files, SearchRequest("alpha beta", as_of=AS_OF))
    assert sorted(r.file_name for r in matched.collect()) == ["alpha.md", "b.md"]
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    lefts = plan.split("Join LeftOuter, ")[1:]
    assert "Join Inner" in plan and all("Contains(lower(file_name" in x or "alpha)" in x for x in lefts)
