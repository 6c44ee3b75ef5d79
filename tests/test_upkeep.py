"""Refresh, storage, deletion scope, batch search and streams."""

from pyspark.sql import functions as F

from lodestone import SearchRequest, refresh, refresh_stored, search, search_many, write_corpus
from lodestone.functions import paths as px
from lodestone.functions import rules as rl
from lodestone.operators import maintain as mn
from lodestone.operators import rank as rk
from lodestone.sources.corpus import latest_version, read_corpus
from lodestone.sources.rules import synonym_groups
from lodestone.streaming.refresh import refresh_stream

AS_OF = 1_706_745_600.0
LISTING = "normalized_path string, file_name string, file_ext string, created_at double, mtime double, size bigint, content string"


def listing(spark, *rows):
    return spark.createDataFrame(
        [(p, p.rsplit("/", 1)[1], "." + p.rsplit(".", 1)[1], 1.0, m, len(t), t) for p, m, t in rows], LISTING
    )


def paths(df):
    return sorted(r.normalized_path for r in df.select("normalized_path").collect())


def test_refresh_equals_rebuild(spark, make_corpus):
    old = make_corpus(
        ("/r/a.md", "alpha one", {"mtime": 1.0, "click_count": 7}), ("/r/b.md", "alpha two", {"mtime": 1.0}),
        ("/r/c.md", "gone alpha", {"mtime": 1.0}), ("/other/d.md", "alpha stays", {"mtime": 1.0}),
    ).indexed()
    now = listing(spark, ("/r/a.md", 2.0, "alpha changed words"), ("/r/b.md", 1.0, "alpha two"), ("/r/e.md", 1.0, "alpha new"))
    done = refresh(old, now, "/r", AS_OF)
    assert paths(done.corpus.files) == ["/other/d.md", "/r/a.md", "/r/b.md", "/r/e.md"]
    row = done.corpus.files.where("file_name = 'a.md'").first()
    assert (row.file_id, row.click_count, row.mtime) == (1, 7, 2.0)
    stats = done.statistics.first()
    assert (stats.files, stats.writes, stats.skipped, stats.removed, stats.errors) == (3, 2, 1, 1, 0)
    rebuilt = done.corpus.with_(segments=done.corpus.segments, postings=None, terms=None, stats=None).indexed()
    a = done.corpus.postings.select("kind", "term", "file_id", "tf", "n_tokens")
    b = rebuilt.postings.select("kind", "term", "file_id", "tf", "n_tokens")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    found = search(done.corpus, SearchRequest("alpha", target="body", as_of=AS_OF)).matches
    assert found.count() == 4


def test_stored_snapshots(spark, make_corpus, tmp_path):
    path = str(tmp_path / "corpus")
    write_corpus(make_corpus(("/r/a.md", "alpha", {"mtime": 1.0}), ("/r/b.md", "寿司 beta", {"mtime": 1.0})), path)
    assert latest_version(spark, path) == 1
    refresh_stored(path, listing(spark, ("/r/a.md", 1.0, "alpha"), ("/r/n.md", 1.0, "fresh beta")), "/r", AS_OF)
    assert latest_version(spark, path) == 2
    stored = read_corpus(spark, path)
    assert paths(stored.files) == ["/r/a.md", "/r/n.md"]
    page = search(stored, SearchRequest("beta", target="body", as_of=AS_OF)).page().collect()
    assert [(r.file_name, r.snippet) for r in page] == [("n.md", "fresh <mark>beta</mark>")]


def test_stream_adds_and_never_deletes(spark, make_corpus, tmp_path):
    path, source = str(tmp_path / "corpus"), str(tmp_path / "in")
    write_corpus(make_corpus(("/r/a.md", "alpha", {"mtime": 1.0})), path)
    for number, rows in enumerate([[("/r/n.md", 1.0, "one")], [("/r/n.md", 3.0, "three"), ("/r/n.md", 2.0, "two"), ("/r/m.txt", 1.0, "m")]]):
        listing(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LISTING).parquet(source)
        job = refresh_stream(stream, path, str(tmp_path / "state"), AS_OF).trigger(availableNow=True).start()
        job.awaitTermination()
        assert latest_version(spark, path) == number + 2
    stored = read_corpus(spark, path)
    assert paths(stored.files) == ["/r/a.md", "/r/m.txt", "/r/n.md"]
    assert sorted(r.content for r in stored.segments.collect()) == ["alpha", "m", "three"]


def test_refresh_deletes_only_in_its_scope(spark, make_corpus):
    files = make_corpus(
        ("/r/top.md", "x"), ("/r/sub/deep.md", "x"), ("/r/note.txt", "x"), ("/r/build/out.md", "x"), ("/s/else.md", "x")
    ).files
    nothing = files.where("false").select("normalized_path")
    gone = lambda **scope: paths(mn.missing_rows(files, nothing, **scope))
    assert gone(root="/r", depth=0) == ["/r/note.txt", "/r/top.md"]
    assert gone(root="/r", extensions=[".txt"]) == ["/r/note.txt"]
    assert gone(root="/r", rules=["build"]) == ["/r/note.txt", "/r/sub/deep.md", "/r/top.md"]
    assert gone(root="/r/sub") == ["/r/sub/deep.md"]


def test_batch_equals_single_searches(spark, make_corpus):
    corpus = make_corpus(
        ("/d/alpha beta.md", "the quick-brown fox 東京タワー"), ("/d/b.md", "quick brown foxes alpha mp3x"), ("/d/c.txt", "brown quick 京都"),
        ("/d/beta.md", "---\ntitle: Alpha Beta\naliases: [fox den]\n---\nalpha fox"), ("/d/e.md", "song.mp3 東京都"), ("/d/f.md", None),
    ).indexed()
    asked = ["alpha beta", "quick-brown", "mp3", "東京", "fox -quick", "den", "ab", "the fox", "alpha", "a", "none here"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    columns = ["match_rank", "filename_match_level", "relevance_bucket"]
    got = {}
    for r in search_many(corpus, queries, as_of=AS_OF).collect():
        got.setdefault(r.query_id, []).append((r.position, r.file_id, *[r[c] for c in columns], round(r.score, 9)))
    for number, q in enumerate(asked):
        single = search(corpus, SearchRequest(q, as_of=AS_OF, include_snippets=False, target="all"))
        rows = single.matches.where("result_kind = 'file'").orderBy(*single.keys).collect()
        want = [(i, r.file_id, *[r[c] for c in columns], round(r.score, 9)) for i, r in enumerate(rows, start=1)]
        assert sorted(got.get(number, [])) == want, q


def test_batch_with_synonyms(spark, make_corpus):
    corpus = make_corpus(("/d/a.md", "automobile"), ("/d/b.md", "car"), ("/d/c.md", "bus")).indexed()
    rules = spark.createDataFrame([(0, 0, "Car"), (0, 1, "automobile")], "group_id int, position int, term string")
    queries = spark.createDataFrame([(1, "car")], "query_id int, q string")
    assert {r.file_id for r in search_many(corpus, queries, synonyms=rules).collect()} == {1, 2}
    assert synonym_groups("a, b，A\n\n c ") == (("a", "b"), ("c",))


def test_exclusion_rules(spark):
    cases = [
        ("/w/node_modules/a.md", ["node_modules"], True), ("/w/my-old-notes/a.md", ["OLD"], True), ("/w/older/a.md", ["old"], False),
        ("/w/.git/a", ["git"], True), ("/w/資料旧/a", ["旧"], True), ("/w/x/a.md", ["/w/x"], True), ("/w/xy/a.md", ["/w/x/"], False),
        ("/w/p/q/a.md", ["p/q"], True), ("/w/p/qq/a.md", ["p/q"], False), ("/w/foo/.cache/a", ["foo/."], True), ("/w/foo/b/a", ["foo/."], False),
        ("C:/x/y.md", ["C:\\x"], True), ("/w/X/a.md", ["/w/x"], False),
    ]
    for path, rules, expected in cases:
        got = spark.createDataFrame([(path,)], "p string").select(rl.excluded(F.col("p"), rules)).first()[0]
        assert got is expected, (path, rules)
    assert rl.parse_rules(" a \nA\n/x/Y\n/x/y\n\n") == ["a", "/x/Y", "/x/y"]


def test_paths(spark):
    raw = ["/a//b/./c/../d/", "C:\\x\\y", "\\\\srv\\share\\f", "rel/x", "/", "C:\\", "/..//a"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(raw)], "i int, p string").orderBy("i")
    got = [r[0] for r in rows.select(px.normalize_path(F.col("p"))).collect()]
    assert got == ["/a/b/d", "C:/x/y", "//srv/share/f", None, "/", "C:/", "/a"]
    assert px.path_prefix("/") == "/" and px.path_prefix("/a") == "/a/"


def test_numbers_are_consecutive(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    numbered = rk.number_rows(rows, [F.col("k")], "n").collect()
    assert sorted((r.n, r.k) for r in numbered) == [(i + 1, i) for i in range(1000)]
