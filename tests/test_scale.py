"""Roots by stepping up paths, folder digests, crawls of many roots: against the plain forms, and their plans."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as ix
from lodestone.operators import links as lk
from lodestone.operators import maintain as mn
from lodestone.operators import scope as so

ROOTS = [("/", "local", False), ("/a", "local", True), ("/a/b/", "local", True), ("/a/b/c", "local", False), ("/x", "web", True), ("/d", "local", True)]
PATHS = ["/a", "/a/", "/a/b", "/a/b/c/d", "/ab", "/x/y", "/", "/d/e", None, "rel/a", "/a/b/c"]


@pytest.fixture(scope="module")
def tables(spark):
    targets = spark.createDataFrame(ROOTS, "full_path string, source_type string, is_enabled boolean")
    paths = spark.createDataFrame([(p, s) for p in PATHS for s in ("local", "web", None)], "path string, source_type string")
    return paths, targets


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_covering_root_moves_no_path(tables, monkeypatch):
    paths, targets = tables
    found = so.covering_root(paths, targets)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
    got = rows(found.select("path", "source_type", "covering_root", "is_covered"))
    monkeypatch.setattr(so, "MOST_ROOTS", 1)
    assert rows(so.covering_root(paths, targets).select("path", "source_type", "covering_root", "is_covered")) == got
    by_path = {(p, s): r for p, s, r, _ in got}
    assert by_path["/a/b/c/d", "local"] == "/a/b/" and by_path["/ab", "local"] is None and by_path["/x/y", "web"] == "/x" and by_path[None, "local"] is None


def test_overlapping_roots_by_either_join(tables, monkeypatch):
    paths, targets = tables
    got = rows(so.overlapping_roots(paths.select("path"), targets))
    monkeypatch.setattr(so, "MOST_ROOTS", 1)
    assert rows(so.overlapping_roots(paths.select("path"), targets)) == got
    assert ("/a/b/c/d", "/a") in got and ("/", "/d") in got and not [g for g in got if g[0] == "/ab" and g[1] != "/"]


# --- digests ---------------------------------------------------------------------

FILE = "normalized_path string, mtime double, size bigint, last_error string"


def tree(rng, count=400):
    return {f"/r{rng.randrange(3)}/f{rng.randrange(12)}/g{rng.randrange(3)}/n{k}.md": (float(rng.randrange(50)), rng.randrange(9), None) for k in range(count)}


@pytest.mark.parametrize("seed", range(3))
def test_digest_diff_equals_the_plain_one(spark, seed):
    rng = random.Random(seed)
    old = tree(rng)
    new = dict(old)
    for path in rng.sample(sorted(old), 6):
        new.pop(path)
    for path in rng.sample(sorted(new), 6):
        new[path] = (new[path][0] + 1, *new[path][1:])
    new["/r0/f1/new.md"] = (1.0, 1, None)
    new["/top.md"] = (0.0, 1, None)
    for path in rng.sample(sorted(old), 2):
        old[path] = (*old[path][:2], "broken")
    as_df = lambda files: spark.createDataFrame([(p, *v) for p, v in files.items()], FILE)
    existing, listing = as_df(old), as_df(new).drop("last_error")
    assert rows(mn.digest_diff(existing, listing)) == rows(mn.diff_snapshot(existing, listing))


def test_rows_of_equal_folders_are_not_joined(spark):
    old = tree(random.Random(7))
    changed = sorted(old)[0]
    new = {**old, changed: (99.0, 1, None)}
    as_df = lambda files: spark.createDataFrame([(p, *v) for p, v in files.items()], FILE)
    folders = {r.folder for r in mn.differing_folders(as_df(old), as_df(new)).collect()}
    assert folders == {changed.rsplit("/", 1)[0]}
    assert mn.differing_folders(as_df(old), as_df(old)).isEmpty() and mn.differing_folders(as_df({}), as_df({})).isEmpty()
    assert mn.differing_folders(as_df({"/a/x": (-0.0, 1, None)}), as_df({"/a/x": (0.0, 1, None)})).isEmpty()
    # what moves to another folder changes both
    moved = {("/r9/" + changed.rsplit("/", 1)[1] if p == changed else p): v for p, v in old.items()}
    assert {r.folder for r in mn.differing_folders(as_df(old), as_df(moved)).collect()} == {changed.rsplit("/", 1)[0], "/r9"}


# --- crawl -----------------------------------------------------------------------


def plain_crawl(links, roots, depth, quota):
    found = set()
    for root in {r for r, _ in roots}:
        level = sorted({u for r, u in roots if r == root and "spam" not in u})
        seen = set()
        for d in range(depth + 1):
            level = sorted(set(level) - seen)[: None if quota is None else max(0, quota - len(seen))]
            seen |= set(level)
            found |= {(root, u, d) for u in level}
            level = sorted({t for s, t in links if s in level and "spam" not in t})
    return found


@pytest.mark.parametrize("quota, hub", [(None, 3), (7, 3), (1, 10_000), (40, 2)])
def test_many_roots_equal_one_by_one(spark, quota, hub):
    rng = random.Random(quota)
    urls = [f"u{k}" for k in range(60)] + ["spam1"]
    links = {(rng.choice(urls), rng.choice(urls)) for _ in range(150)} | {("u0", u) for u in urls}
    roots = [("a", "u0"), ("b", "u1"), ("b", "u2"), ("c", "spam1"), ("d", "nowhere")]
    edges, seeds = spark.createDataFrame(sorted(links), "src_url string, dst_url string"), spark.createDataFrame(roots, "root string, url string")
    got = {tuple(r) for r in lk.crawl_roots(edges, seeds, 4, ["spam"], quota, hub).collect()}
    assert got == plain_crawl(links, roots, 4, quota)


def test_a_crawl_ends_when_quotas_are_met(spark, monkeypatch):
    """On an endless chain two levels fill the quota; the others are never asked for."""
    chain = spark.range(500).select(F.concat(F.lit("p"), "id").alias("src_url"), F.concat(F.lit("p"), F.col("id") + 1).alias("dst_url"))
    seeds = spark.createDataFrame([("a", "p0"), ("b", "p9")], "root string, url string")
    rounds, plain = [], lk._first_of_each
    monkeypatch.setattr(lk, "_first_of_each", lambda *a: rounds.append(1) or plain(*a))
    found = lk.crawl_roots(chain, seeds, 400, max_pages=2)
    assert {tuple(r) for r in found.collect()} == {("a", "p0", 0), ("a", "p1", 1), ("b", "p9", 0), ("b", "p10", 1)}
    assert len(rounds) == 3


def test_hub_pages_lie_in_parts(spark):
    links = spark.range(1000).select(F.lit("hub").alias("src_url"), F.col("id").cast("string").alias("dst_url"))
    edges, hubs = lk.dealt_links(links, 100)
    assert hubs.collect()[0].parts == 10 and edges.select("part").distinct().count() == 10 and edges.count() == 1000


def test_postings_are_grouped_in_pieces(monkeypatch):
    """A batch of long token lists isn't grouped at once; the rows are the same in any pieces."""
    lists = [["a", "b", "a"], ["c"] * 50, ["", "a"], ["b"], ["a", "c"] * 4]
    columns = [pa.array(range(5)), pa.array([len(x) for x in lists], pa.int32()), pa.array(lists)]
    batch = pa.RecordBatch.from_arrays(columns, names=["file_id", "n_tokens", "tokens"])
    grouped = lambda: sorted((r["file_id"], r["term"], r["tf"], r["n_tokens"], r["positions"]) for b in ix._group_tokens(iter([batch])) for r in b.to_pylist())
    whole = grouped()
    assert (2, "a", 1, 2, [1]) in whole and (0, "a", 2, 3, [0, 2]) in whole
    monkeypatch.setattr(ix, "TOKENS_AT_ONCE", 4)
    assert [b.num_rows for b in ix._few_tokens(iter([batch]))] == [1, 1, 2, 1] and grouped() == whole


def test_bigrams_are_counted_where_their_body_is(spark):
    """Bi-grams don't become rows that are shuffled; the results are those of the SQL."""
    from workload.catalog import ORACLE, QUERIES
    from workload.check import compare, connect

    data = "/root/testdata/sf0.001"
    plan = QUERIES["cjk_bigrams"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan
    assert compare(spark, connect(data), data, QUERIES["cjk_bigrams"], ORACLE["cjk_bigrams"])[0]
