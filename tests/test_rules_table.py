"""Rule tables against the rules as columns; readers in SQL; statistics observed in passing."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import refresh
from lodestone.functions import rules as rl
from lodestone.operators import exclusions as ec
from lodestone.operators import extract as ex
from lodestone.operators import reports as rp

PARTS = ["src", "node_modules", ".git", "旧版", "Foo", "a-b", "x.md", "build", "é", "tmp", "..", "C:", "old", ".Old"]
RULES = ["node_modules", ".git", "旧", "foo", "md", "/src/build", "build/tmp", "tmp/.", "/tmp/.", "C:/src", "É", "OLD", "/", "a-b", "src\\tmp", "x.md/", "C:\\old"]


@pytest.mark.parametrize("seed", range(4))
def test_tables_mean_what_columns_mean(spark, seed):
    rng = random.Random(seed)
    paths = ["/".join(["", *(rng.choice(PARTS) for _ in range(rng.randint(0, 5)))]) for _ in range(150)]
    paths += ["/".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["\\src\\build\\x.md", "", "/", "C:\\src\\a"]
    rules = rng.sample(RULES, rng.randint(1, 9))
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    table = spark.createDataFrame([(r,) for r in [*rules, rules[0], None]], "rule string")
    got = {r.path: r.excluded for r in ec.matched(df, table, F.col("path")).collect()}
    want = {r.path: bool(r.want) for r in df.select("path", rl.excluded(F.col("path"), rules).alias("want")).collect()}
    assert got == want, rules
    urls = {r.path: r.excluded for r in ec.matched(df, table, F.col("path"), "part").collect()}
    assert urls == {r.path: bool(r.want) for r in df.select("path", rl.excluded_url(F.col("path"), rules).alias("want")).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_tables_beyond_a_task_mean_the_same(spark, monkeypatch, seed):
    rng = random.Random(seed)
    paths = ["/".join(["", *(rng.choice(PARTS) for _ in range(rng.randint(0, 5)))]) for _ in range(150)]
    paths += ["/".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["\\src\\build\\x.md", "", "/", "C:\\src\\a", "a//tmp/.x", "/a", "a//b"]
    rules = [*(RULES if seed else rng.sample(RULES, 9)), *(["//", "", "/.", " a "] if seed else [])]
    df = spark.createDataFrame([(p,) for p in [*paths, paths[0]]] + [(None,)], "path string")
    table = spark.createDataFrame([(r,) for r in [*rules, rules[0], None]], "rule string")
    for kind in ("path", "part"):
        monkeypatch.undo()
        want = sorted(((r.path, r.excluded) for r in ec.matched(df, table, F.col("path"), kind).collect()), key=str)
        monkeypatch.setattr(ec, "MOST_RULES", 7)
        assert sorted(((r.path, r.excluded) for r in ec.matched(df, table, F.col("path"), kind).collect()), key=str) == want


def test_rules_of_each_root(spark, monkeypatch):
    df = spark.createDataFrame([("/a/tmp/x", "/a"), ("/b/tmp/x", "/b"), ("/c/tmp", None)], "path string, root string")
    table = spark.createDataFrame([("/a", "tmp"), ("/b", "other"), (None, "tmp")], "root string, rule string")
    assert [r.excluded for r in ec.matched(df, table, F.col("path"), root=F.col("root")).collect()] == [True, False, True]
    assert [r.excluded for r in ec.matched(df, table.limit(0), F.col("path"), root=F.col("root")).collect()] == [False] * 3
    monkeypatch.setattr(ec, "MOST_RULES", 2)
    with pytest.raises(ValueError, match="3 rules"):
        ec.matched(df, table, F.col("path"), root=F.col("root"))


# --- readers in SQL -----------------------------------------------------------


def test_pieces_and_errors_of_each_file(spark):
    def halves(data):
        yield data[:2].decode()
        if len(data) < 4:
            raise ValueError("too short")
        yield data[2:].decode()

    ex.piece_function(spark, "pieces_of", {"half": halves, ".bad": lambda data: 1 / 0})
    rows = [("a.half", b"abcd"), ("b.half", b"abc"), ("c.bad", b"x"), ("d.nope", b"x"), ("e.txt", b"plain \xff"), ("f.half", None), ("g.json", b'{"k": ["v", 2]}'), (None, b"x")]
    spark.createDataFrame(rows, "name string, data binary").createOrReplaceTempView("inputs")
    found = spark.sql("select name, p.* from inputs, lateral pieces_of(name, data) p").collect()
    got = {}
    for r in found:
        got.setdefault(r.name, []).append((r.piece, r.text, r.error))
    assert got["a.half"] == [(0, "ab", None), (1, "cd", None)] and got["b.half"] == [(0, "ab", None), (1, None, "too short")]
    assert got["c.bad"] == [(0, None, "division by zero")] and got["d.nope"][0][2] == "no reader for d.nope" and "f.half" not in got
    assert got["e.txt"][0][1].startswith("plain ") and got["g.json"] == [(0, "v\n2", None)] and got[None][0][2] == "no reader for None"


# --- statistics ------------------------------------------------------------------


def test_a_refresh_counts_itself(spark, make_corpus):
    corpus = make_corpus(("/d/same.txt", "a"), ("/d/touched.txt", "b"), ("/d/gone.txt", "c"))
    rows = [("/d/same.txt", 1_700_000_000.0, 1, b"a"), ("/d/touched.txt", 5.0, 1, b"b"), ("/d/new.txt", 5.0, 1, b"n"), ("/d/new.pdf", 5.0, 1, b"n")]
    listing = spark.createDataFrame(rows, "normalized_path string, mtime double, size bigint, bytes binary")
    listing = listing.select("*", F.element_at(F.split("normalized_path", "/"), -1).alias("file_name"), F.col("mtime").alias("created_at"))
    done = refresh(corpus, listing, "/d", 9.0)
    assert tuple(done.statistics.first()) == (4, 2, 1, 1, 1)
    failed = done.corpus.failures
    assert tuple(rp.run_statistics(done.diff, failed).first()) == (4, 2, 1, 1, 1)
    again = refresh(done.corpus, listing.limit(0), "/d", 10.0, delete_missing=False)
    assert tuple(again.statistics.first()) == (0, 0, 0, 0, 0)
