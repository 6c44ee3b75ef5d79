"""Listings of folder trees with all their names, and streams of listings with state."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import maintain as mn
from lodestone.sources import documents as ds
from lodestone.sources import listing as ls
from lodestone.streaming import refresh as rf

NAMES = {
    "a.md": "hello", "_hidden.md": "x", ".dot.txt": "yy", "empty.md": "", "sub/_b.txt": "1", "sub/.deep/c.md": "22", "sub/.deep/more/d.md": "", "_folder/e.md": "333",
    "skip.bin": "0", "sub/UPPER.MD": "up", "ünï/f.md": "é",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in NAMES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8")
    (root / "link.md").symlink_to(root / "a.md")
    (root / "loop").symlink_to(root)
    (root / "nothing").mkdir()
    return str(root)


def below(df, root):
    return {r.normalized_path.removeprefix(root + "/"): r for r in df.collect()}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_all_names_are_listed(spark, tree, scheme):
    found = below(ds.list_files(spark, scheme + tree), tree)
    want = {n: c.encode() for n, c in NAMES.items() if not n.endswith(".bin")}
    assert {n: bytes(r.bytes) for n, r in found.items()} == want
    assert {n: r.size for n, r in found.items()} == {n: len(c) for n, c in want.items()}
    assert all(abs(r.mtime - os.stat(os.path.join(tree, n)).st_mtime) < 1e-3 for n, r in found.items())


def test_depth_rules_and_extensions(spark, tree):
    listed = lambda **o: set(below(ds.list_files(spark, tree, with_bytes=False, **o), tree))
    assert listed(depth=0) == {"a.md", "_hidden.md", ".dot.txt", "empty.md"}
    assert "sub/.deep/c.md" in listed(depth=2) and "sub/.deep/more/d.md" not in listed(depth=2)
    assert listed(extensions=[".txt"]) == {".dot.txt", "sub/_b.txt"}
    assert not [n for n in listed(rules=["deep"]) if "deep" in n]


@pytest.mark.parametrize("partitions", [1, 3, 100])
def test_partitions_are_folders(spark, tree, partitions):
    reader = ls.FolderReader({"path": tree, "partitions": str(partitions)})
    parts = reader.partitions()
    assert len(parts) >= min(partitions, 6)
    names = [p for part in parts for b in reader.read(part) for p in b.column("path").to_pylist()]
    assert sorted(n.removeprefix(tree + "/") for n in names) == sorted(NAMES)
    for depth in range(4):
        reader = ls.FolderReader({"path": tree, "partitions": str(partitions), "depth": str(depth)})
        names = {p.removeprefix(tree + "/") for part in reader.partitions() for b in reader.read(part) for p in b.column("path").to_pylist()}
        assert names == {n for n in NAMES if n.count("/") <= depth}
    assert ls.listing(spark, tree, partitions=partitions).count() == len(NAMES)


def test_missing_roots_are_empty(spark, tree):
    assert ls.listing(spark, tree + "/nowhere").count() == 0 and ls.listing(spark, tree + "/nothing").count() == 0


def test_a_vanished_file_has_no_bytes(spark):
    rows = spark.createDataFrame([("/no/such/file",)], "path string")
    assert ls.with_bytes(rows).first().bytes is None


# --- streams of listings -----------------------------------------------------------

START = datetime(2024, 1, 1)
LAYOUT = "normalized_path string, mtime double, size bigint, listed_at timestamp"


class Listings:
    """A folder that listings arrive in, and one that the stream writes to; each run goes on from the checkpoint."""

    def __init__(self, spark, root):
        self.spark, self.root, self.count = spark, root, 0

    def arrive(self, minute, files):
        rows = [(p, float(m), s, START + timedelta(minutes=minute)) for p, (m, s) in files.items()]
        self.spark.createDataFrame(rows, LAYOUT).coalesce(1).write.parquet(f"{self.root}/in/{self.count}")
        self.count += 1

    def run(self):
        stream = self.spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{self.root}/in")
        writer = rf.path_changes(stream, "15 minutes").writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/check")
        writer.trigger(availableNow=True).start().awaitTermination()
        told = self.spark.read.schema(rf.CHANGES).parquet(f"{self.root}/out")
        return {(r.normalized_path, r.change, round((r.listed_at - START).total_seconds() / 60)) for r in told.collect()}


def test_listings_keep_state_over_restarts(spark, tmp_path):
    stream = Listings(spark, str(tmp_path))
    stream.arrive(0, {"/a": (1, 1), "/b": (1, 1), "/c": (1, 1)})
    first = {("/a", "new", 0), ("/b", "new", 0), ("/c", "new", 0)}
    assert stream.run() == first
    stream.arrive(10, {"/a": (1, 1), "/b": (2, 1), "/d": (1, 1)})
    second = first | {("/a", "unchanged", 10), ("/b", "changed", 10), ("/d", "new", 10)}
    assert stream.run() == second  # a new query on the old checkpoint
    stream.arrive(20, {"/a": (1, 5), "/b": (2, 1), "/d": (1, 1)})
    third = second | {("/a", "changed", 20), ("/b", "unchanged", 20), ("/d", "unchanged", 20), ("/c", "gone", 15)}
    assert stream.run() == third and stream.run() == third
    stream.arrive(22, {"/c": (1, 1)})
    assert stream.run() == third | {("/c", "new", 22)}


def test_stream_totals_equal_the_batch_diff(spark, tmp_path):
    old = {f"/f{k}": (k % 5, k % 3) for k in range(60)}
    new = {p: ((m + 1, s) if p.endswith("3") else (m, s)) for p, (m, s) in old.items() if not p.endswith("7")} | {"/x": (1, 1)}
    stream = Listings(spark, str(tmp_path))
    for minute, files in ((0, old), (10, new), (20, new)):
        stream.arrive(minute, files)
    told = {}
    for path, change, minute in stream.run():
        if minute == 10 or change == "gone":
            told[path] = "missing" if change == "gone" else change
    as_df = lambda files: spark.createDataFrame([(p, float(m), s) for p, (m, s) in files.items()], "normalized_path string, mtime double, size bigint")
    diff = mn.diff_snapshot(as_df(old).withColumn("last_error", F.lit(None).cast("string")), as_df(new))
    assert told == {r.normalized_path: r.change for r in diff.collect()}


def test_paths_share_calls_of_a_worker(spark, tmp_path, monkeypatch):
    """Thousands of paths are a few groups; each is judged by itself and is gone by itself."""
    monkeypatch.setattr(rf, "GROUPS", 4)
    monkeypatch.setattr(rf.path_changes, "__defaults__", ("1 hour", "0 seconds", 4))
    stream = Listings(spark, str(tmp_path))
    files = {f"/f{k}": (k, k) for k in range(2_000)}
    stream.arrive(0, files)
    stream.arrive(10, {p: v for p, v in files.items() if not p.endswith("7")})
    stream.arrive(20, {p: v for p, v in files.items() if not p.endswith(("7", "8"))})
    stay = [p for p in files if not p.endswith(("7", "8"))]
    want = {(p, "new", 0) for p in files} | {(p, "unchanged", m) for p in stay for m in (10, 20)}
    want |= {(p, "unchanged", 10) for p in files if p.endswith("8")} | {(p, "gone", 15) for p in files if p.endswith("7")}
    assert stream.run() == want
    stream.arrive(26, {"/f0": (0, 0)})
    assert stream.run() == want | {("/f0", "unchanged", 26)} | {(p, "gone", 25) for p in files if p.endswith("8")}
