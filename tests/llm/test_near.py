"""Near-duplicates against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import near


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(keys, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    group = {}
    for i in range(len(fps)):
        group.setdefault(find(i), []).append(keys[i])
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in group.items()}
    return [least[find(i)] for i in range(len(fps))]


TEXTS = [
    "", None, "  \t\n", "one", "ONE", "one two", "one two three", "One  TWO\nthree", "É é x y", "é é x y", "a\x1cb c d e",
    "the quick brown fox jumps over the lazy dog " * 30, "the quick brown fox jumps over the lazy dog " * 30 + "end", "x " * 5000,
]


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in TEXTS:
        assert near.fingerprint(text or "") == plain_fingerprint(text or "")


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 60), dtype=np.uint64)
    members = np.unique(np.concatenate([base, *(base ^ f for f in flips[:20]), *(base ^ f ^ g for f, g in zip(flips[:20], flips[20:]))]))
    rank = members.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    members = members[np.argsort(rank)]
    index = near.Index(members)
    queries = np.concatenate([base, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    found = set()
    for q, m in index.search(queries, 2, np.full(len(queries), -1)):
        found |= set(zip(q.tolist(), m.tolist(), strict=True))
    far = np.bitwise_count(queries[:, None] ^ members)
    assert found == set(zip(*(x.tolist() for x in np.nonzero(far <= 2)), strict=True))
    index.link(2)
    assert [members[i] for i in index.label] == [members[i] for i in _labels(members)]


def _labels(members):
    ids = plain_components(list(range(len(members))), [int(m) for m in members])
    return ids


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for g in range(12):
        base = list(rng.choice(words, 400))
        for c in range(8):
            copy = list(base)
            for _ in range(c // 2):
                copy[int(rng.integers(0, 400))] = "changed"
            rows.append((1000 - g * 8 - c, " ".join(copy)))
    rows += [rows[20], rows[20], (None, rows[30][1]), (None, "alone in the world")]
    return spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id bigint, text string, source string"), rows


def test_components_equal_brute_force(docs):
    df, rows = docs
    fps = [plain_fingerprint(t or "") for _, t in rows]
    want = sorted(zip((str(k) for k, _ in rows), (f"{f:016x}" for f in fps), map(str, plain_components([k for k, _ in rows], fps)), strict=True))
    got = near.components(df).select("doc_id", near.hex_of("fp"), "component_id", "source").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert {r.source for r in got} == {"s"}


def test_representatives_keep_one_row_of_each_component(docs):
    df, rows = docs
    fps = [plain_fingerprint(t or "") for _, t in rows]
    comps = plain_components([k for k, _ in rows], fps)
    got = near.representatives(df)
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == len({c if c is not None else t for c, (_, t) in zip(comps, rows, strict=True)})
    assert sorted(k for k in kept if k is not None) == sorted({c for c in comps if c is not None})


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near.components(empty).count() == 0
    assert near.representatives(empty).count() == 0
    with pytest.raises(ValueError):
        near.components(empty.withColumn("fp", F.lit(1)))


def test_connect_long_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(40)]
    roots = {r.node: r.root for r in near.connect(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert roots == {**{i: 0 for i in range(51)}, 100: 100, **{200 + i: 100 for i in range(40)}}


def test_likeness_links_what_fingerprints_miss(spark):
    rng = np.random.default_rng(8)
    rows = [(0, None), (1, ""), (2, "two words"), (3, "two WORDS")]
    for g in range(20):
        base = [f"w{i}" for i in rng.integers(0, 3000, 300)]
        for c in range(6):
            copy = list(base)
            for k in rng.choice(300, (0, 1, 4, 6, 9, 25)[c], replace=False):
                copy[k] = f"changed{c}"
            rows.append((10 * g + 10 + c, " ".join(copy)))
    sets = [set(near.shingles(t or "", 5)) for _, t in rows]
    label = plain_components(list(range(len(rows))), [plain_fingerprint(t or "") for _, t in rows])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    least = {x: min(k for (k, _), y in zip(rows, label, strict=True) if y == x) for x in label}
    found = {r.doc_id: r.component_id for r in near.components(df, likeness=0.8).collect()}
    assert found == {k: least[x] for (k, _), x in zip(rows, label, strict=True)}
    assert {r.doc_id for r in near.representatives(df, likeness=0.8).collect()} == set(least.values())
    assert near.representatives(df).count() > len(least)
    assert near.representatives(df.limit(0), likeness=0.8).count() == 0


def family(n, changes, length=200):
    """Texts that share a base, each with so many words of its own."""
    rng = np.random.default_rng(n)
    base = [f"w{i}" for i in range(length)]
    rows = []
    for c in range(n):
        copy = list(base)
        for k in rng.choice(length, changes, replace=False):
            copy[k] = f"own{c}x{k}"
        rows.append((c, " ".join(copy)))
    return rows


def test_pairs_of_a_family_grow_with_the_texts(spark):
    """Texts that share many bands but don't reach the likeness: pairs are linear, not all of them."""
    counts = []
    for n in (600, 1200, 2400):
        rows = family(n, 5)
        sets = near.like_marks(spark.createDataFrame(rows, "doc_id bigint, text string"), "text")
        named = sets.select(F.col("_set").alias("id"), F.col("_sketch").alias("sketch"), F.col("_buckets").alias("buckets"))
        counts.append(near.paired(named)[0].count())
    assert counts[1] <= 2.4 * counts[0] and counts[2] <= 2.4 * counts[1] and counts[2] < 200 * 2400 < 2400 * 2399 / 2


def test_a_family_around_one_text_is_found(spark):
    """Copies that reach the likeness with their source only, in buckets that don't make all pairs."""
    rows = [(10_000, " ".join(f"w{i}" for i in range(200))), *family(300, 4)]
    found = near.components(spark.createDataFrame(rows, "doc_id bigint, text string"), likeness=0.8).collect()
    sets = {k: set(near.shingles(t, 5)) for k, t in rows}
    reach = [k for k in sets if len(sets[k] & sets[10_000]) >= 0.8 * len(sets[k] | sets[10_000])]
    least = min(r.component_id for r in found)
    assert len(reach) > 250 and sum(r.component_id == least for r in found if r.doc_id in reach) >= 0.99 * len(reach)


def test_large_buckets_leave_nothing_out(spark, monkeypatch):
    """Members that neither hubs nor neighbours bring together meet at last, in any blocks."""
    rows = [(10_000, " ".join(f"w{i}" for i in range(200))), *family(40, 4)]
    rows += [(k + 500, t.replace("w", "v")) for k, t in family(30, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r.doc_id: r.component_id for r in near.components(df, likeness=0.8).collect()}
    monkeypatch.setattr(near, "FULL", 1)
    monkeypatch.setattr(near, "HUBS", 0)
    monkeypatch.setattr(near, "BLOCK", 7)
    monkeypatch.setattr(near, "_neighbours", lambda large: large.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b")))
    assert {r.doc_id: r.component_id for r in near.components(df, likeness=0.8).collect()} == want
    assert len(set(want.values())) < len(rows) / 2


def test_members_that_are_not_alike_make_no_rows_of_pairs(spark, monkeypatch):
    """Late members become as many rows as they have buckets; the links are those of brute force, whatever the blocks."""
    monkeypatch.setattr(near, "FULL", 1)
    counts = []
    for n in (100, 200):
        rows = [*family(n, 5), *((k + 10_000, t) for k, t in family(30, 2))]
        marks = near.like_marks(spark.createDataFrame(rows, "doc_id bigint, text string"), "text")
        sets = near.kept(marks.select(F.col("_set").alias("id"), "fp", F.col("_hint").alias("hint"), F.col("_sketch").alias("sketch"), F.col("_buckets").alias("buckets")))
        rest = near.unmet(sets, spark.createDataFrame([], "node bigint, root bigint"))
        counts.append(rest.count())
    assert counts[1] <= 230 * near.BANDS and counts[1] <= 2.6 * counts[0]
    hashes = near.shingle_sets(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", sets.select("id", "hint"))
    whole = near.kept(sets.drop("hint").join(hashes, "id"))
    alone = {r.fp: set(r.buckets) for r in whole.select("fp", "buckets").collect()}
    shingles = {r.fp: set(memoryview(bytes(r.hashes)).cast("Q")) for r in whole.select("fp", "hashes").collect()}
    pairs = [(a, b) for a in alone for b in alone if a < b and alone[a] & alone[b] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    want = {r.node: r.root for r in near.connect(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    for block, size in ((256, 1 << 23), (7, 1 << 23), (256, 1 << 14)):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "BLOCK_BYTES", size)
        found = near.late_links(rest, whole, 0.8)
        assert {r.node: r.root for r in near.connect(found).collect()} == want
    assert len(pairs) > 20


def test_marks_clash(spark):
    with pytest.raises(ValueError, match="_set"):
        near.components(spark.createDataFrame([], "doc_id bigint, text string, _set binary"), likeness=0.8)
    odd = spark.createDataFrame([(1, "one text", b"x", 5), (2, "one text", b"y", 6)], "doc_id bigint, text string, _hash binary, _key int")
    assert [tuple(r) for r in near.representatives(odd, likeness=0.8).collect()] == [(1, "one text", b"x", 5)]
