"""SimHash near-duplicates, linked by a hierarchical index over Gray-ordered fingerprints.

``fingerprints`` adds the 64-bit majority fingerprint of the three-word shingles of a text.
``components`` links distinct fingerprints that differ in at most ``RADIUS`` bits and names the
component of each row; ``representatives`` keeps one row of each component.

The index: distinct fingerprints are sorted by Gray rank, so that neighbours differ in few bits,
and cut into contiguous top groups, one for each range partition. A group is described by the bits
on which all its members agree (``bit_and`` and ``bit_or``), found by Spark. The table of top
groups is bounded by ``MAX_GROUPS`` rows and sent to all tasks; every fingerprint then visits only
those groups before its own that the differences on their common bits don't rule out. In a group,
nodes of ``FANOUT`` members, of ``FANOUT`` such nodes and so on hold the bits that are common below
and not already above; a search adds up differences from the root down and drops a whole subtree
once they exceed the radius. Members and visitors stream through a task, members first. Dense
groups don't make all their pairs: a subtree that is already one component with the asking
fingerprint is skipped, and a visitor brings back one edge for each component it meets.

The edges, at fingerprint level, are joined to components by star contraction in Spark.

With a ``likeness``, texts that have so much of their shingles of ``LIKE_WIDTH`` words in common
(shared to all distinct ones) are linked as well; two bits of the fingerprint reach few of them, and
at the distance of a likeness of 0.8 (17 bits seen) the index can't prune. Candidates agree on the
least hashes of all permutations in one of ``BANDS`` bands, which a pair of likeness 0.8 misses in
one of ten thousand cases. At first their number is linear in the texts, whatever a bucket holds: small buckets make all
pairs; in large ones each member meets the few that have most company, which is what many are copies of, and
its neighbours in the order of the sketches of the next bands. Sketches (a byte of each least hash) drop most
pairs; every link that remains is verified on the 64-bit hashes of its shingles, unless both texts are
in one component by then. At last the members of large buckets that are in different components all meet, in
blocks that judge their pairs in place: few where a bucket is a family, all pairs of a bucket at worst, which no task holds as a whole.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and link
like any other; null keys take part, a component of null keys only has the id null; repeated rows
stay repeated; other columns pass through; a column named like an output raises ``ValueError``;
empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import kept, map_slices, text_or_empty
from lodestone.llm.contamination import WordHashes, shingle_hashes
from lodestone.session import scratch

WIDTH, RADIUS, SEED = 3, 2, 42
#: Words in a shingle that likeness is judged by, bands and permutations in a band.
LIKE_WIDTH, BANDS, ROWS = 5, 24, 5
#: Buckets of up to FULL members make all pairs; members of larger ones meet HUBS members and BESIDE neighbours.
FULL, HUBS, BESIDE = 16, 3, 2
#: Members of a large bucket, and bytes of their shingle sets, that meet as many others in one group, where they aren't in one component by then.
BLOCK, BLOCK_BYTES = 256, 1 << 23
#: Bits of the table that says which texts are wanted; digests that a task remembers.
HINT_BITS, DONE = 1 << 22, 100_000
FANOUT = 16
#: Top groups: at least MIN_GROUPS, more so that a group has at most GROUP_SIZE members, never more than MAX_GROUPS.
MIN_GROUPS, GROUP_SIZE, MAX_GROUPS = 64, 1 << 20, 4096
QUERIES_AT_ONCE, PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 2048, 1 << 16, 1 << 15


# -- fingerprints --------------------------------------------------------------------------------


def shingles(text: str, width: int = WIDTH) -> list[bytes]:
    """Word shingles of the text with A-Z in lower case; bytes split at ASCII white space only."""
    words = text.encode("utf-8").lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprint(text: str) -> int:
    """Unsigned: a bit is set where more than half of the shingle hashes have it."""
    found = shingles(text)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[start : start + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed bigint instead of the text."""
    if column in docs.columns:
        raise ValueError(f"the column {column} is the operator's")
    rest = [c for c in docs.columns if c != text]
    source = docs.select(*rest, text_or_empty(text).alias("_text"))
    names, at = [*rest, column], len(rest)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(values)], names=names)

    return map_slices(source, run, f"{schema}`{column}` bigint", at)


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# -- index ---------------------------------------------------------------------------------------


def gray_rank(column: Column) -> Column:
    """Place of a 64-bit word in Gray order, shifted so that signed order is the order of places."""
    for shift in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, shift))
    return column.bitwiseXOR(F.lit(-(1 << 63)))


class Index:
    """Tree over fingerprints in Gray order. ``levels[0]`` are the members, the last level is one root."""

    def __init__(self, members: np.ndarray):
        self.members = members
        full = ~np.uint64(0)
        ones, zeros = members.copy(), ~members  # bits set, bits unset in all below
        self.common, self.value = [np.full(len(members), full)], [members]
        while len(ones) > 1:
            starts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.common.append(ones | zeros)
            self.value.append(ones)
        # what a node adds to its parent
        self.own = [c & ~self.common[k + 1][np.arange(len(c)) // FANOUT] for k, c in enumerate(self.common[:-1])] + [self.common[-1]]
        self.label = np.arange(len(members))

    def root(self, x: int) -> int:
        while self.label[x] != x:
            x = int(self.label[x])
        return x

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Makes the labels of a and b one. Labels are flat before and after."""
        pairs = np.unique(np.stack([self.label[a], self.label[b]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if not len(pairs):
            return
        for x, y in pairs.tolist():
            x, y = self.root(x), self.root(y)
            self.label[max(x, y)] = min(x, y)
        while not np.array_equal(flat := self.label[self.label], self.label):
            self.label = flat

    def leaf_labels(self) -> np.ndarray:
        """The label of each lowest group if its members share one, else -1."""
        starts = np.arange(0, len(self.label), FANOUT)
        least, most = np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts)
        return np.where(least == most, least, -1)

    def search(self, queries: np.ndarray, radius: int, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) positions within the radius, in pieces. ``same``: a label of each query (or -1)
        whose uniform groups need no search; the caller may change it and ``label`` between pieces."""
        top = len(self.common) - 1
        start = np.bitwise_count((queries ^ self.value[top][0]) & self.own[top][0]).astype(np.int16)
        near = np.flatnonzero(start <= radius)
        stack = [(top, near, np.zeros(len(near), np.int64), start[near])]
        while stack:
            level, q, node, used = stack.pop()
            if not len(q):
                continue
            if level == 0:
                yield q, node
                continue
            if len(q) > PAIRS_AT_ONCE:
                stack += [(level, q[i : i + PAIRS_AT_ONCE], node[i : i + PAIRS_AT_ONCE], used[i : i + PAIRS_AT_ONCE]) for i in range(0, len(q), PAIRS_AT_ONCE)]
                continue
            if level == 1:
                leaf = self.leaf_labels()[node]
                other = (leaf < 0) | (leaf != same[q])
                q, node, used = q[other], node[other], used[other]
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            q, used = np.repeat(q, FANOUT), np.repeat(used, FANOUT)
            there = child < len(self.common[level - 1])
            child, q, used = child[there], q[there], used[there]
            used = used + np.bitwise_count((queries[q] ^ self.value[level - 1][child]) & self.own[level - 1][child])
            near = used <= radius
            stack.append((level - 1, q[near], child[near], used[near]))

    def link(self, radius: int) -> None:
        """Labels of the members' own components."""
        for start in range(0, len(self.members), QUERIES_AT_ONCE):
            block = np.arange(start, min(start + QUERIES_AT_ONCE, len(self.members)))
            same = self.label[block].copy()
            for q, m in self.search(self.members[block], radius, same):
                self.union(block[q], m)
                same[:] = self.label[block]

    def visit(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, component's first member) for each component that a visitor meets, each once."""
        pairs: set[tuple[int, int]] = set()
        same = np.full(len(queries), -1)
        for q, m in self.search(queries, radius, same):
            same[q] = self.label[m]
            pairs.update(map(tuple, np.unique(np.stack([q, self.label[m]], axis=1), axis=0).tolist()))
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def _grouped(distinct: DataFrame) -> DataFrame:
    """(fp, rank, grp): contiguous top groups in Gray order, kept so that they stay as they are."""
    count = distinct.count()
    groups = min(MAX_GROUPS, max(MIN_GROUPS, -(-count // GROUP_SIZE)))
    ranked = distinct.withColumn("rank", gray_rank(F.col("fp")))
    return kept(ranked.repartitionByRange(groups, "rank").withColumn("grp", F.spark_partition_id()))


def edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of linked fingerprints in ``distinct`` (fp), enough of them to connect every component."""
    grouped = _grouped(distinct)
    tops = grouped.groupBy("grp").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some")).collect()  # <= MAX_GROUPS rows
    ids = np.array([t.grp for t in tops], np.int64)
    ones = np.array([t.ones for t in tops], np.int64).view(np.uint64)
    common = ones | ~np.array([t.some for t in tops], np.int64).view(np.uint64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(start, QUERIES_AT_ONCE)
                fp, rank, own = (part.column(c).to_numpy() for c in ("fp", "rank", "grp"))
                far = np.bitwise_count((fp.view(np.uint64)[:, None] ^ ones) & common)
                row, group = np.nonzero((far <= radius) & (ids <= own[:, None]))
                kind = (ids[group] != own[row]).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[group].astype(np.int32)), pa.array(kind), pa.array(rank[row]), pa.array(fp[row])], names=["grp", "kind", "rank", "fp"]
                )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, index = None, [], None

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def build() -> tuple[Index, pa.RecordBatch]:
            made = Index(np.concatenate(members))
            made.link(radius)
            moved = np.flatnonzero(made.label != np.arange(len(made.label)))
            return made, out(made.members[moved], made.members[made.label[moved]])

        for batch in batches:
            grp, kind = batch.column("grp").to_numpy(), batch.column("kind").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            turns = np.flatnonzero((np.diff(grp) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip([0, *turns], [*turns, len(grp)], strict=True):
                if start == end:
                    continue
                if grp[start] != group:
                    if members and index is None:
                        yield build()[1]
                    group, members, index = grp[start], [], None
                if kind[start] == 0:
                    members.append(fp[start:end])
                    continue
                if index is None:
                    index, own = build()
                    yield own
                for at in range(start, end, QUERIES_AT_ONCE):
                    visitors = fp[at : min(end, at + QUERIES_AT_ONCE)]
                    q, m = index.visit(visitors, radius)
                    yield out(visitors[q], index.members[m])
        if members and index is None:
            yield build()[1]

    routed = grouped.mapInArrow(route, "grp int, kind tinyint, rank bigint, fp bigint")
    dealt = routed.repartition(2 * len(tops) or 1, "grp").sortWithinPartitions("grp", "kind", "rank")
    return dealt.mapInArrow(find, "a bigint, b bigint")


# -- components ----------------------------------------------------------------------------------


def connect(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with the smallest node of its component.

    Star contraction: each round hangs the larger neighbours of a node on its least neighbour, then
    the smaller ones, until nothing moves. Only minima are gathered, so a node may have any degree.
    """
    with scratch(links.sparkSession) as stays:
        return stays(_contracted(links))


def _contracted(links: DataFrame) -> DataFrame:
    both = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        ways = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        both = kept(small.unionByName(down.withColumnRenamed("m", "b")).distinct())
        now = both.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return both.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(both.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


# -- likeness ------------------------------------------------------------------------------------


def like_hashes(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``LIKE_WIDTH`` words; a shorter text is one shingle."""
    words = np.fromiter(map(hashes.__getitem__, text.encode("utf-8").lower().split()), np.uint64)
    return np.unique(shingle_hashes(words, min(LIKE_WIDTH, len(words)))) if len(words) else words


def least_hashes(found: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The least hash under each permutation."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for start in range(0, len(found), 4096):
        least = np.minimum(least, ((found[start : start + 4096] ^ masks) * factors).min(axis=1))
    return least


def digest_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes(), SEED)


LIKE_COLUMNS = {"_set": "binary", "_hint": "bigint", "_sketch": "binary", "_buckets": "array<bigint>"}


def like_marks(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the fingerprint (fp) and marks of the shingle set instead of the text: digest, a hash of the text, sketch, buckets.

    The sketch has one byte of each least hash. The marks of a text without words are null.
    """
    rest = [c for c in docs.columns if c != text]
    source = docs.select(*rest, F.xxhash64(text_or_empty(text)).alias("_hint"), text_or_empty(text).alias("_text"))
    at, fields = len(rest), docs.select(*rest).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp bigint", *(f"{n} {t}" for n, t in LIKE_COLUMNS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, hashes = np.random.default_rng(SEED), WordHashes()
        factors = rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)
        masks = rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False)
        for batch in batches:
            fps, sets, sketches, buckets = [], [], [], []
            for value in batch.column(at + 1).to_pylist():
                fps.append(fingerprint(value))
                found = like_hashes(value, hashes)
                least = least_hashes(found, factors, masks)
                sets.append(digest_of(found) if len(found) else None)
                sketches.append((least >> np.uint64(56)).astype(np.uint8).tobytes() if len(found) else None)
                buckets.append([xxhash.xxh3_64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))] if len(found) else None)
            marks = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sets, pa.binary()), batch.column(at), pa.array(sketches, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *marks], names=[*rest, "fp", *LIKE_COLUMNS])

    return map_slices(source, run, schema, at + 1)


def _neighbours(large: DataFrame) -> DataFrame:
    """(a, b): members of a bucket that stand up to ``BESIDE`` places apart in the order of their sketches, from the next band on."""
    turned = F.concat(F.expr(f"substring(sketch, (band + 1) % {BANDS} * {ROWS} + 1)"), F.expr(f"substring(sketch, 1, (band + 1) % {BANDS} * {ROWS})"))
    ordered = large.select("bucket", F.substring(turned, 1, 4 * ROWS).alias("turned"), "id").repartitionByRange("bucket", "turned", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple[int, bytes]] = []
        for batch in batches:
            pairs = []
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs += [(other[1], row[1]) for other in last if other[0] == row[0]]
                last = [*last[-BESIDE + 1 :], row]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in range(2)], names=["a", "b"])

    return ordered.sortWithinPartitions("bucket", "turned", "id").select("bucket", "id").mapInArrow(run, "a binary, b binary")


def paired(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ``sets`` (id, sketch, buckets) that share a bucket, their number linear in the sets; (id, sketch) of those in any.

    In a bucket of up to ``FULL`` members all pairs are made. In a larger one each member meets the ``HUBS`` members that
    have the most company in all their buckets (what many are copies of) and its neighbours in the order of the sketches.
    """
    exploded = sets.select("id", F.posexplode("buckets").alias("band", "bucket"))
    counts = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = kept(exploded.join(counts, "bucket"))
    company = rows.groupBy("id").agg(F.sum("n").alias("company"))
    known = kept(sets.select("id", "sketch").join(company, "id"))
    small = rows.where(F.col("n") <= FULL).select("bucket", "id")
    pairs = small.select("bucket", F.col("id").alias("a")).join(small.select("bucket", F.col("id").alias("b")), "bucket").where("a < b").select("a", "b")
    large = kept(rows.where(F.col("n") > FULL).join(known, "id"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("company"), "id"))
    hubs = large.select("bucket", "id", "company").withColumn("place", place).where(F.col("place") <= HUBS)
    met = large.select("bucket", F.col("id").alias("a")).join(hubs.select("bucket", F.col("id").alias("b")), "bucket").where("a <> b").select("a", "b")
    every = pairs.unionByName(met).unionByName(_neighbours(large))
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), known


def candidates(sets: DataFrame, likeness: float) -> DataFrame:
    """(a, b, agree): pairs whose sketches agree in as many bytes as the likeness less four standard deviations lets expect."""
    pairs, known = paired(sets)
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(known.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    return kept(_agreeing(both, likeness))


def _agreement(likeness: float) -> float:
    """The bytes in which sketches agree, less four standard deviations."""
    return BANDS * ROWS * likeness - 4 * (BANDS * ROWS * likeness * (1 - likeness)) ** 0.5


def _agreeing(both: DataFrame, likeness: float) -> DataFrame:
    """(a, b, agree) of ``both`` (a, b, sa, sb): the pairs that the sketches don't rule out."""
    size, needed = BANDS * ROWS, _agreement(likeness)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, size) for k in (2, 3))
            agree = (one == other).sum(axis=1).astype(np.int32)
            part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree)], names=["a", "b", "agree"])
            yield part.filter(pa.array(agree >= needed))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, agree int")


def unmet(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, bucket, root, main) of the members of buckets of more than ``FULL`` members that aren't all in one component by now.

    ``sets``: id, fp, sketch, buckets; ``roots``: node, root. ``main`` is the bucket's largest component.
    """
    members = sets.join(roots, F.col("fp") == F.col("node"), "left").select("id", F.coalesce("root", "fp").alias("root"), F.explode("buckets").alias("bucket"))
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("bucket").agg(F.sum("n").alias("all"), F.count("*").alias("parts"), F.max(F.struct("n", "root"))["root"].alias("main"))
    return kept(members.join(sizes.where((F.col("all") > FULL) & (F.col("parts") > 1)).select("bucket", "main"), "bucket"))


def late_links(rest: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(a, b): fingerprints of members (``unmet``) of different components that have the likeness, one link for each two components and group.

    ``sets``: id, fp, sketch, buckets, hashes. Members outside of a bucket's largest component meet all others of the bucket, in
    groups of two blocks of up to ``BLOCK`` members and ``BLOCK_BYTES`` on average; the group judges its pairs in place,
    so neither they nor the sets of a pair become rows.
    """
    many = lambda which: F.greatest(F.ceil(F.sum(which) / BLOCK), F.ceil(F.sum(F.when(which > 0, F.length("hashes"))) / BLOCK_BYTES), F.lit(1)).cast("int")
    apart = (F.col("root") != F.col("main")).cast("int")
    placed = kept(rest.join(sets, "id").withColumn("apart", apart))
    blocks = placed.groupBy("bucket").agg(many(F.col("apart")).alias("few"), many(F.lit(1)).alias("whole"))
    dealt = placed.join(blocks, "bucket")
    of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    marks = ["id", "fp", "root", "sketch", "buckets", "hashes", "apart"]
    asking = dealt.where("apart = 1").select("bucket", of(F.col("few")).alias("i"), each("whole").alias("j"), F.lit(True).alias("asks"), *marks)
    asked = dealt.select("bucket", each("few").alias("i"), of(F.col("whole")).alias("j"), F.lit(False).alias("asks"), *marks)
    needed = _agreement(likeness)

    def judge(rows: pa.Table) -> pa.Table:
        bucket, asks = rows.column("bucket")[0].as_py(), rows.column("asks").to_numpy()
        ids, fps, apart = rows.column("id").to_pylist(), rows.column("fp").to_numpy(), rows.column("apart").to_numpy()
        label = rows.column("root").to_numpy().copy()
        sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = rows.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        held = rows.column("hashes").to_pylist()
        sizes = np.array([len(h) // 8 for h in held])
        words, codes = np.unique(np.frombuffer(b"".join(held), np.uint64), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(np.argsort(np.array(ids, object)))
        one, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        links, has = [], np.zeros(len(words), bool)
        for x in one:
            # two members outside of the main component meet twice; buckets that share a pair leave it to their first
            near = (label[other] != label[x]) & ((apart[other] == 0) | (order[x] < order[other]))
            near &= np.minimum(sizes[other], sizes[x]) >= likeness * np.maximum(sizes[other], sizes[x]) - 1e-9
            met = other[near]
            met = met[(sketches[met] == sketches[x]).sum(axis=1) >= needed]
            met = met[bands[x][(bands[met] == bands[x]).argmax(axis=1)] == bucket]
            has[codes[starts[x] : starts[x + 1]]] = True
            for y in met:
                if label[y] != label[x]:
                    shared = int(has[codes[starts[y] : starts[y + 1]]].sum())
                    if shared >= likeness * (sizes[x] + sizes[y] - shared) - 1e-9:
                        links.append((fps[x], fps[y]))
                        label[label == label[y]] = label[x]
            has[codes[starts[x] : starts[x + 1]]] = False
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return asking.unionByName(asked).groupBy("bucket", "i", "j").applyInArrow(judge, "a bigint, b bigint").distinct()


def shingle_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(id, hashes) of the sets ``wanted`` (id, hint), each once.

    Texts don't move: hints of what is wanted, as a table of ``HINT_BITS`` bits, tell each task which texts to read.
    """
    at = wanted.select(F.pmod("hint", F.lit(HINT_BITS)).cast("int").alias("at"))
    word = at.selectExpr("at div 64 as word", "shiftleft(1L, at % 64) as bit")
    found = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # <= HINT_BITS / 64 rows
    table = np.zeros(HINT_BITS // 64, np.int64)
    table[[r.word for r in found]] = [r.bits for r in found]
    packed = table.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = WordHashes(), set()
        for batch in batches:
            at = batch.column(0).to_numpy() % HINT_BITS
            hit = np.flatnonzero(packed[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))
            rows = []
            for value in batch.column(1).take(pa.array(hit)).to_pylist():
                values = like_hashes(value, hashes)
                key = digest_of(values)
                if key not in done:
                    rows.append((key, values.tobytes()))
                    done.add(key)
            if len(done) > DONE:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(2)], names=["id", "hashes"])

    source = docs.select(F.xxhash64(text_or_empty(text)).alias("hint"), text_or_empty(text).alias("text"))
    made = map_slices(source, run, "id binary, hashes binary", 1)
    return kept(made.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]))


def _alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (id, hashes) have the likeness."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, other = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                shared = len(np.intersect1d(one, other, assume_unique=True))
                alike.append(shared >= likeness * (len(one) + len(other) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return map_slices(both.select("a", "b", "ha", "hb"), run, "a binary, b binary", 2)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further ``links`` (a, b): only the new links are contracted, over the roots known so far."""
    name = lambda side: F.coalesce(F.col(f"r{side}.root"), F.col(side))
    over = links.join(roots.alias("ra"), F.col("ra.node") == F.col("a"), "left").join(roots.alias("rb"), F.col("rb.node") == F.col("b"), "left")
    new = connect(over.select(name("a").alias("a"), name("b").alias("b")))
    moved = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return kept(old.unionByName(new.join(roots.select("node"), "node", "left_anti")))


def like_roots(docs: DataFrame, text: str, marked: DataFrame, roots: DataFrame, likeness: float) -> DataFrame:
    """``roots`` (node, root) of the fingerprints, joined by the texts of so much likeness. ``marked``: fp and ``like_marks`` of all rows.

    First each set is judged with the candidate that agrees most, then those pairs that aren't in one component yet.
    """
    grouped = marked.where("_set is not null").groupBy(F.col("_set").alias("id")).agg(
        F.min("fp").alias("fp"), F.max("fp").alias("high"), F.min("_hint").alias("hint"), F.first("_sketch").alias("sketch"), F.first("_buckets").alias("buckets")
    )
    sets = kept(grouped)
    # equal sets with unlike fingerprints: the least one stands for all
    unlike = sets.where("fp <> high").select(F.col("id").alias("_set"), F.col("fp").alias("b"))
    roots = _joined(roots, marked.select("_set", F.col("fp").alias("a")).join(unlike, "_set").select("a", "b").where("a <> b").distinct())
    pairs = candidates(sets, likeness)
    wanted = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").select("id", "hint", "fp")
    wanted = kept(wanted)
    hashes = shingle_sets(docs, text, wanted)
    of = lambda side: sets.select(F.col("id").alias(side), F.col("fp").alias(f"f{side}"))
    pairs = kept(pairs.join(of("a"), "a").join(of("b"), "b"))
    turned = pairs.select("a", "b", "agree").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = turned.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    first = kept(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def linked(some: DataFrame, hashes: DataFrame) -> DataFrame:
        alike = _alike(some, hashes, likeness)
        return alike.join(of("a"), "a").join(of("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))

    roots = _joined(roots, kept(linked(first, hashes)))
    named = pairs.join(roots.select(F.col("node").alias("fa"), F.col("root").alias("ra")), "fa", "left").join(roots.select(F.col("node").alias("fb"), F.col("root").alias("rb")), "fb", "left")
    apart = named.where(F.coalesce("ra", "fa") != F.coalesce("rb", "fb")).select("a", "b").join(first, ["a", "b"], "left_anti")
    roots = _joined(roots, kept(linked(kept(apart), hashes)))
    # What members of large buckets didn't meet above.
    rest = unmet(sets, roots)
    if rest.isEmpty():
        return roots
    late = kept(rest.select("id").distinct().join(sets, "id").select("id", "hint"))
    whole = sets.select("id", "fp", "sketch", "buckets").join(shingle_sets(docs, text, late), "id")
    return _joined(roots, kept(late_links(rest, whole, likeness)))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, likeness: float | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, with fp, root (a fingerprint that names the component) and component_id."""
    taken = {"fp", "root", "component_id", *(LIKE_COLUMNS if likeness else ())}
    if taken & set(docs.columns):
        raise ValueError(f"the columns {', '.join(sorted(taken))} are the operator's")
    with scratch(docs.sparkSession) as stays:
        rest = [c for c in docs.columns if c != text]
        marked = stays(like_marks(docs, text) if likeness else fingerprints(docs, text))
        distinct = kept(marked.groupBy("fp").agg(F.min(key).alias("least")))
        roots = connect(edges(distinct.select("fp"), radius))
        if likeness:
            roots = like_roots(docs, text, marked, roots, likeness)
        named = kept(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
        ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
        found = stays(named.join(ids, "root").select("fp", "root", "component_id"))
    return marked.select(*rest, "fp").join(found, "fp")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, likeness: float | None = None) -> DataFrame:
    """One row of each component of ``docs``: the least key, of rows without keys the least text."""
    columns, names = docs.columns, []
    for name in ("_hash", "_key", "_first"):  # helpers that clash with no column
        while name in columns:
            name = f"_{name}"
        names.append(name)
    own, least, text_of_least = names
    hashed = docs.withColumn(own, F.xxhash64(text_or_empty(text)))
    found = components(hashed.select(key, text, own), key, text, radius, likeness)
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(own).alias("hash"))
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.key").alias(least), F.col("first.hash").alias(text_of_least))
    chosen = hashed.join(first, hashed[key].eqNullSafe(F.col(least)) & (F.col(own) == F.col(text_of_least)), "left_semi")
    return chosen.dropDuplicates([key, own]).select(*columns)
