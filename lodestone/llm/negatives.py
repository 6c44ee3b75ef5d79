"""Hard-negative mining: candidate blocks in Hilbert order, chosen by interval arithmetic on their zone maps.

For each anchor and each of its nearest rows of the same label (its positives), the highest-scoring rows of
other labels whose score lies between two parts of the positive's score. Scores are inner products of whole
numbers, floor(scale * x).

1. ``stored_blocks``: rows are ordered along a Hilbert curve through the dimensions of the greatest variance, cut into
   slabs (ranges of the curve, one task each) and these into blocks of ``BLOCK`` rows. A block is one Parquet row: keys, labels,
   numbers, and its zone map, the least and greatest number of each dimension. While a slab is in one task, its anchors get a
   floor: the score that their last positive reaches inside the slab.
2. For an anchor a and a zone map [low, high], a's scores in the block lie between the sums of
   min(a*low, a*high) and max(a*low, a*high). An anchor is sent to the slabs whose bounds leave a chance only, and
   inside a slab it reads only the blocks whose own bounds do: for positives, those that can reach its floor and
   hold its label; for negatives, those whose bounds meet one of its windows and that hold another label.
3. A slab's task reads the slab's blocks once and streams the anchors past it in groups of ``GROUP``; every slab gives
   each anchor its best few rows, and a ranked window over the slabs' few rows gives the best of all. The zone maps of slabs
   (at most ``SLABS`` rows) are the only table that every task holds.

Bounds never leave out a row that counts, so results are exact; how much they save depends on the vectors.
No row is paired with all others: the anchors are a stated query set, and a slab's task holds ``SLAB`` rows (or
a 16,384th part of the table) and one group of anchors.

Defined cases: rows with a null key, a null label, a null vector, or null or non-finite components take no part;
repeated rows are rows of their own, each an anchor (their results repeat) and each a candidate; an anchor
is not its own positive; equal scores come by smaller key; an anchor without positives or without rows in its window has
no result; other columns are not carried; empty tables give empty tables. ``ValueError``: vectors of unlike lengths, numbers
beyond ``vectors.LARGEST`` or whose products leave 62 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import kept, small_batches
from lodestone.llm.vectors import whole_vectors

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 100, 5, 10, 30, 90
BLOCK, GROUP = 256, 64
#: Rows of a slab where the table is large; the most slabs.
SLAB, SLABS = 65_536, 16_384
#: Dimensions of the curve and bits of each.
AXES, BITS = 16, 4


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates (rows, dimensions): at most 64 bits in all.

    Skilling's transform (2004): undo excess work from the highest bit down, Gray encode, interleave.
    """
    x = axes.astype(np.uint64).T.copy()
    zero, top = np.uint64(0), 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint64(q - 1)
        for row in x:
            high = (row & np.uint64(q)) != 0
            swap = np.where(high, zero, (x[0] ^ row) & low)
            flip = np.where(high, low, zero)
            row ^= swap
            x[0] ^= swap ^ flip
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), zero)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for row in x:
            place = (place << np.uint64(1)) | ((row >> np.uint64(bit)) & np.uint64(1))
    return place


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: in doubles where these can't round, else in 64-bit integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 62:
        raise ValueError("inner products leave 62 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) possible score of each anchor (row) in each box (column)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the greatest scores, best first; of equal ones the earlier index first."""
    if len(scores) > 4 * most:
        floor = -np.partition(-scores, most - 1)[most - 1]
        at = np.flatnonzero(scores >= floor)
        return at[np.argsort(-scores[at], kind="stable")][:most]
    return np.argsort(-scores, kind="stable")[:most]


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.array(values, type=pa.list_(pa.int64()))


_BLOCK = "slab int, at int, keys array<bigint>, labels array<bigint>, numbers binary, low array<bigint>, high array<bigint>, floors array<bigint>"
_ANCHOR = "place bigint, key bigint, label bigint, numbers array<bigint>, goals array<bigint>"
_ASKED = "slab int, kind int, at bigint, keys array<bigint>, labels array<bigint>, numbers binary, places array<bigint>, goals array<array<bigint>>"


def stored_blocks(vectors: DataFrame, key: str, vector: str, label: str, scale: int, every: int, positives: int) -> tuple[DataFrame, int]:
    """Blocks in Hilbert order in the shared folder, and the number of dimensions (0: no usable rows)."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("key is not null and label is not null")

    def extents(batches):
        for batch in batches:
            _, x = whole_vectors(batch, 2, scale)
            if len(x):
                d = np.arange(x.shape[1], dtype=np.int32)
                f = x.astype(np.float64)
                columns = [d, np.full(len(d), len(x), dtype=np.int64), x.min(axis=0), x.max(axis=0), f.sum(axis=0), (f * f).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "n", "low", "high", "s", "q"])

    found = rows.mapInArrow(extents, "d int, n bigint, low bigint, high bigint, s double, q double")
    stats = found.groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("d").collect()
    width = len(stats)
    if len({r.n for r in stats}) > 1:
        raise ValueError("vectors of unlike lengths")
    if not width:
        return rows.sparkSession.createDataFrame([], _BLOCK), 0
    count = stats[0].n
    chosen = sorted(range(width), key=lambda d: (-(stats[d].q - stats[d].s ** 2 / count), d))[:AXES]
    base = np.array([stats[d].low for d in chosen], dtype=np.float64)
    span = np.array([stats[d].high - stats[d].low + 1 for d in chosen], dtype=np.float64)
    small = max(max(abs(r.low), abs(r.high)) for r in stats) < 1 << 15
    kind = np.int16 if small else np.int32

    def placed(batches):
        for batch in batches:
            good, x = whole_vectors(batch, 2, scale)
            if not len(good):
                continue
            grid = np.floor((x[:, chosen] - base) / span * (1 << BITS)).astype(np.int64)
            curve = (hilbert(grid, BITS) ^ np.uint64(1 << 63)).view(np.int64)
            numbers = [v.tobytes() for v in x.astype(kind)]
            columns = [pa.array(curve), batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(numbers, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["curve", "key", "label", "numbers"])

    slab_rows = max(-(-count // SLABS), min(SLAB, max(4 * BLOCK, -(-count // 16))))
    ordered = rows.mapInArrow(placed, "curve bigint, key bigint, label bigint, numbers binary")
    ranged = ordered.repartitionByRange(-(-count // slab_rows), "curve", "key").sortWithinPartitions("curve", "key", "label", "numbers")

    def packed(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        keys, labels = (table.column(c).to_numpy() for c in ("key", "label"))
        x = np.frombuffer(b"".join(table.column("numbers").to_pylist()), dtype=kind).reshape(len(keys), width)
        floors = np.full(len(keys), np.iinfo(np.int64).min)
        asks = np.flatnonzero(keys % every == 0)
        for start in range(0, len(asks), GROUP):
            group = asks[start : start + GROUP]
            for anchor, scores in zip(group, products(x[group], x), strict=True):
                same = labels == labels[anchor]
                same[anchor] = False
                own = scores[same]
                if len(own) >= positives:
                    floors[anchor] = -np.partition(-own, positives - 1)[positives - 1]
        slab = TaskContext.get().partitionId()
        for at in range(0, len(keys), BLOCK):
            piece = slice(at, at + BLOCK)
            box = x[piece].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([slab], type=pa.int32()), pa.array([at // BLOCK], type=pa.int32()), _lists([keys[piece]]), _lists([labels[piece]]),
                    pa.array([x[piece].tobytes()], type=pa.binary()), _lists([box.min(axis=0)]), _lists([box.max(axis=0)]), _lists([floors[piece]]),
                ],
                ["slab", "at", "keys", "labels", "numbers", "low", "high", "floors"],
            )

    return kept(ranged.mapInArrow(packed, _BLOCK)), width


def zone_maps(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slab, low, high) of all slabs: at most ``SLABS`` rows. The boxes of the blocks are joined in the tasks first."""

    def joined(batches):
        boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for slab, low, high in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                old = boxes.get(slab, (low, high))
                boxes[slab] = np.minimum(old[0], low), np.maximum(old[1], high)
        columns = [pa.array(list(boxes), type=pa.int32()), *(_lists([np.asarray(b[k]) for b in boxes.values()]) for k in range(2))]
        yield pa.RecordBatch.from_arrays(columns, ["slab", "low", "high"])

    rows = blocks.select("slab", "low", "high").mapInArrow(joined, "slab int, low array<bigint>, high array<bigint>").collect()
    slabs = sorted({r.slab for r in rows})
    number = {s: k for k, s in enumerate(slabs)}
    width = len(rows[0].low)
    low, high = np.full((len(slabs), width), np.iinfo(np.int64).max), np.full((len(slabs), width), np.iinfo(np.int64).min)
    for r in rows:
        k = number[r.slab]
        low[k], high[k] = np.minimum(low[k], r.low), np.maximum(high[k], r.high)
    return np.array(slabs), low, high


def anchor_rows(blocks: DataFrame, width: int, every: int) -> DataFrame:
    """(place, key, label, numbers, goals) of the anchors in curve order; the goal is the floor of the last positive."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.array(row["keys"])
                at = np.flatnonzero(keys % every == 0)
                if not len(at):
                    continue
                x = np.frombuffer(row["numbers"], dtype=np.int16 if len(row["numbers"]) == 2 * width * len(keys) else np.int32).reshape(len(keys), width)
                places = (row["slab"] << 32) + row["at"] * BLOCK + at
                columns = [pa.array(places), pa.array(keys[at]), pa.array(np.array(row["labels"])[at]), _lists(list(x[at].astype(np.int64))), _lists([np.array([row["floors"][k]]) for k in at])]
                yield pa.RecordBatch.from_arrays(columns, ["place", "key", "label", "numbers", "goals"])

    return blocks.select("slab", "at", "keys", "labels", "numbers", "floors").mapInArrow(run, _ANCHOR)


def asked(anchors: DataFrame, zones: tuple[np.ndarray, np.ndarray, np.ndarray], goal) -> DataFrame:
    """Groups of anchors, each sent to the slabs that some of its anchors may need.

    ``goal`` gives the least and greatest score that an anchor with such goals looks for.
    """
    slabs, low, high = zones

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                group = batch.slice(start, GROUP)
                places, keys, labels = (group.column(c).to_numpy() for c in range(3))
                x = group.column(3).flatten().to_numpy().reshape(len(keys), -1)
                goals = group.column(4).to_pylist()
                least, most = np.array([goal(g) for g in goals]).T[:, :, None]
                under, over = bounds(x, low, high)
                needed = (over >= least) & (under <= most)
                for k in np.flatnonzero(needed.any(axis=0)):
                    of = np.flatnonzero(needed[:, k])
                    columns = [
                        pa.array([slabs[k]], type=pa.int32()), pa.array([1], type=pa.int32()), pa.array([places[0]]), _lists([keys[of]]), _lists([labels[of]]),
                        pa.array([x[of].astype(np.int32).tobytes()], type=pa.binary()), _lists([places[of]]), pa.array([[goals[i] for i in of]], type=pa.list_(pa.list_(pa.int64()))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["slab", "kind", "at", "keys", "labels", "numbers", "places", "goals"])

    return anchors.mapInArrow(run, _ASKED)


class Slab:
    """A slab's rows in order of their keys, with the blocks that they lie in."""

    def __init__(self, slab: int, blocks: list[dict], width: int):
        self.slab, self.width = slab, width
        keys = np.concatenate([b["keys"] for b in blocks]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.labels = keys[order], np.concatenate([b["labels"] for b in blocks]).astype(np.int64)[order]
        kind = lambda b: np.int16 if len(b["numbers"]) == 2 * width * len(b["keys"]) else np.int32
        self.numbers = np.concatenate([np.frombuffer(b["numbers"], dtype=kind(b)).reshape(-1, width) for b in blocks])[order]
        self.block = np.repeat(np.arange(len(blocks)), [len(b["keys"]) for b in blocks])[order]
        at = np.concatenate([b["at"] * BLOCK + np.arange(len(b["keys"])) for b in blocks])[order]
        self.place = (slab << 32) + at
        self.low = np.stack([self.numbers[self.block == k].min(axis=0) for k in range(len(blocks))]).astype(np.int64)
        self.high = np.stack([self.numbers[self.block == k].max(axis=0) for k in range(len(blocks))]).astype(np.int64)
        self.kinds = [set(b["labels"]) for b in blocks]

    def read(self, x: np.ndarray, labels: np.ndarray, least: np.ndarray, most: np.ndarray, same: bool):
        """For each anchor: (rows that it must read, their scores), in order of keys; the bounds choose blocks."""
        under, over = bounds(x, self.low, self.high)
        needed = (over >= least[:, None]) & (under <= most[:, None])
        for label in np.unique(labels):
            useful = np.array([(label in kinds) if same else kinds != {label} for kinds in self.kinds])
            needed[np.ix_(labels == label, ~useful)] = False
        rows = np.flatnonzero(needed.any(axis=0)[self.block])
        scores = products(x, self.numbers[rows])
        for k, label in enumerate(labels):
            fits = needed[k][self.block[rows]] & ((self.labels[rows] == label) == same) & (scores[k] >= least[k]) & (scores[k] <= most[k])
            yield rows[fits], scores[k][fits]


def searched(blocks: DataFrame, questions: DataFrame, width: int, partitions: int, schema: str, answer) -> DataFrame:
    """``answer(slab, group)`` of each group of anchors that a slab is asked for; a slab's blocks come before its groups."""
    known = blocks.select("slab", F.lit(0).alias("kind"), F.col("at").cast("bigint").alias("at"), "keys", "labels", "numbers")
    both = known.unionByName(questions, allowMissingColumns=True)
    dealt = both.repartition(partitions, "slab").sortWithinPartitions("slab", "kind", "at")

    def run(batches):
        blocks_of, slab = [], None
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                if row["kind"] == 0:
                    if blocks_of and blocks_of[0]["slab"] != row["slab"]:
                        blocks_of = []
                    blocks_of.append(row)
                    slab = None
                    continue
                slab = slab or Slab(row["slab"], blocks_of, width)
                x = np.frombuffer(row["numbers"], dtype=np.int32).reshape(-1, width)
                yield answer(slab, x, row)

    return dealt.mapInArrow(run, schema)


def mine(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose key is divisible by ``every``; ``low`` and ``high`` are hundredths of the positive's score.
    """
    blocks, width = stored_blocks(vectors, key, vector, label, scale, every, positives)
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not width:
        return blocks.sparkSession.createDataFrame([], result)
    zones = zone_maps(blocks)
    partitions = len(zones[0])
    anchors = kept(anchor_rows(blocks, width, every))

    def reaches(floor):
        return floor[0], np.iinfo(np.int64).max

    def same_label(slab: Slab, x: np.ndarray, row: dict) -> pa.RecordBatch:
        least = np.array([g[0] for g in row["goals"]])
        most = np.full(len(least), np.iinfo(np.int64).max)
        found = []
        for place, (rows, scores) in zip(row["places"], slab.read(x, np.array(row["labels"]), least, most, same=True), strict=True):
            other = slab.place[rows] != place
            rows, scores = rows[other], scores[other]
            at = _best(scores, positives)
            found.append((np.full(len(at), place), slab.keys[rows[at]], scores[at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["place", "positive", "score"])

    near = searched(blocks, asked(anchors, zones, reaches), width, partitions, "place bigint, positive bigint, score bigint", same_label)
    best = Window.partitionBy("place").orderBy(F.desc("score"), "positive")
    chosen = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
    # at most ``positives`` rows of an anchor: as (key, score, key, score, ...) in order
    goals = chosen.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("r", "positive", "score"))).alias("p"))
    goals = goals.select("place", F.flatten(F.transform("p", lambda p: F.array(p["positive"], p["score"]))).alias("goals"))
    aims = kept(anchors.drop("goals").join(goals, "place").select("place", "key", "label", "numbers", "goals"))
    aims = aims.repartitionByRange("place").sortWithinPartitions("place")

    def windows(goal):
        edges = [window(score, low, high) for score in goal[1::2]]
        edges = [e for e in edges if e[0] <= e[1]]
        return (min(e[0] for e in edges), max(e[1] for e in edges)) if edges else (np.iinfo(np.int64).max, np.iinfo(np.int64).min)

    def other_labels(slab: Slab, x: np.ndarray, row: dict) -> pa.RecordBatch:
        least, most = np.array([windows(g) for g in row["goals"]]).T
        found = [np.empty((0, 7), dtype=np.int64)]
        read = slab.read(x, np.array(row["labels"]), least, most, same=False)
        for place, anchor, goal, (rows, scores) in zip(row["places"], row["keys"], row["goals"], read, strict=True):
            order = np.argsort(-scores, kind="stable")
            down = -scores[order]
            for number, (positive, score) in enumerate(zip(goal[::2], goal[1::2], strict=True)):
                first, last = window(score, low, high)
                start, stop = np.searchsorted(down, -last, side="left"), np.searchsorted(down, -first, side="right")
                at = order[start : min(stop, start + negatives)]
                told = [np.full(len(at), v) for v in (place, number, anchor, positive, score)]
                found.append(np.stack([*told, slab.keys[rows[at]], scores[at]], axis=1))
        columns = np.concatenate(found).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["place", "number", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    told = "place bigint, number bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    hits = searched(blocks, asked(aims, zones, windows), width, partitions, told, other_labels)
    ranked = Window.partitionBy("place", "number").orderBy(F.desc("negative_score"), "negative_id")
    hits = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return hits.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
