"""Hard negatives against all scores; the Hilbert curve; bounds; defined cases."""

import math
import random

import numpy as np
import pytest

from lodestone.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string"


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 2), (4, 2), (1, 5)])
def test_curve_visits_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = negatives.hilbert(points, bits)
    assert sorted(place.tolist()) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(1)
    x, a = rng.integers(-99, 99, (500, 6)), rng.integers(-99, 99, (20, 6))
    low, high = x.reshape(10, 50, 6).min(axis=1), x.reshape(10, 50, 6).max(axis=1)
    under, over = negatives.bounds(a, low, high)
    scores = negatives.products(a, x).reshape(20, 10, 50)
    assert (under <= scores.min(axis=2)).all() and (scores.max(axis=2) <= over).all()
    big = np.array([[(1 << 26) - 1, (1 << 26) - 3]])
    assert negatives.products(big, big)[0, 0] == sum(int(v) ** 2 for v in big[0])


def test_window_is_the_condition():
    for score in range(-25, 60):
        first, last = negatives.window(score, 30, 90)
        assert [s for s in range(-99, 99) if 30 * score <= 100 * s <= 90 * score] == list(range(first, last + 1))


def plain(rows, scale, every, positives, count):
    used = [(k, [math.floor(scale * x) for x in v], label) for k, v, label, _ in rows if None not in (k, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for i, (k, v, label) in enumerate(used):
        if k % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), n, other == label) for j, (n, w, other) in enumerate(used) if j != i]
        for p, pid, _ in sorted(s for s in scored if s[2])[:positives]:
            fit = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:count]
            found += [(k, pid, r, nid, -p, -n) for r, (n, nid, _) in enumerate(fit, start=1)]
    return sorted(found)


@pytest.mark.parametrize("clusters, dims", [(1, 5), (12, 8)])
def test_results_equal_all_scores(spark, monkeypatch, clusters, dims):
    rng = random.Random(dims)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = []
    for k in range(600):
        c = rng.randrange(clusters)
        rows.append((k, [x + rng.gauss(0, 0.2) for x in centres[c]], rng.choice([c % 3, 0, 0, 1]), "x"))
    rows += [(700 + k, rows[5][1], k % 2, None) for k in range(40)]  # ties
    rows += [rows[0], rows[0], rows[7], (20, rows[3][1], 1, "y"), (None, rows[1][1], 1, ""), (1000, None, 1, ""), (1010, rows[4][1], None, ""), (1020, [None] * dims, 1, ""), (1030, [math.inf] * dims, 1, "")]
    rng.shuffle(rows)
    for name, value in {"BLOCK": 16, "GROUP": 4}.items():
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    read = [tuple(r) for r in df.collect()]  # components as single floats
    got = sorted(map(tuple, negatives.mine(df, scale=64, every=20).collect()))
    assert got == plain(read, 64, 20, 5, 10) and len(got) > 500


def test_bounds_spare_blocks(spark):
    """On far clusters most blocks are never sent to an anchor."""
    rng = random.Random(9)
    rows = [(k, [8.0 * (j == k % 16) + rng.random() / 8 for j in range(16)], k % 2, "") for k in range(8_192)]
    blocks, width = negatives.stored_blocks(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 64, 100, 5)
    zones, anchors = negatives.zone_maps(blocks), negatives.anchor_rows(blocks, width, 100)
    asked = negatives.asked(anchors, zones, lambda g: (g[0], np.iinfo(np.int64).max)).selectExpr("sum(size(places))").first()[0]
    assert asked < 0.25 * anchors.count() * len(zones[0])


def test_empty_and_alone(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.mine(spark.createDataFrame([(0, None, 1, "")], SCHEMA)).collect() == []
    assert negatives.mine(spark.createDataFrame([(0, [1.0, 0.5], 1, ""), (1, [1.0, 1.0], 2, "")], SCHEMA)).collect() == []
    assert negatives.mine(spark.createDataFrame([(1, [1.0, 0.5], 1, ""), (2, [1.0, 1.0], 2, "")], SCHEMA)).collect() == []
