"""Vector codes against plain rounds of assignment and floored means; defined cases."""

import hashlib
import math
import random

import pytest

from lodestone.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string"


def plain(rows, scale, parts, entries, rounds):
    used = [(k, [math.floor(scale * x) for x in v], label) for k, v, label, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not used:
        return []
    used.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(used[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in used[:entries]] for p in range(parts)]

    def nearest(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, v, _ in used:
                members[nearest(v, p)[0]].append(cut(v, p))
            new.append([[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members, books[p], strict=True)])
        books = new
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(k, [nearest(v, p) for p in range(parts)], label) for k, v, label in used]
    errors = {}
    for _, near, label in found:
        errors[label] = errors.get(label, 0) + sum(d for _, d in near)
    return sorted(((k, "".join(f"{i:02x}" for i, _ in near), sum(d for _, d in near), errors[label], said) for k, near, label in found), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(n, rng, dims=8):
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(dims)], rng.choice([0, 0, 1, None]), "x") for k in range(n)]
    odd = [(n, None, 1, "x"), (n + 1, [None] + [0.5] * (dims - 1), 1, "x"), (n + 2, [float("nan")] * dims, 0, "x"), (n + 3, [float("inf")] * dims, 0, "x")]
    twice = [rows[2], (rows[3][0], rows[4][1], 1, "y"), (None, rows[0][1], 0, "z"), (n + 4, [0.0] * dims, 5, None)]
    return rows + odd + twice


@pytest.mark.parametrize("count, entries, parts", [(120, 16, 4), (5, 16, 2), (60, 7, 1)])
def test_codes_equal_plain_rounds(spark, monkeypatch, count, entries, parts):
    rng = random.Random(count)
    rows = vectors(count, rng)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    read = [tuple(r) for r in df.collect()]  # components as single floats
    monkeypatch.setattr(vector_codes, "BLOCK", 32)
    got = vector_codes.compress(df, scale=64, parts=parts, entries=entries, rounds=3)
    assert result(got) == plain(read, 64, parts, entries, 3)


def test_ties_go_to_the_lower_index(spark):
    df = spark.createDataFrame([(k, [float(x)], 0, "") for k, x in enumerate([0, 2, 1, 1])], SCHEMA)
    got = vector_codes.compress(df, scale=1, parts=1, entries=2, rounds=0)
    assert [r.code for r in got.orderBy("vec_id").collect()] == ["00", "01", "00", "00"]


def test_empty_and_unusable(spark):
    none = spark.createDataFrame([], SCHEMA)
    unusable = spark.createDataFrame([(1, None, 2, ""), (2, [None, 1.0], 2, "")], SCHEMA)
    for df in (none, unusable):
        assert vector_codes.compress(df).collect() == []
    with pytest.raises(ValueError, match="parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 2, "")], SCHEMA))
    with pytest.raises(Exception, match="unlike lengths"):  # in the driver, or in the task that holds both
        two = [spark.createDataFrame([(1, [1.0] * n, 2, "")], SCHEMA).coalesce(1) for n in (4, 8)]
        vector_codes.compress(two[0].union(two[1]))


def test_string_keys(spark):
    df = spark.createDataFrame([("b", [0.0, 1.0], "x"), ("a", [1.0, 0.0], "y"), (None, [0.5, 0.5], "x")], "vec_id string, embedding array<double>, label string")
    got = vector_codes.compress(df, scale=2, parts=2, entries=2, rounds=1)
    assert {(r.vec_id, r.code) for r in got.collect()} == {("a", "0000"), ("b", "0101"), (None, "0000")}
    with pytest.raises(ValueError, match="output"):
        vector_codes.compress(df.withColumnRenamed("vec_id", "code"), key="code")
