"""Fingerprints, edited texts and block tables against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import simhash


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß日😀") for _ in range(rng.randint(1, 14)))
    rows = [(i * 7 - 900, " ".join(word() for _ in range(rng.choice([0, 1, 2, 9, 80])))) for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "x"), (5004, "very " * 9000 + "long"), rows[7], rows[7], (rows[8][0], "twin")]
    many = " ".join(f"word{i}" for i in range(800))
    rows += [(9000 + 10 * i, f"{many} more{i}") for i in range(12)] + [(9500, many), (9501, many)]
    rows += [(None, "no key here at all"), (None, "no key here at all"), (None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, next_text string"), rows


def plain_edits(rows):
    placed = sorted(((k, t or "") for k, t in rows if k is not None), key=lambda r: (-r[0], r[1]))
    pairs = [(k, t, placed[(i + 1) % len(placed)][1]) for i, (k, t) in enumerate(placed)]
    pairs += [(None, t or "", "") for k, t in rows if k is None]
    return [(k, t, t[: len(t) - len(t) // 2] + n[: len(t) // 2], n) for k, t, n in pairs]


def prints(spark, texts):
    made = simhash.fingerprinted(spark.createDataFrame([(t,) for t in set(texts)], "t string"), ["t"], F.col("t"))
    return {r.t: (r.f0 % 2**64) << 64 | (r.f1 % 2**64) for r in made.collect()}


@pytest.mark.parametrize("bucket_rows", [10, 1024])
def test_edits_and_likeness_equal_brute_force(spark, docs, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    df, rows = docs
    want = plain_edits(rows)
    of = prints(spark, [t for _, *ts in want for t in ts])
    like = lambda a, b: 1 - bin(of[a] ^ of[b]).count("1") / 128
    known = [of[t] for _, t, _, _ in want]
    others = lambda k, t: sum(bin(of[t] ^ x).count("1") <= 3 for x in known) - 1 if k is not None and k % 50 == 0 else None
    expected = [(str(k), len(t), hashlib.sha256(e.encode()).hexdigest(), f"{of[t]:032x}", f"{of[e]:032x}", like(t, e), like(t, n), others(k, t)) for k, t, e, n in want]
    got = [(str(r[0]), *r[1:]) for r in simhash.edited(df).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert any(r[-1] for r in got)


def test_fingerprint_is_the_sign_of_weighted_votes(spark):
    text = "One two, THREE three four-and-twenty blackbirds baked"
    terms = sorted({w for w in text.lower().split()})
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.xxhash64("term").alias("a"), F.xxhash64("term", F.lit(1)).alias("b")).collect()
    votes = [0] * 128
    for r in rows:
        value = (r.a % 2**64) << 64 | (r.b % 2**64)
        for b in range(128):
            votes[b] += min(len(r.term), 12) * (1 if value >> b & 1 else -1)
    assert prints(spark, [text])[text] == sum(1 << b for b in range(128) if votes[b] > 0)


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(8)
    values = []
    for _ in range(30):
        base = rng.getrandbits(128)
        values += [base] + [base ^ sum(1 << b for b in rng.sample(range(128), n)) for n in (0, 1, 2, 3, 4, 5)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(v >> 64), signed(v % 2**64)) for v in values], "f0 bigint, f1 bigint")
    for radius in (0, 3):
        got = {((r.q0 % 2**64) << 64 | r.q1 % 2**64, (r.f0 % 2**64) << 64 | r.f1 % 2**64, r.distance) for r in simhash.near(df.limit(100), df, radius).collect()}
        want = {(a, b, d) for a in values[:100] for b in values if (d := bin(a ^ b).count("1")) <= radius}
        assert got == want


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.edited(empty).count() == 0
    one = simhash.edited(spark.createDataFrame([(1, "abcd efgh")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest() and one[0].near_next == 1
