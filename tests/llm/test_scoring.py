"""Pseudo-likelihood: exact probabilities, gradients, learning, and documents scored one by one."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import scoring
from lodestone.llm.common import word_tokens


def counts_of(texts):
    return Counter(t for x in texts for t in word_tokens(x or ""))


def vocabulary_of(texts):
    counts = counts_of(texts)
    side = scoring.side(sum(counts.values()))
    order = sorted(counts.items(), key=lambda c: (-c[1], c[0]))
    made = scoring.Vocabulary(side, {t: k for k, (t, _) in enumerate(order[: scoring.own_words(side)])}, np.zeros(side**2))
    for t, n in counts.items():
        made.counts[made.number(t)] += n
    return made


TEXTS = ["the cat sat on the mat", "the dog sat on the log .", None, "", "one", "The CAT, the cat!", "é è " * 40] + [f"a b c d e {i}" for i in range(60)]
TEXTS += [" ".join(f"w{k}" for k in range(i, i + 9)) for i in range(0, 900, 5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 6 else None, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[1], "x"), (3, TEXTS[1], "x"), (9, "long text " * 20_000, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows


def test_probabilities_add_up_to_one():
    known = vocabulary_of(TEXTS)
    p, size = scoring.views(scoring.beginning(known), known.side), known.size
    ids = np.full((size, 5), size)
    ids[:, :2], ids[:, 3:], ids[:, 2] = (5, 9), (1, size), np.arange(size)
    found = scoring.log_probabilities(p, ids.ravel(), np.arange(size) * 5 + 2)
    assert abs(np.exp(found.astype(np.float64)).sum() - 1) < 1e-4


def test_shares_of_a_number_add_up_to_one():
    counts = counts_of(TEXTS)
    known = vocabulary_of(TEXTS)
    shared = [t for t in counts if t not in known.known]
    sums = np.zeros(known.size)
    for t in shared:
        sums[known.number(t)] += known.share(t, counts[t])
    used = np.flatnonzero(sums)
    assert len(shared) > 500 and np.allclose(sums[used] + 1 / (known.counts[used] + 1), 1)


def test_large_values_do_not_overflow():
    known = vocabulary_of(TEXTS)
    flat = scoring.beginning(known) * 4000
    ids = np.arange(40) % known.size
    assert np.isfinite(scoring.log_probabilities(scoring.views(flat, known.side), ids, np.arange(2, 38))).all()
    scoring.gradient_step(flat, np.full_like(flat, 0.1), ids, np.arange(2, 38), known.side)
    assert np.isfinite(flat).all()


def test_gradient_follows_the_loss(monkeypatch):
    rng = np.random.default_rng(3)
    known = vocabulary_of(TEXTS)
    flat = scoring.beginning(known).astype(np.float64)
    ids = np.concatenate([[known.size] * 2, rng.integers(0, known.size, 30), [known.size] * 2])
    at = np.arange(2, 32)
    # Adagrad from empty squares moves every parameter by the rate against the sign of its gradient
    monkeypatch.setattr(scoring, "RATE", 1e-6)
    moved, squares = flat.copy(), np.zeros_like(flat)
    scoring.gradient_step(moved, squares, ids, at, known.side)
    loss = lambda f: -scoring.log_probabilities(scoring.views(f, known.side), ids, at).astype(np.float64).mean()
    size = np.sqrt(squares)
    for k in np.argsort(-size)[:: max(1, (size > 1e-4).sum() // 40)][:40]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        assert abs(abs(slope) - size[k]) < 2e-3 + 0.05 * size[k]
        assert size[k] < 1e-3 or np.sign(slope) == -np.sign(moved[k] - flat[k])


@pytest.mark.parametrize("most", [0, 40, 1 << 17])
def test_vocabulary_counts_every_token(docs, monkeypatch, most):
    df, rows = docs
    counts, want = counts_of(r[1] for r in rows), vocabulary_of([r[1] for r in rows])
    monkeypatch.setattr(scoring, "FREQUENT", most)
    table = scoring.token_counts(scoring.tokenized(df))
    assert {r.token: r.n for r in table.collect()} == counts
    found = scoring.vocabulary(table)
    assert found.side == want.side and found.counts.sum() == sum(counts.values())
    if most > len(counts):
        assert found.known == want.known and np.array_equal(found.counts, want.counts)
        assert found.frequent == {t: n for t, n in counts.items() if t not in want.known}
    assert len(found.known) + len(found.frequent) <= most


def test_the_network_grows_with_the_corpus():
    assert [scoring.side(n) for n in (0, 10**7, 10**8, 10**10, 10**15)] == [16, 19, 33, 105, 256]


@pytest.mark.parametrize("most", [40, 1 << 17])
def test_scores_equal_documents_scored_one_by_one(docs, monkeypatch, most):
    """Also where most tokens' shares come by the join; equal words of unlike counts score apart."""
    df, rows = docs
    monkeypatch.setattr(scoring, "FREQUENT", most)
    monkeypatch.setattr(scoring, "SLICE_BYTES", 400)
    counts = counts_of(r[1] for r in rows)
    sliced = scoring.tokenized(df)
    table = scoring.token_counts(sliced)
    known = scoring.vocabulary(table)
    flat = scoring.beginning(known)
    p, edge = scoring.views(flat, known.side), [known.size] * 2
    found = scoring.score(sliced, table, known, flat)
    assert set(found.columns) == {"doc_id", "text", "lang", *scoring.OUTPUT}
    got = [((str(r.doc_id), r.text, r.n_tokens), r.log_likelihood, r.mean_log_likelihood) for r in found.collect()]
    want = {}
    for key, text, _ in rows:
        tokens = word_tokens(text or "")
        ids = np.array([*edge, *(known.number(t) for t in tokens), *edge])
        total = 0.0
        for start in range(0, len(tokens), 5000):
            part = tokens[start : start + 5000]
            total += float(scoring.log_probabilities(p, ids, np.arange(start, start + len(part)) + 2).astype(float).sum())
            total += sum(math.log(known.share(t, counts[t])) for t in part)
        want[str(key), text, len(tokens)] = total
    assert Counter(k for k, _, _ in got) == Counter((str(k), t, len(word_tokens(t or ""))) for k, t, _ in rows)
    for key, total, mean in got:
        assert abs(total - want[key]) < 1e-3 + 1e-5 * abs(want[key])
        assert mean is None if key[2] == 0 else abs(mean - total / key[2]) < 1e-9


def test_a_common_and_a_rare_word_of_one_number_score_apart(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FREQUENT", 0)  # all words share numbers, all shares come by the join
    words = [f"x{i}" for i in range(2000)]
    number = scoring.Vocabulary(16, {}, np.zeros(256)).number
    other = next(w for w in words[1:] if number(w) == number(words[0]))
    texts = [words[0], other, "never"] + [words[0]] * 99
    sliced = scoring.tokenized(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    table = scoring.token_counts(sliced)
    known = scoring.vocabulary(table)
    got = {r.doc_id: r.log_likelihood for r in scoring.score(sliced, table, known, scoring.beginning(known)).collect()}
    assert abs(got[0] - got[1] - math.log(100)) < 1e-5
    # a token that was not counted is one unseen token of its number
    rest = scoring.score(sliced, table.where(F.col("token") != words[0]), known, scoring.beginning(known))
    assert abs({r.doc_id: r.log_likelihood for r in rest.collect()}[0] - got[1]) < 1e-5


def test_training_learns_what_stands_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(scoring, "STEP", 64)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{x} {x}{y} {y}" for x, y in zip(rng.choice(list("abc"), 300), rng.choice(list("def"), 300))) for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    seen, unseen = scoring.tokenized(df.where("doc_id >= 10")), scoring.tokenized(df.where("doc_id < 10"))
    table = scoring.token_counts(seen)
    known = scoring.vocabulary(table)
    mean = lambda flat: scoring.score(unseen, table, known, flat).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    first, trained = scoring.beginning(known), scoring.train(seen, known, rounds=3)
    assert mean(trained) > mean(first) + 0.4


def test_parameters_are_the_tasks_average_weighted_by_tokens(docs, monkeypatch):
    df, _ = docs
    monkeypatch.setattr(scoring, "STEP", 50)
    sliced = scoring.tokenized(df.where("length(text) < 1000").repartition(5))
    known = scoring.vocabulary(scoring.token_counts(sliced))
    parts = {}
    for r in scoring._slices(sliced).withColumn("part", F.spark_partition_id()).collect():
        parts.setdefault(r.part, []).append((np.frombuffer(r._sizes, "<i4"), np.frombuffer(r._ids, "<i4"), r._tokens, r._row))
    each = [scoring.learned(iter(p), known, scoring.beginning(known)) for p in parts.values()]
    want = sum(own.astype(float) * n for own, n in each) / sum(n for _, n in each)
    assert len(each) > 1 and np.allclose(scoring.train(sliced, known), want, atol=1e-6)


def test_empty_table_and_clashing_names(docs):
    df, _ = docs
    assert scoring.pseudo_likelihood(df.limit(0)).count() == 0
    for name in ("n_tokens", "_row"):
        with pytest.raises(ValueError):
            scoring.pseudo_likelihood(df.withColumn(name, F.lit(1)))


def test_every_token_is_a_target(spark):
    for text in ("one", "one two", "one two three", "a b c d"):
        sliced = scoring.tokenized(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
        known = scoring.vocabulary(scoring.token_counts(sliced))
        biases = lambda flat: scoring.views(flat, known.side)["member_w"][:, scoring.HIDDEN].ravel()  # noqa: B023, E731
        moved = biases(scoring.train(sliced, known)) - biases(scoring.beginning(known))
        # a number that is a target is pushed up against its class
        assert all(moved[known.number(t)] > 0 for t in text.split())
