"""LM scoring: masked pseudo-likelihood of documents under a bidirectional window network.

1. ``tokenized`` cuts every text into tokens once and keeps them as a table: slices of documents, each
   with its distinct tokens and the places of its tokens in that list. All later steps read it.
2. ``vocabulary`` counts the tokens of all documents. ``side`` says how many numbers the network knows:
   they grow as the root of the number of tokens. Seven eighths are words of their own, the most
   frequent ones; every other token falls by its hash into one of the rest. A token of a shared number
   gets its own share of the number's probability, by the counts of the whole corpus; one more, unseen
   token is counted for each shared number. Shares of the ``FREQUENT`` most frequent tokens are looked
   up in the task, those of all others come by a join with the table of counts, which has no bound.
3. ``train`` fits the network by rounds of parameter averaging: each task starts from the shared
   parameters, masks every token of its documents in turn, learns to predict it from both sides by
   gradient steps of ``STEP`` positions, and passes its parameters on, weighted by the number of
   tokens it learned from. Spark deals the parameters out in blocks and
   streams them into averages of fixed size. All documents take part in every round.
4. ``score`` masks every token of every document in turn and adds up the conditional
   log-probabilities: the pseudo-log-likelihood of the document.

Network: the embeddings of the ``WINDOW`` tokens on either side, by distance, are scaled and added,
a hidden layer follows, then a two-level softmax (class of the number, number in the class), so that
probabilities are exact at a cost of twice the root of the vocabulary.

Bounds: at most ``MOST ** 2`` numbers and ``FREQUENT`` looked-up tokens go to the tasks. Beyond
them nothing is dropped: further tokens share numbers, and their shares come by the join.

Defined cases: a null text is an empty one; a text without tokens scores 0 and has a mean of null;
outside the text there is an edge token; a token that the counted corpus does not hold scores as one unseen
token of its number; other columns and repeated rows pass through; columns named like an output or a helper
raise ``ValueError``; without any tokens the network stays as it began; empty tables give empty tables.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import kept, slices, small_batches, word_tokens
from lodestone.session import BATCH_ROWS
from lodestone.llm.token_counts import GRADE, floor_of

#: Least and greatest number of classes, which is also that of the numbers in a class; tokens looked up in a task.
LEAST, MOST, FREQUENT = 16, 256, 1 << 17
WINDOW, DIM, HIDDEN = 2, 16, 24
#: Rounds of averaging, positions in a gradient step, learning rate, what squared gradients begin with, seed.
#: Gradients are means over a step, far below one: a larger beginning would hide them.
ROUNDS, STEP, RATE, SQUARES, SEED = 1, 8_192, 0.1, 1e-7, 17
#: Positions scored at once; parameters in a block; bytes of text in a slice.
AT_ONCE, BLOCK, SLICE_BYTES = 1 << 13, 1 << 10, 4_000_000
OUTPUT, HELPERS = ["n_tokens", "log_likelihood", "mean_log_likelihood"], ["_sizes", "_ids", "_tokens", "_times", "_row"]


def side(tokens: int) -> int:
    """Classes of a network for a corpus of so many tokens: a third of the fourth root, within the bounds."""
    return min(MOST, max(LEAST, round(tokens**0.25 / 3)))


# -- tokens --------------------------------------------------------------------------------------


def tokenized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a running ``_row``, kept; the first row of each slice holds the slice's tokens.

    ``_tokens`` are the distinct tokens of the slice, ``_times`` their counts, ``_ids`` the place of each token
    in that list, and ``_sizes`` the numbers of tokens of the slice's documents, whose rows follow one another.
    """
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place, BATCH_ROWS, SLICE_BYTES):
            numbers: defaultdict[str, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            sizes, parts = [], []
            for value in batch.column(place).to_pylist():
                tokens = word_tokens(value or "")
                sizes.append(len(tokens))
                parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
            ids = np.concatenate(parts)
            empty = [None] * (batch.num_rows - 1)
            columns = [
                pa.array([np.array(sizes, "<i4").tobytes(), *empty], pa.binary()),
                pa.array([ids.astype("<i4").tobytes(), *empty], pa.binary()),
                pa.array([list(numbers), *empty], pa.list_(pa.string())),
                pa.array([np.bincount(ids, minlength=len(numbers)), *empty], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *HELPERS[:4]])
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    found = docs.mapInArrow(run, f"{schema}, _sizes binary, _ids binary, _tokens array<string>, _times array<bigint>")
    return kept(found.withColumn("_row", F.monotonically_increasing_id()))


def token_counts(sliced: DataFrame) -> DataFrame:
    """(token, n) over all documents, kept."""
    each = sliced.where("_ids is not null").select(F.explode(F.arrays_zip("_tokens", "_times")).alias("t"))
    return kept(each.groupBy(F.col("t._tokens").alias("token")).agg(F.sum("t._times").alias("n")))


@dataclass
class Vocabulary:
    """Words with a number of their own, how often each number occurs, and counts of frequent tokens of shared numbers."""

    side: int
    known: dict[str, int]
    counts: np.ndarray
    frequent: dict[str, int] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return self.side**2

    @property
    def words(self) -> int:
        """Numbers that are kept for words of their own; the others are shared."""
        return own_words(self.side)

    def number(self, token: str) -> int:
        found = self.known.get(token)
        return self.words + zlib.crc32(token.encode("utf-8")) % (self.size - self.words) if found is None else found

    def numbers(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number, tokens), np.int64, len(tokens))

    def share(self, token: str, n: int) -> float:
        """Part of its number's probability that a token found ``n`` times has; ``n`` = 1 for an unseen one."""
        return 1.0 if token in self.known else n / (self.counts[self.number(token)] + 1)

    def look_up(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, logarithms of the shares, and which tokens are not held here: their share is that of an unseen one."""
        numbers = self.numbers(tokens)
        times = np.fromiter((self.frequent.get(t, 0) for t in tokens), np.float64, len(tokens))
        shared = numbers >= self.words
        shares = np.where(shared, np.log(np.maximum(times, 1) / (self.counts[numbers] + 1)), 0.0)
        return numbers, shares, shared & (times == 0)


def own_words(classes: int) -> int:
    return classes**2 * 7 // 8


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of a table (token, n)."""
    classes = side(counts.agg(F.sum("n")).first()[0] or 0)
    words = own_words(classes)
    floor = floor_of(counts, FREQUENT)
    top = counts.where(f"{GRADE} >= {floor}").collect()  # at most FREQUENT rows
    top = sorted(((r.token, r.n) for r in top), key=lambda t: (-t[1], t[0]))
    totals = np.zeros(classes**2)
    totals[: len(top[:words])] = [n for _, n in top[:words]]
    made = Vocabulary(classes, {t: k for k, (t, _) in enumerate(top[:words])}, totals, dict(top[words:]))
    shared = classes**2 - words
    rare = counts.where(f"{GRADE} < {floor}").groupBy((F.crc32("token") % shared).alias("k")).agg(F.sum("n").alias("n"))
    for r in rare.collect():  # at most as many rows as shared numbers
        totals[words + r.k] += r.n
    for token, n in made.frequent.items():
        totals[made.number(token)] += n
    return made


# -- network -------------------------------------------------------------------------------------


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    """Name and shape of the parameters, in one flat vector. The last row of ``w``, ``class_w`` and ``member_w`` is the bias."""
    return {
        "embed": (classes**2 + 1, DIM), "place": (2 * WINDOW, DIM), "w": (DIM + 1, HIDDEN),
        "class_w": (HIDDEN + 1, classes), "member_w": (classes, HIDDEN + 1, classes),
    }


def length(classes: int) -> int:
    return sum(math.prod(s) for s in shapes(classes).values())


def views(flat: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(classes).items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def beginning(known: Vocabulary) -> np.ndarray:
    """Small random weights; the biases give each number its share of the corpus."""
    rng = np.random.default_rng(SEED)
    flat = np.zeros(length(known.side), np.float32)
    p = views(flat, known.side)
    p["embed"][:] = rng.normal(0, 0.3, p["embed"].shape)
    p["place"][:] = 1 / np.sqrt(2 * WINDOW)
    p["w"][:DIM] = rng.normal(0, 1 / np.sqrt(DIM), (DIM, HIDDEN))
    p["class_w"][:HIDDEN] = rng.normal(0, 0.1, (HIDDEN, known.side))
    p["member_w"][:, :HIDDEN] = rng.normal(0, 0.1, (known.side, HIDDEN, known.side))
    counts = known.counts.reshape(known.side, known.side) + 1
    p["class_w"][HIDDEN] = np.log(counts.sum(axis=1) / counts.sum())
    p["member_w"][:, HIDDEN] = np.log(counts / counts.sum(axis=1, keepdims=True))
    return flat


def offsets() -> list[int]:
    return [*range(-WINDOW, 0), *range(1, WINDOW + 1)]


@dataclass
class Forward:
    """Positions in order of their classes, and what the network makes of them."""

    order: np.ndarray
    near: list[np.ndarray]
    pooled: np.ndarray
    hidden: np.ndarray
    classes: np.ndarray
    members: np.ndarray
    bounds: list[tuple[int, int, int]]
    to_class: np.ndarray
    to_member: np.ndarray


def forward(p: dict, ids: np.ndarray, at: np.ndarray) -> Forward:
    """The network at positions of a padded stream; the position itself is only read as the target."""
    many = p["class_w"].shape[1]
    targets = ids[at]
    order = np.argsort((targets // many).astype(np.int16), kind="stable")  # sorted by digits, not by comparisons
    at, targets = at[order], targets[order]
    classes, members = targets // many, targets % many
    near = [ids[at + offset] for offset in offsets()]
    pooled = np.zeros((len(at), DIM), p["embed"].dtype)
    for k, numbers in enumerate(near):
        pooled += np.take(p["embed"] * p["place"][k], numbers, axis=0)
    hidden = np.ones((len(at), HIDDEN + 1), pooled.dtype)
    np.tanh(pooled @ p["w"][:DIM] + p["w"][DIM], out=hidden[:, :HIDDEN])
    cuts = np.searchsorted(classes, np.arange(many + 1)).tolist()
    bounds = [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
    to_member = np.empty((len(at), many), pooled.dtype)
    for c, a, b in bounds:
        np.matmul(hidden[a:b], p["member_w"][c], out=to_member[a:b])
    return Forward(order, near, pooled, hidden, classes, members, bounds, hidden @ p["class_w"], to_member)


def exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Exponentials of each row, in place of it, and the shift of each row; none where all values are small."""
    shift = 0.0
    if np.abs(x).max(initial=0) >= 60:
        shift = x.max(axis=1)
        x -= shift[:, None]
    return np.exp(x, out=x), shift


def log_probabilities(p: dict, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(number at each position | its neighbours)."""
    f, rows = forward(p, ids, at), np.arange(len(at))
    found = np.zeros(len(at), f.hidden.dtype)
    for logits, target in ((f.to_class, f.classes), (f.to_member, f.members)):
        found += logits[rows, target]
        powers, shift = exponentials(logits)
        found -= np.log(powers @ np.ones(logits.shape[1], logits.dtype)) + shift
    out = np.empty_like(found)
    out[f.order] = found
    return out


def gradient_step(flat: np.ndarray, squares: np.ndarray, ids: np.ndarray, at: np.ndarray, many: int) -> None:
    """One Adagrad step on the masked positions ``at`` of a network of ``many`` classes."""
    p, f, rows = views(flat, many), forward(views(flat, many), ids, at), np.arange(len(at))
    for logits, target in ((f.to_class, f.classes), (f.to_member, f.members)):
        exponentials(logits)
        logits *= (1 / len(at) / (logits @ np.ones(many, logits.dtype)))[:, None]
        logits[rows, target] -= 1 / len(at)
    moves = np.zeros_like(flat)
    grads = views(moves, many)
    np.matmul(f.hidden.T, f.to_class, out=grads["class_w"])
    back = f.to_class @ p["class_w"][:HIDDEN].T
    for c, a, b in f.bounds:
        np.matmul(f.hidden[a:b].T, f.to_member[a:b], out=grads["member_w"][c])
        back[a:b] += f.to_member[a:b] @ p["member_w"][c, :HIDDEN].T
    back *= 1 - f.hidden[:, :HIDDEN] ** 2
    grads["w"][:DIM], grads["w"][DIM] = f.pooled.T @ back, back.sum(axis=0)
    to_pooled = np.ascontiguousarray(p["w"][:DIM] @ back.T, np.float64)  # by dimension
    moved = np.empty((DIM, len(p["embed"])))
    for k, numbers in enumerate(f.near):
        # what each number is to be moved by at this distance
        for d in range(DIM):
            moved[d] = np.bincount(numbers, weights=to_pooled[d], minlength=len(p["embed"]))
        by_number = moved.T.astype(flat.dtype)
        grads["place"][k] = np.einsum("nd,nd->d", by_number, p["embed"])
        by_number *= p["place"][k]
        grads["embed"] += by_number
    squares += moves * moves
    moves *= RATE
    moves /= np.sqrt(squares) + 1e-6
    flat -= moves


def keep_freed_memory() -> None:
    """Let the allocator serve arrays of a step from memory it has, not from fresh pages each time.

    The C library does so for blocks up to the size of the largest one that was freed before.
    """
    np.empty(30 << 20, np.uint8)


def stream(numbers: np.ndarray, sizes: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some documents with edges before, between and after, and the places of the numbers."""
    at = np.arange(len(numbers)) + WINDOW * (1 + np.repeat(np.arange(len(sizes)), sizes))
    ids = np.full(len(numbers) + WINDOW * (len(sizes) + 1), edge, np.int64)
    ids[at] = numbers
    return ids, at


def each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], int]]:
    """Sizes of the documents, places of their tokens, distinct tokens, and first row of each slice."""
    for batch in batches:
        for k in range(batch.num_rows):
            sizes, ids, tokens, row = (c[k].as_py() for c in batch.columns)
            yield np.frombuffer(sizes, "<i4"), np.frombuffer(ids, "<i4"), tokens, row


def _begun(parts: Iterator) -> Iterator | None:
    """The same elements, or None where there are none: such a task needs no parameters."""
    first = next(parts, None)
    return None if first is None else chain([first], parts)


def _slices(sliced: DataFrame) -> DataFrame:
    return sliced.where("_ids is not null").select("_sizes", "_ids", "_tokens", "_row")


def learned(parts: Iterator[tuple], known: Vocabulary, begin: np.ndarray) -> tuple[np.ndarray, int]:
    """Parameters after every token of some slices was a target, and the number of these."""
    keep_freed_memory()
    own, squares, n = begin.copy(), np.full_like(begin, SQUARES), 0
    for sizes, places, tokens, _ in parts:
        ids, at = stream(known.numbers(tokens)[places], sizes, known.size)
        for start in range(0, len(at), STEP):
            gradient_step(own, squares, ids, at[start : start + STEP], known.side)
        n += len(at)
    return own, n


def train(sliced: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Averaged parameters after some rounds over all documents."""
    flat, total = beginning(known), length(known.side)
    for _ in range(rounds):
        shared = sliced.sparkSession.sparkContext.broadcast((replace(known, frequent={}), flat))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parts = _begun(each_slice(batches))
            if parts is None:
                return
            own, n = learned(parts, *shared.value)
            weighted = (own.astype(np.float64) * n).astype("<f8")
            blocks = [weighted[i : i + BLOCK].tobytes() for i in range(0, total, BLOCK)] if n else []
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([n] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["block", "n", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            counts: Counter = Counter()
            for batch in batches:
                for block, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    values = np.frombuffer(raw, "<f8")
                    sums[block] = sums[block] + values if block in sums else values
                    counts[block] += n
            columns = [pa.array(sums.keys(), pa.int32()), pa.array([counts[b] for b in sums], pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "n", "sums"])

        schema = "block int, n bigint, sums binary"
        rows = _slices(sliced).mapInArrow(learn, schema).repartition("block").mapInArrow(add, schema).collect()  # one row for each block
        flat = flat.copy()
        for r in rows:
            flat[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, "<f8") / r.n
    return flat


def score(sliced: DataFrame, counts: DataFrame, known: Vocabulary, flat: np.ndarray) -> DataFrame:
    """The tokenized documents with n_tokens, log_likelihood (sum over all tokens, natural logarithm) and mean_log_likelihood."""
    shared = sliced.sparkSession.sparkContext.broadcast((known, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _begun(each_slice(batches))
        if parts is None:
            return
        keep_freed_memory()
        words, flat = shared.value
        p = views(flat, words.side)
        for sizes, places, tokens, row in parts:
            numbers, shares, elsewhere = words.look_up(tokens)
            ids, at = stream(numbers[places], sizes, words.size)
            values = shares[places]
            for start in range(0, len(at), AT_ONCE):
                values[start : start + AT_ONCE] += log_probabilities(p, ids, at[start : start + AT_ONCE])
            of = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.bincount(of, weights=values, minlength=len(sizes))
            elsewhere = np.flatnonzero(elsewhere[places])
            names = pa.array(tokens, pa.string()).take(pa.array(places[elsewhere]))
            ends = np.searchsorted(of[elsewhere], np.arange(len(sizes) + 1)).astype(np.int32)
            columns = [pa.array(row + np.arange(len(sizes)), pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(sums), pa.ListArray.from_arrays(pa.array(ends), names)]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "n_tokens", "log_likelihood", "_rare"])

    schema = "_row bigint, n_tokens bigint, log_likelihood double, _rare array<string>"
    scored = kept(_slices(sliced).mapInArrow(run, schema))
    # an unseen token counts once; a token that was found oftener gains the logarithm of its count
    rare = scored.select("_row", F.explode("_rare").alias("token")).join(counts.where("n > 1"), "token")
    sums = scored.select("_row", "n_tokens", "log_likelihood").unionByName(rare.select("_row", F.log("n").alias("log_likelihood")), allowMissingColumns=True)
    sums = sums.groupBy("_row").agg(F.max("n_tokens").alias("n_tokens"), F.sum("log_likelihood").alias("log_likelihood"))
    found = sliced.drop(*HELPERS[:4]).join(sums, "_row").drop("_row")
    return found.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_tokens"))


def pseudo_likelihood(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Tokens, vocabulary, training and scoring over the same documents."""
    if {*OUTPUT, *HELPERS} & set(docs.columns):
        raise ValueError(f"the columns {', '.join([*OUTPUT, *HELPERS])} are the operator's")
    sliced = tokenized(docs, text)
    counts = token_counts(sliced)
    known = vocabulary(counts)
    return score(sliced, counts, known, train(sliced, known, rounds))
