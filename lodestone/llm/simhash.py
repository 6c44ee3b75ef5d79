"""Document fingerprints: SimHash over weighted terms, DataFrame functions only.

``next_texts`` gives every document the text that follows it in descending key order, ``fingerprinted``
the fingerprints of chosen texts, ``edited`` the fingerprints of each document and of its edited
text, ``near`` all pairs of fingerprints within a Hamming radius by permuted block tables.

A fingerprint has 128 bits (two words). Each distinct term of a text (lower-cased, split at white
space) votes on every bit with the sign of that bit in its hash and the weight of its length, at
most ``WEIGHT``. Votes are packed, two counters of 32 bits in a word; a counter can't overflow, as
the weights of distinct terms add up to no more than the characters of the text, under 2^31.

The order is found without sorting all rows in one task: keys fall into at most ``BUCKETS`` ranges,
each range gets a guest, the first row of the range that follows it, and the following row is a
``lead`` inside the range. The table of guests has one row for each range (a proven bound). The
range partitioning by bucket serves the window, the votes and the comparison: texts move once.

Defined cases: a null text is an empty one; a text without terms has fingerprint zero; rows with a
null key have no place in the order: an empty text follows them and they follow nobody; of equal
keys the lesser text comes first; repeated rows stay repeated; other columns are not carried; empty
tables give empty tables.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import kept, text_or_empty

WEIGHT, WORDS, BITS = 12, 2, 128
BUCKETS, BUCKET_ROWS = 65_536, 1_024
PAIR = (1 << 32) + 1


def _terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"\s+"), ""))


def _votes() -> list[Column]:
    """Packed counters of the term hashes h0 and h1, and the total weight."""
    counters = [
        F.sum(F.shiftrightunsigned(f"h{w}", i).bitwiseAND(F.lit(PAIR)) * F.col("weight")).alias(f"v{w}_{i}") for w in range(WORDS) for i in range(32)
    ]
    return [*counters, F.sum("weight").alias("total")]


def _word(w: int) -> Column:
    """Word ``w`` of the fingerprint: bits that more than half of the weight is for."""
    bits = []
    for i in range(32):
        low, high = F.col(f"v{w}_{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{w}_{i}", 32)
        for votes, at in ((low, i), (high, i + 32)):
            bit = (1 << at) if at < 63 else -(1 << 63)
            bits.append(F.when(2 * votes > F.col("total"), F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    while len(bits) > 1:  # a balanced tree of ORs
        bits = [bits[k].bitwiseOR(bits[k + 1]) for k in range(0, len(bits), 2)]
    return bits[0]


def fingerprinted(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, f0, f1): the fingerprint of ``text``. The keys must tell the rows apart, or stand for equal texts."""
    words = rows.select(*keys, F.explode_outer(_terms(text)).alias("term"))
    weight = F.when(F.col("term").isNull(), 0).otherwise(F.least(F.length("term"), F.lit(WEIGHT))).cast("bigint")
    hashed = words.select(*keys, F.xxhash64("term").alias("h0"), F.xxhash64("term", F.lit(1)).alias("h1"), weight.alias("weight"))
    return hashed.groupBy(*keys).agg(*_votes()).select(*keys, *(_word(w).alias(f"f{w}") for w in range(WORDS)))


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits."""
    differing = reduce(lambda x, y: x + y, (F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a, b, strict=True)))
    return 1 - differing / F.lit(BITS)


def text_of(words: list[str]) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(w), 16, "0")) for w in words))


def next_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text, bucket, place, guest): rows in descending key order, texts of the next one.

    Rows with ``guest`` 1 repeat the first rows of the bucket that follows, and are no rows of ``docs``.
    """
    spread = docs.agg(F.min(key).cast("double").alias("low"), F.max(key).cast("double").alias("high"), F.count(key).alias("n")).first()
    buckets = max(1, min(BUCKETS, -(-spread.n // BUCKET_ROWS)))
    low, width = spread.low or 0.0, max(1.0, ((spread.high or 0.0) - (spread.low or 0.0) + 1) / buckets)
    of_key = F.floor((F.col("key").cast("double") - F.lit(low)) / F.lit(width))
    of_text = -1 - F.pmod(F.xxhash64("text"), F.lit(4096))
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn("bucket", F.coalesce(of_key, of_text))
    heads = rows.where("key is not null").groupBy("bucket").agg(F.max("key").alias("head"))  # <= BUCKETS + 1 rows
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    after = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order))
    targets = F.broadcast(heads.select("head", after.alias("target")))
    guests = rows.join(targets, F.col("key") == F.col("head")).select("key", "text", F.col("target").alias("bucket"), F.lit(1).alias("guest"))
    ranged = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartitionByRange("bucket")
    place = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "text")
    following = F.when(F.col("bucket") >= 0, F.lead("text").over(place)).otherwise(F.lit(""))
    return ranged.select("key", "text", F.coalesce(following, F.lit("")).alias("next_text"), "bucket", F.row_number().over(place).alias("place"), "guest")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 50, radius: int = 3) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) of each document.

    The edited text has its last half (rounded down) replaced by as much of the beginning of the next text.
    ``n_near`` counts the other documents whose fingerprints are within the radius, found by ``near``;
    only the rows whose key is divisible by ``every`` ask, for others it is null.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = next_texts(docs, key, text).withColumn("n_chars", F.length("text").cast("bigint"))
    changed = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", changed).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "place", "guest", "key", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("s"))
    marked = fingerprinted(both.select(*keys, "s.kind", "s.text"), [*keys, "kind"], F.col("text"))
    # in this order each text stands before its edited text, and two before the next text
    order = Window.partitionBy("bucket").orderBy("place", "kind")
    lead = lambda w, k: F.coalesce(F.lead(w, k).over(order), F.lit(0).cast("bigint"))
    beside = marked.select("*", *(lead(f"f{w}", 1).alias(f"e{w}") for w in range(WORDS)), *(lead(f"f{w}", 2).alias(f"n{w}") for w in range(WORDS)))
    own = beside.where("kind = 0 and guest = 0")
    for w in range(WORDS):
        own = own.withColumn(f"n{w}", F.when(F.col("bucket") >= 0, F.col(f"n{w}")).otherwise(F.lit(0).cast("bigint")))
    words = {c: [F.col(f"{c}{w}") for w in range(WORDS)] for c in "fen"}
    own = kept(own.select("key", "n_chars", "edited_sha256", *(f"{c}{w}" for c in "fen" for w in range(WORDS))))
    asks = F.col("key").cast("bigint") % every == 0
    sizes = own.groupBy("f0", "f1").agg(F.count("*").alias("n"))
    found = near(own.where(asks), own, radius).join(sizes, ["f0", "f1"]).groupBy("q0", "q1").agg((F.sum("n") - 1).alias("n_near"))
    own = own.join(found, (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1")), "left")
    return own.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        text_of([f"f{w}" for w in range(WORDS)]).alias("fingerprint"),
        text_of([f"e{w}" for w in range(WORDS)]).alias("edited_fingerprint"),
        likeness(words["f"], words["e"]).alias("near_edited"),
        likeness(words["f"], words["n"]).alias("near_next"),
        F.when(asks, F.col("n_near")).alias("n_near"),
    )


def _table_keys(f: list[str], radius: int) -> Column:
    """For each pair of the radius + 2 blocks of a fingerprint: the table's number and the two blocks.

    Fingerprints within the radius differ in at most ``radius`` blocks, so two blocks are equal.
    """
    digits = [F.substring(text_of(f), 1 + a, b - a) for a, b in _edges(radius + 2)]
    return F.array(*(F.struct(F.lit(n).alias("table"), digits[i].alias("x"), digits[j].alias("y")) for n, (i, j) in enumerate(combinations(range(radius + 2), 2))))


def _edges(blocks: int) -> list[tuple[int, int]]:
    """Where blocks of hexadecimal digits begin and end."""
    at = [BITS // 4 * k // blocks for k in range(blocks + 1)]
    return list(zip(at, at[1:], strict=False))


def near(queries: DataFrame, fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """(q0, q1, f0, f1, distance): all distinct fingerprints (f0, f1) within the radius of each distinct query.

    Every fingerprint stands in one table for each pair of blocks; a query looks into each table by
    its own blocks and meets only fingerprints that agree there. Equal fingerprints count once.
    """
    words = [f"f{w}" for w in range(WORDS)]
    known = fingerprints.select(*words).distinct().withColumn("at", F.explode(_table_keys(words, radius)))
    asked = queries.select(*words).distinct().withColumn("at", F.explode(_table_keys(words, radius)))
    asked = asked.select("at", *(F.col(w).alias(f"q{w[1:]}") for w in words))
    differing = F.bit_count(F.col("q0").bitwiseXOR(F.col("f0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("f1")))
    return asked.join(known, "at").withColumn("distance", differing).where(F.col("distance") <= radius).drop("at").distinct()
