"""Byte-level BPE against the library, whatever the chunks, and round trips."""

import hashlib
import random

import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from lodestone.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
TEXTS = [
    None, "", " ", "a", "it's we'll 'tis they'd", "  two  spaces\n\n\nlines\t\tend  ", "déjà vu größer ñandú", "日本語 한국어 العربية", "👍🏽 👨‍👩‍👧!!",
    "12345 6789 ½²", "<|endoftext|> stays text", "x" * 700, " " * 700, "\n" * 300 + "a", "ab'l" * 200, "'" * 300 + "ll", "a1" * 300, "\x85 \x1c\x00",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = list(TEXTS)
    for _ in range(40):
        made.append("".join(rng.choice(["word", " ", "  ", "\n", "'ll", "é", "9", "!?", "日", "'s", "\t", "longerword"]) for _ in range(rng.randint(1, 400))))
    return made


@pytest.mark.parametrize(("chunk", "overlap"), [(65_536, 1_024), (120, 40), (64, 20)])
def test_ids_equal_the_library(spark, texts, chunk, overlap):
    library = bpe.encoder(RANKS, P.PATTERN)
    df = spark.createDataFrame([(i if i % 7 else None, t, "own") for i, t in enumerate(texts)] + [(1, texts[5], "own")], "doc_id bigint, text string, decoded_text string")
    got = bpe.decode(bpe.encode(df, RANKS, P.PATTERN, chunk_chars=chunk, overlap=overlap), RANKS).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.decoded_text == "own"


def test_cuts_are_boundaries_of_the_whole_text(texts):
    pattern = regex.compile(P.PATTERN)
    for text in texts:
        text = text or ""
        whole = {m.end() for m in pattern.finditer(text)}
        chunks = []
        for start in range(0, max(1, len(text) - 40), 80):
            ends = bpe.boundaries(pattern, text[start : start + 120])
            chunks.append((start, [e for e in ends if e < 40], [e for e in ends if 80 < e <= 120 - bpe.EDGE]))
        found = bpe.cuts(chunks)
        assert set(found) <= whole and found == sorted(set(found))


def test_digests_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in bpe.digests(df, RANKS, P.PATTERN).collect()}
    ids = bpe.encoder(RANKS, P.PATTERN).encode_ordinary("two words")
    assert rows[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and rows[1].n_tokens == len(ids)
    assert rows[1].decoded_sha256 == hashlib.sha256(b"two words").hexdigest() and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("ids", F.lit(1)), RANKS, P.PATTERN)
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), RANKS).collect()
