"""Token counts against the tokenizer library over whole texts."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import token_counts

TEXTS = [
    "", None, "   \n\t", "Hello World", "it's they'll WE'VE 'tis don't", "ΣΑΣ Σίσυφος ς", "İstanbul ǅ ﬁ ½ ² Ⅷ 123 4,5",
    "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "naïve café naïve café", "日本語のテキスト 한국어", "👍🏽👨‍👩‍👧 ok!!??",
    "a_b__c __", "x" * 3000, "word " * 4000, "tab\tnew nbsp em​zero", "\x1c\x1d control \x85",
]


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.mark.parametrize("frequent", [3, 150_000])
def test_counts_equal_the_library(spark, definition, monkeypatch, frequent):
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)
    library = Tokenizer.from_str(definition)
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[3]), (3, "other"), (None, TEXTS[3])]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, definition).collect())
    want = sorted((str(k), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows)
    assert got == want


def test_floor_keeps_the_frequent_table_within_its_bound(spark):
    words = spark.createDataFrame([(str(i), n, 1) for i, n in enumerate([9, 9, 5, 5, 5, 2, 1, 1])], "piece string, n bigint, n_tokens bigint")
    for most, kept in ((1, 0), (2, 2), (4, 2), (5, 5), (6, 6), (8, 8)):
        floor = token_counts.floor_of(words, most)
        assert words.where(f"{token_counts.GRADE} >= {floor}").count() == kept


def test_empty_table(spark, definition):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), definition).count() == 0
