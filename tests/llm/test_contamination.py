"""Containment of test items against brute force over exact shingles."""

import random
import re

import pytest

from pyspark.sql import functions as F

from lodestone.llm import contamination


def shingles(words, width):
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain(docs, items):
    out = []
    for key, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for item, other in items:
            wanted = re.findall(r"\w+", (other or "").lower())
            own = shingles(wanted, min(5, len(wanted))) if wanted else set()
            shared = len(own & shingles(words, min(5, len(wanted)))) if own else 0
            if own and shared >= 0.8 * len(own) - 1e-9:
                out.append((str(key), item, len(own), shared, round(shared / len(own), 9)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 60)))) for i in range(40)]
    items += [(100, "Short One"), (101, ""), (102, None), (103, "..."), (104, "a a a a a a a a a a"), (100, "second text of one id here it is")]
    docs = []
    for i in range(200):
        words = [word() for _ in range(rng.choice([0, 3, 50, 400]))]
        for _ in range(rng.randint(0, 3)):
            passage = (rng.choice(items)[1] or "").upper().split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if passage:
                    passage[rng.randrange(len(passage))] = "edited,"
            at = rng.randint(0, len(words))
            if rng.random() < 0.3:  # in two places
                half = len(passage) // 2
                words[at:at] = passage[: half + 4]
                words += passage[half:]
            else:
                words[at:at] = passage
        docs.append((i if i % 9 else None, " ".join(words)))
    docs += [docs[3], docs[3], (7, None), (8, "short\n\none"), (9, "x " * 30_000 + items[0][1] + " y" * 30_000), (10, "a a a a a a")]
    schema = "doc_id bigint, text string"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id bigint, text string"), docs, items


@pytest.mark.parametrize("block", [50_000, 7])
def test_pairs_equal_brute_force(tables, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", block)
    df, items, docs, plain_items = tables
    got = contamination.contained(df, items).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], round(r[4], 9)) for r in got) == plain(docs, plain_items)


def test_clean_keeps_exactly_the_rest(tables, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 30)
    df, items, docs, plain_items = tables
    dirty = {text for i, (_, text) in enumerate(docs) if plain([(i, text)], plain_items)}
    kept = contamination.clean(df, items)
    assert kept.columns == df.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(key, kept.collect())) == sorted(key(d) for d in docs if d[1] not in dirty)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert contamination.contained(docs, items).count() == 0
    assert contamination.clean(docs, items).count() == 1
    assert contamination.contained(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


@pytest.mark.parametrize("key_type", ["tinyint", "smallint", "int", "bigint", "string", "decimal(9,2)", "date"])
def test_items_keep_the_type_of_their_key(spark, key_type):
    docs = spark.createDataFrame([(1, "some words that stand in an item of this test")], "doc_id int, text string")
    items = spark.createDataFrame([("2024-01-05" if key_type == "date" else "7", "words that stand in an item")], "item_id string, text string")
    items = items.withColumn("item_id", F.col("item_id").cast(key_type))
    found = contamination.contained(docs, items)
    assert found.schema["item_id"].dataType.simpleString() == key_type
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, items.first().item_id)]
