"""The pipeline's stages on a small corpus, each against a plain version of its decision."""

import base64

import public_tokenizers
import pytest
import tiktoken
from test_contamination import plain as plain_containment
from test_near import plain_components, plain_fingerprint

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import near
from lodestone.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out of the last."""
    out = [table(spark, SF_DIR, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.kept(stage(spark, out[-1], SF_DIR)))
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_narrow_and_keep_the_columns(stages):
    columns = stages[0].columns
    assert all(df.columns == columns for df in stages[:-1])
    found = [set(rows(df)) for df in stages]
    assert all(b <= a for a, b in zip(found, found[1:]))
    assert len(found[0]) > len(found[-1]) > 50


def test_quality_and_toxicity_decide_as_labelled(spark, stages):
    labels = {r.doc_id: r for r in table(spark, SF_DIR, "labels").collect()}
    before, good, civil = ({k for k, _ in rows(df)} for df in stages[:3])
    clean = [k for k in before if k in labels and labels[k].quality == 1]
    assert sum(k in good for k in clean) >= 0.95 * len(clean)
    calm = [k for k in good if k in labels and labels[k].toxic == 0]
    assert sum(k in civil for k in calm) >= 0.95 * len(calm)


def test_near_dedup_keeps_the_least_of_each_component(stages):
    """Components by both rules: fingerprints within two bits, five-word likeness of 0.8 or more."""
    before, after = rows(stages[2]), rows(stages[3])
    label = plain_components(list(range(len(before))), [plain_fingerprint(t) for _, t in before])
    sets = [set(near.shingles(t or "", 5)) for _, t in before]
    for i, one in enumerate(sets):
        for j, other in enumerate(sets[:i]):
            if one and len(one & other) >= corpus_pipeline.LIKENESS * len(one | other) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert {k for k, _ in after} == {before[x][0] for x in label}


def test_decontamination_drops_exactly_the_contaminated(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    dirty = {int(p[0]) for p in plain_containment(rows(stages[3]), items)}
    assert rows(stages[4]) == [r for r in rows(stages[3]) if r[0] not in dirty]


def test_ids_are_those_of_the_library_and_give_the_text_back(stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in stages[5].collect():
        assert r.round_trip and r.ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids)


def test_run_equals_the_stages(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF_DIR)) == rows(stages[5])


def test_odd_rows_pass_every_stage(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "x " * 100_000, "en", "s", 1), (3, "twin text", "en", "s", 1), (3, "twin text", "en", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"
    docs = spark.createDataFrame([(*r, 0.5) for r in odd], schema).withColumns({c: F.lit("mine") for c in ("ids", "_hash", "n_tokens", "severity")})
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, SF_DIR).count() <= df.count()


def test_near_dedup_leaves_no_two_texts_of_likeness(stages):
    sets = [set(near.shingles(t or "", 5)) for _, t in rows(stages[3])]
    assert not [1 for i, a in enumerate(sets) for b in sets[:i] if a and len(a & b) >= 0.8 * len(a | b)]
