"""Quality and toxicity: held-out accuracy, shapes of results and defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality, toxicity


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su", "no") for b in ("ka", "ri", "do", "vel", "sti")]
    docs, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, int(rng.integers(8, 120))))
        good, toxic = i % 3 != 0, i % 4 == 0
        if not good:
            text = [w + s for w, s in zip(text, rng.choice(["###", "$$$", "!!"], len(text)), strict=True)]
        if toxic:
            for _ in range(int(rng.integers(1, 6))):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(["vileness", "vilest", "wretch"])))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(good), int(toxic)))
    docs += [(None, "lo ka", "x"), (1000, None, "x"), (1001, "", "x"), docs[5], (1002, "word " * 200_000, "x")]
    labels += [labels[1], (None, 1, 1), (2000, None, None), (2001, 0, 0)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out_rows(made):
    docs, labels = made
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "text", "source", "score", "held_out", "predicted"]
    rows = got.join(labels.dropDuplicates(["doc_id"]), "doc_id").where("held_out and quality is not null").collect()
    assert len(rows) > 120 and np.mean([r.predicted == r.quality for r in rows]) > 0.97
    every = got.collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in every)
    assert sum(r.doc_id is None and r.held_out is False for r in every) == 1


def test_quality_does_not_look_at_held_out_labels(made):
    docs, labels = made
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_toxicity_on_held_out_rows(made):
    docs, labels = made
    got = toxicity.rate(docs, labels)
    assert got.columns == ["doc_id", "text", "source", "severity", "p_toxic", "toxic"]
    rows = got.join(labels.drop("quality").withColumnRenamed("toxic", "truth").dropDuplicates(["doc_id"]), "doc_id").where(quality.held_out("doc_id")).where("truth is not null").collect()
    assert len(rows) > 120 and np.mean([r.toxic == (r.truth == 1) for r in rows]) > 0.97
    assert np.mean([r.severity for r in rows if r.truth]) > 1 > np.mean([r.severity for r in rows if not r.truth])
    assert got.count() == docs.count()


def test_severity_grows_with_the_insults(made, spark):
    docs, labels = made
    model = toxicity.fit(docs, labels)
    few = spark.createDataFrame([(n, "lori miri " * 10 + "wretch vilest " * n) for n in (0, 1, 4, 9)], "n int, text string")
    found = [r.severity for r in toxicity.score(few, model).orderBy("n").collect()]
    assert found == sorted(found) and found[0] < 0.5 < found[-1]
    assert np.all(np.diff(model.thresholds) > 0)


def test_ordinal_gradient_fits_ordered_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, 400)
    grades = np.digitize(x, [-1, 0.5, 2])
    weights, thresholds = toxicity.fit_ordinal(np.arange(400), np.zeros(400, int), x, grades, 1)
    assert weights[0] > 1 and np.allclose(thresholds / weights[0], [-1, 0.5, 2], atol=0.25)


def test_without_labels_or_documents(made, spark):
    docs, labels = made
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert toxicity.rate(docs, none).where("toxic").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert toxicity.rate(docs.limit(0), labels).count() == 0
    for function, name in ((quality.classify, "score"), (toxicity.rate, "severity")):
        with pytest.raises(ValueError):
            function(docs.withColumn(name, F.lit(1)), labels)
