"""License scans: base phrases and suppression against plain recounts, keywords of every rule, defined cases."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import licenses
from lodestone.llm.license_rules import BASE, RULES

SCHEMA = "doc_id bigint, text string, source string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    """(n_words, n_base, first, last, base labels, labels, suppressed) by trying every rule at every place."""
    words = words_of(text)
    padded = "".join(f" {w} " for w in words)
    found = []
    for rule in RULES:
        for m in re.finditer(licenses.pattern_of(rule), padded):
            found.append((padded[: m.start()].count(" ") // 2, padded[: m.end()].count(" ") // 2, rule))
    left = [
        d for d in found
        if not any(
            e[0] <= d[0] and e[1] >= d[1] and e[2].rank <= d[2].rank and (e[0] < d[0] or e[1] > d[1] or (e[2].rank, e[2].number) < (d[2].rank, d[2].number))
            for e in found
        )
    ]
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = sorted({label for _, label in places})
    return (
        len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
        ",".join(base), ",".join(sorted({*base, *(d[2].label for d in left)})), max((d[2].confidence for d in left), default=0.0), len(found) - len(left),
    )


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_suppressed")


def test_scan_equals_a_plain_one(spark):
    rng = random.Random(4)
    samples = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: GPL-2.0-or-later",
        "https://www.gnu.org/licenses/gpl-3.0.html", "GNU General Public License v3 or any later version", "MIT license mit LICENSE", "the 3-clause BSD licence",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International",
        "Copyright (c) 2020 Jane Doe. All rights reserved.", "apachelicense", "Apacheé License", "mit ßlicense general public license",
    ]
    texts = [" ".join(rng.choice([*samples, "lorem", "public", "Licence", "\n", "-"]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    texts += [None, "", "...", "MIT license " * 1500, "x" * 50_000 + " mit license", texts[0]]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in licenses.scan(df).collect()}
    for k, text in enumerate(texts):
        if text is not None and len(text) > 5_000 and "MIT" in text:
            assert got[k][:6] == (3_000, 1_500, 0, 2_998, "mit", "mit")
        else:
            assert got[k] == plain(text), text


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(RULES).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(re.compile(r.pattern, re.A), fullmatch=True))))
def test_every_match_holds_its_keyword(sample):
    rule, text = sample
    padded = "".join(f" {w} " for w in words_of(text))
    if re.fullmatch(licenses.pattern_of(rule), padded):
        assert any(licenses.spaced(k) in padded for k in rule.keyword.split("|"))


def test_rules_are_in_order_and_many():
    assert len(RULES) > 300 and [r.number for r in RULES] == list(range(len(RULES)))
    assert all(re.compile(licenses.pattern_of(r)).groups == 1 for r in RULES)


def test_detections_and_containment(spark):
    df = spark.createDataFrame([(1, "use the GNU General Public License version 2, please", "a")], SCHEMA)
    row = licenses.scan(df).first()
    assert [(d.start, d.stop, d.label) for d in row.detections] == [(2, 8, "gpl-2.0")]
    assert (row.base_labels, row.labels, row.source) == ("gpl", "gpl,gpl-2.0", "a")


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.scan(empty).collect() == []
    twice = spark.createDataFrame([(None, "mit license", None)] * 2, SCHEMA)
    assert [(r.doc_id, r.n_base) for r in licenses.scan(twice).collect()] == [(None, 1)] * 2
    with pytest.raises(ValueError, match="labels"):
        licenses.scan(empty.withColumnRenamed("source", "labels"))


def test_no_python_in_the_plan(spark, capsys):
    licenses.scan(spark.createDataFrame([], SCHEMA)).explain()
    assert not re.search("Python|Arrow|Exchange", capsys.readouterr().out)
