"""License scans: ordered signature rules over words, DataFrame functions only.

1. A text is lower-cased and cut into its words; each word is written with a space on both sides, so that a
   pattern begins and ends at words and neighbouring matches share no sign.
2. Keyword prefilter: the distinct words of a text are cut down to those that some rule's keyword needs; the
   keyword phrases that these can form are looked for as literals, and only the patterns of phrases that are there
   run, over the whole text. A text without such words passes with no pattern at all.
3. Every match is a detection (first word, word after the last, rule). In order of their first words, longest
   first, a detection gives way to another that contains its interval and has the same or a better rank; of
   equal intervals and ranks the rule that stands first stays. Running maxima of ends for each rank decide that
   in one pass.
4. The base phrases are rules as well, of the weakest rank. Their places are counted before any suppression,
   and their labels stay.

There is no shuffle: each document is judged on its own row, and lists are as long as its detections.
Running lists are built in pieces of ``PIECE``, so that thousands of detections don't copy each other.

Defined cases: a null text is an empty one; texts without words have no detections, score 0 and no places;
repeated rows stay repeated; null keys stay null; other columns pass through; columns named like an output raise
``ValueError``; an empty table gives an empty table. Beyond A-Z, lower-casing changes letters outside of ASCII,
which are in no rule (the Kelvin sign becomes k, which no base phrase has).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_or_empty
from lodestone.llm.license_rules import PHRASE, RULES, Rule

OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections", "n_suppressed")
#: Everything of ASCII that is neither a digit nor a lower-case letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Signs of control mark a match; they are in no word.
OPEN, CLOSE = "\x01", "\x02"
PIECE = 512
_RULE = "number int, label string, rank int, confidence double, base boolean, pattern string"
_GROUP = f"array<struct<words:array<string>,phrase:string,rules:array<struct<number:int,label:string,rank:int,confidence:double,base:boolean,pattern:string>>>>"
_FOUND = "start int, stop int, rank int, rule int, label string, confidence double"


def spaced(words: str) -> str:
    """The literal or pattern as it stands in a text whose words have a space on both sides."""
    return f" {words.replace(' ?', '(?: )?').replace(' ', '  ')} "


def pattern_of(rule: Rule) -> str:
    return f" ({rule.pattern.replace(' ?', '(?: )?').replace(' ', '  ')}) "


def _groups(rules: tuple[Rule, ...]) -> list[dict]:
    """Rules by keyword phrase, with the words that the phrase needs."""
    groups: dict[str, list[Rule]] = {}
    for rule in rules:
        for phrase in rule.keyword.split("|"):
            groups.setdefault(phrase, []).append(rule)
    told = lambda r: {"number": r.number, "label": r.label, "rank": r.rank, "confidence": r.confidence, "base": r.base, "pattern": pattern_of(r)}
    return [{"words": sorted(set(p.split(" "))), "phrase": spaced(p), "rules": [told(r) for r in of]} for p, of in groups.items()]


def _with(value: Column, function) -> Column:
    """``function`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _spans(padded: Column, rule: Column) -> Column:
    """The places where a rule matches: (start, negative stop, rank, rule, label, confidence, base)."""

    def found(marked: Column) -> Column:
        words = F.split(F.trim(marked), " {2}")
        at = lambda test: F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
        starts, stops = at(lambda w: F.startswith(w, F.lit(OPEN))), at(lambda w: F.endswith(w, F.lit(CLOSE)))
        return F.zip_with(
            starts,
            stops,
            lambda a, b: F.struct(
                a.alias("start"), (-1 - b).alias("end"), rule["rank"].alias("rank"), rule["number"].alias("rule"),
                rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base"),
            ),
        )

    nothing = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,rank:int,rule:int,label:string,confidence:double,base:boolean>>")
    marked = F.regexp_replace(padded, rule["pattern"], F.lit(f" {OPEN}$1{CLOSE} "))
    return _with(marked, lambda m: F.when(F.contains(m, F.lit(OPEN)), found(m)).otherwise(nothing))


def _surviving(ordered: Column) -> Column:
    """Of detections in order of (start, longest, rank, rule): those that none before contains with the same or a better rank."""
    kind = "array<struct<start:int,end:int,rank:int,rule:int,label:string,confidence:double,base:boolean>>"
    ends = F.array_repeat(F.lit(0), PHRASE)  # greatest stop so far of detections of at most each rank
    nothing = F.from_json(F.lit("[]"), kind)

    def step(state: Column, d: Column) -> Column:
        stop = -d["end"]
        covered = F.element_at(state["ends"], d["rank"]) >= stop
        reached = F.transform(state["ends"], lambda e, i: F.when(i + 1 >= d["rank"], F.greatest(e, stop)).otherwise(e))
        left = F.when(covered, state["left"]).otherwise(F.concat(state["left"], F.array(d)))
        return F.struct(reached.alias("ends"), left.alias("left"))

    def piece(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["ends"].alias("ends"), nothing.alias("left")), step)
        return _with(inner, lambda s: F.struct(s["ends"].alias("ends"), F.concat(state["left"], s["left"]).alias("left")))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / PIECE).cast("int")), lambda k: F.slice(ordered, k * PIECE + 1, F.lit(PIECE)))
    all_of = F.aggregate(pieces, F.struct(ends.alias("ends"), nothing.alias("left")), piece, lambda s: s["left"])
    return F.when(F.size(ordered) == 0, nothing).otherwise(all_of)


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without their text, with counts, labels, a score and the detections (start, stop, rule, label, confidence).

    ``score`` is the greatest confidence of a detection that stays, 0 where there is none.
    """
    helpers = ("_padded", "_groups", "_found", "_base", "_left")
    if {*OUTPUTS, *helpers} & set(docs.columns):
        raise ValueError(f"the columns {', '.join((*OUTPUTS, *helpers))} are the operator's")
    groups = _groups(rules)
    table = F.from_json(F.lit(json.dumps(groups)), _GROUP)
    needed = F.from_json(F.lit(json.dumps(sorted({w for g in groups for w in g["words"]}))), "array<string>")

    folded = F.trim(F.regexp_replace(F.lower(text_or_empty(text)), BETWEEN, "  "))
    step = docs.withColumn("_padded", F.when(folded == "", "").otherwise(F.concat(F.lit(" "), folded, F.lit(" "))))
    step = step.withColumn("n_words", F.floor((F.length("_padded") - F.length(F.replace("_padded", F.lit(" "), F.lit("")))) / 2))
    words = F.array_intersect(F.split("_padded", " +"), needed)
    there = lambda g, w: (F.size(F.array_except(g["words"], w)) == 0) & F.contains(F.col("_padded"), g["phrase"])
    chosen = _with(words, lambda w: F.when(F.size(w) > 0, F.filter(table, lambda g: there(g, w))))
    step = step.withColumn("_groups", chosen).withColumn("_groups", F.array_distinct(F.flatten(F.transform("_groups", lambda g: g["rules"]))))
    step = step.withColumn("_found", F.flatten(F.transform("_groups", lambda r: _spans(F.col("_padded"), r))))
    step = step.withColumn("_found", F.array_sort(F.coalesce("_found", F.from_json(F.lit("[]"), step.schema["_found"].dataType))))
    step = step.withColumns({"_base": F.filter("_found", lambda d: d["base"]), "_left": _surviving(F.col("_found"))})
    label = lambda c: F.array_sort(F.array_distinct(c))
    base = F.transform("_base", lambda d: d["label"])
    shown = F.transform(
        "_left",
        lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("stop"), d["rule"].alias("rule"), d["label"].alias("label"), d["confidence"].alias("confidence")),
    )
    return step.select(
        *(c for c in docs.columns if c != text),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("_base", lambda d: d["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("_base", lambda d: d["start"])).cast("bigint").alias("last_word"),
        F.array_join(label(base), ",").alias("base_labels"),
        F.array_join(label(F.concat(base, F.transform("_left", lambda d: d["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_left", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        (F.size("_found") - F.size("_left")).cast("bigint").alias("n_suppressed"),
        shown.alias("detections"),
    )
