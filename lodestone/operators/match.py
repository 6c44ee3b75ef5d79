"""Which files match the terms of one request, and by which field.

A file and its body meet in one row, so "all terms present", the match level and the
best hit are plain column arithmetic: no union of branches and no grouping.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.functions import scores as sc
from lodestone.functions import terms as tm
from lodestone.functions import text as tx
from lodestone.operators import scope as so
from lodestone.operators.grams import named_files
from lodestone.request import SearchRequest
from lodestone.session import cut_lineage

# Rank of a hit by where it was found; the lower the better.
BODY, BIGRAM, NAME, TITLE, ALIAS = range(5)
SEGMENT_TYPES = ("body", "cjk_bigram", "filename", "title", "alias")


@dataclass(frozen=True)
class Unit:
    """One way to satisfy one term of the query: the term or a synonym of it."""

    term_index: int
    term: str
    mode: str  # 'literal', 'phrase' or 'bigram'

    @property
    def words(self) -> list[str]:
        return tm.word_list(self.term)


def variants(request: SearchRequest) -> list[list[str]]:
    included, _ = tm.split_query(request.q)
    return [tm.variants_of(term, request.synonyms) for term in included]


def body_units(groups: list[list[str]]) -> list[Unit]:
    units = []
    for index, group in enumerate(groups):
        for term in group:
            if tm.is_literal(term):
                units.append(Unit(index, term, "literal"))
                continue
            if tm.word_list(term):
                units.append(Unit(index, term, "phrase"))
            if is_cjk(term):
                units.append(Unit(index, term, "bigram"))
    return units


def is_cjk(term: str) -> bool:
    return re.fullmatch(f"[{tx.CJK_CLASS}]{{2,}}", term) is not None


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _least(values: list[Column]) -> Column:
    return values[0] if len(values) == 1 else F.least(*values)


# --- body hits ---------------------------------------------------------------


def _frequency_columns(units: list[Unit]) -> list[Column]:
    """Occurrences ``tf_k`` of every unit in the lower-cased column ``text``.

    A plain substring test comes first, so most bodies never meet a pattern.
    """
    text = F.col("text")

    def column(unit: Unit) -> Column:
        parts = unit.words if unit.mode == "phrase" else [unit.term.lower()]
        present = reduce(lambda a, b: a & b, [text.contains(p) for p in parts])
        if unit.mode == "literal":
            return present.cast("int")
        count = (
            tx.phrase_count(text, unit.words)
            if unit.mode == "phrase"
            else tx.occurrences(text, unit.term.lower())
        )
        return F.when(present, count).otherwise(0)

    return [column(u).alias(f"tf_{k}") for k, u in enumerate(units)]


def scan_frequencies(segments: DataFrame, units: list[Unit]) -> DataFrame:
    """Occurrences of every unit in every body that has one, by a pass over the bodies."""
    rows = segments.select("file_id", "n_tokens", F.lower("content").alias("text"))
    counted = rows.select("file_id", "n_tokens", tx.once(F.struct(*_frequency_columns(units))).alias("c"))
    return counted.select("file_id", "n_tokens", "c.*").where(
        _any([F.col(f"tf_{k}") > 0 for k in range(len(units))])
    )


def _unit_tokens(unit: Unit) -> tuple[str, list[str]]:
    """Kind and tokens by which the postings know a unit."""
    if unit.mode == "bigram":
        return "bigram", [unit.term[i : i + 2] for i in range(len(unit.term) - 1)]
    return "word", unit.words


#: A word that is so many times as frequent as a phrase's rarest one waits for the rarest one's files.
FOLLOWS = 4


def _of_tokens(pairs: Iterable[tuple[str, str]]) -> Column:
    kinds: dict[str, list[str]] = {}
    for kind, token in sorted(pairs):
        kinds.setdefault(kind, []).append(token)
    return _any([(F.col("kind") == kind) & F.col("term").isin(*tokens) for kind, tokens in kinds.items()])


def followers(units: list[Unit], counts: dict[tuple[str, str], int]) -> tuple[set, set]:
    """(leads, followers) of the phrases: their rarest tokens, and frequent ones that only matter beside those."""
    phrases = [[(kind, t) for t in ts] for kind, ts in map(_unit_tokens, units) if len(ts) > 1]
    alone = {(kind, ts[0]) for kind, ts in map(_unit_tokens, units) if len(ts) == 1}
    of = lambda pair: (counts.get(pair, 0), pair)
    leads = {min(p, key=of) for p in phrases}
    needed = {pair: [counts.get(min(p, key=of), 0) for p in phrases if pair in p] for p in phrases for pair in p}
    slow = {pair for pair, least in needed.items() if counts.get(pair, 0) >= FOLLOWS * max(1, *least)}
    return leads, slow - leads - alone


def _rare_first(postings: DataFrame, terms: DataFrame | None, units: list[Unit], wanted: list[tuple[str, str]]) -> DataFrame:
    """Postings of the wanted tokens; frequent words of a phrase only in files that hold its rarest word.

    The counts of the request's own tokens come to the driver, the files of the rarest ones are kept as a table, so
    that Spark knows its size: if it is small the frequent words' rows are dropped where they are read.
    """
    rows = postings.where(_of_tokens(wanted))
    if terms is None or all(len(_unit_tokens(u)[1]) == 1 for u in units):
        return rows
    counts = {(r.kind, r.term): r.df for r in terms.where(_of_tokens(wanted)).select("kind", "term", "df").collect()}
    leads, slow = followers(units, counts)
    if not slow:
        return rows
    holding = cut_lineage(postings.where(_of_tokens(leads)).select("file_id").distinct())
    first = postings.where(_of_tokens(set(wanted) - slow))
    return first.unionByName(postings.where(_of_tokens(slow)).join(holding, "file_id", "left_semi"))


def posting_frequencies(postings: DataFrame, units: list[Unit], terms: DataFrame | None = None) -> DataFrame:
    """The same as :func:`scan_frequencies`, read from postings.

    The term filter reaches the sorted Parquet files, so only the row groups of the
    wanted terms are read. A phrase is a run of positions; with ``terms`` (document counts) it
    starts from its rarest word.
    """
    wanted = sorted({(kind, t) for kind, ts in map(_unit_tokens, units) for t in ts})
    rows = _rare_first(postings, terms, units, wanted)
    # Counts suffice for a single token; positions are read for phrases only.
    sides = [_unit_tokens(u) for u in units]
    counted = {(kind, ts[0]) for kind, ts in sides if len(ts) == 1}
    placed = {(kind, t) for kind, ts in sides if len(ts) > 1 for t in ts}
    at = {pair: f"at_{i}" for i, pair in enumerate(wanted)}
    if len(wanted) == 1:  # no other token, nothing to group
        found = rows.select(
            "file_id", "n_tokens", F.col("tf").alias("n_at_0"), F.col("positions").alias("at_0")
        )
    else:

        def of(pair: tuple[str, str], column: str) -> Column:
            return F.max(F.when((F.col("kind") == pair[0]) & (F.col("term") == pair[1]), F.col(column)))

        found = rows.groupBy("file_id").agg(
            F.max("n_tokens").alias("n_tokens"),
            *[of(pair, "tf").alias(f"n_{at[pair]}") for pair in sorted(counted)],
            *[of(pair, "positions").alias(at[pair]) for pair in sorted(placed)],
        )

    def shifted(name: str, offset: int) -> Column:
        return F.transform(name, lambda p: p - offset)

    def tf(unit: Unit) -> Column:
        kind, tokens = _unit_tokens(unit)
        if len(tokens) == 1:
            return F.coalesce(f"n_{at[(kind, tokens[0])]}", F.lit(0))
        starts = F.col(at[(kind, tokens[0])])
        for offset, token in enumerate(tokens[1:], start=1):
            starts = F.array_intersect(starts, shifted(at[(kind, token)], offset))
        return F.coalesce(F.size(starts), F.lit(0))

    return found.select(
        "file_id", "n_tokens", *[tf(u).alias(f"tf_{k}") for k, u in enumerate(units)]
    ).where(_any([F.col(f"tf_{k}") > 0 for k in range(len(units))]))


def _known_counts(terms: DataFrame, units: list[Unit]) -> DataFrame:
    """Document counts of single-token units, looked up instead of counted."""
    sides = [_unit_tokens(u) for u in units]
    tokens = sorted({ts[0] for _, ts in sides})

    def of(kind: str, token: str) -> Column:
        mine = (F.col("kind") == kind) & (F.col("term") == token)
        return F.coalesce(F.max(F.when(mine, F.col("df"))), F.lit(0))

    columns = [of(kind, ts[0]).alias(f"df_{k}") for k, (kind, ts) in enumerate(sides)]
    return terms.where(F.col("term").isin(*tokens)).agg(*columns)


def _totals(corpus, frequencies: DataFrame | None, units: list[Unit]) -> DataFrame:
    """One row: corpus size, mean length, and the document count of every unit."""
    counts = [F.count_if(F.col(f"tf_{k}") > 0).alias(f"df_{k}") for k in range(len(units))]
    if frequencies is not None:
        row = corpus.statistics().agg(F.first("n_docs").alias("n_docs"), F.first("avg_tokens").alias("avg_tokens"))
        counted = frequencies.agg(*counts)
        if corpus.terms is not None and all(u.mode != "literal" and len(_unit_tokens(u)[1]) == 1 for u in units):
            counted = _known_counts(corpus.terms, units)
        return row.withColumn("df", counted.select(F.struct("*").alias("v")).scalar()).select(
            "n_docs", "avg_tokens", "df.*"
        )
    # Without stored statistics one pass over the bodies yields them all.
    rows = corpus.segments.select("n_tokens", F.lower("content").alias("text"))
    return rows.select("n_tokens", *_frequency_columns(units)).agg(
        F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"), *counts
    )


def _scored(corpus, frequencies: DataFrame, units: list[Unit]) -> DataFrame:
    """One best body score and one best bi-gram score per term, NULL where absent."""
    if any(u.mode != "literal" for u in units):
        known = frequencies if corpus.stats is not None else None
        totals = _totals(corpus, known, units)
        frequencies = frequencies.withColumn("t", totals.select(F.struct("*").alias("v")).scalar())
    by_slot: dict[str, list[Column]] = {}
    for k, unit in enumerate(units):
        score = F.lit(0.0)
        if unit.mode != "literal":
            score = sc.bm25(
                F.col(f"tf_{k}"), F.col("n_tokens"), F.col(f"t.df_{k}"), F.col("t.n_docs"), F.col("t.avg_tokens")
            )
        slot = f"{'bigram' if unit.mode == 'bigram' else 'body'}_{unit.term_index}"
        by_slot.setdefault(slot, []).append(F.when(F.col(f"tf_{k}") > 0, score))
    return frequencies.select("file_id", *[_least(values).alias(slot) for slot, values in by_slot.items()])


def match_body(corpus, units: list[Unit]) -> list[DataFrame]:
    """Score tables of the units. With postings only literals read the bodies."""
    if corpus.postings is None:
        return [_scored(corpus, scan_frequencies(corpus.segments, units), units)] if units else []
    literal = [u for u in units if u.mode == "literal"]
    indexed = [u for u in units if u.mode != "literal"]
    tables = []
    if indexed:
        tables.append(_scored(corpus, posting_frequencies(corpus.postings, indexed, corpus.terms), indexed))
    if literal:
        table = _scored(corpus, scan_frequencies(corpus.segments, literal), literal)
        tables.append(
            table.select("file_id", *[F.col(c).alias(f"literal_{c}") for c in table.columns if c != "file_id"])
        )
    return tables


# --- whole rows --------------------------------------------------------------


def level_of(n_terms: int, q: str, names: list[Column], titles: list[Column], aliases: list[Column]) -> Column:
    """How well names match, 8 down to 0."""

    def number(tests: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [t.cast("int") for t in tests])

    query = q.lower()
    in_name, in_title, in_alias = number(names), number(titles), number(aliases)
    in_meta = number([t | a for t, a in zip(titles, aliases)])
    file_name = F.lower("file_name")
    stem = F.lower(px.name_stem(F.col("file_name"), F.col("file_ext")))
    return (
        F.when((in_name == n_terms) & (stem == query), 8)
        .when((in_name == n_terms) & file_name.contains(query), 7)
        .when(in_name == n_terms, 6)
        .when((in_title == n_terms) & (F.lower("title") == query), 5)
        .when(in_title == n_terms, 4)
        .when(in_alias == n_terms, 3)
        .when(in_name > 0, 2)
        .when(in_meta > 0, 1)
        .otherwise(0)
    )


def field_tests(groups: list[list[str]], column: Column) -> list[Column]:
    """Per term: some variant of it occurs in the lower-cased column."""
    return [_any([F.lower(column).contains(v.lower()) for v in group]) for group in groups]


def match_files(corpus, scoped: DataFrame, request: SearchRequest) -> DataFrame:
    """Scoped files that satisfy every term, with rank, score, type and level.

    Names are tested in the scan of the files, and body hits of a file meet before the
    files do. So only two kinds of file rows take part in a join: those with some hit in a
    name, and, in an inner join with a narrow table of ids, those whose body has all terms.
    """
    groups = variants(request)
    n = len(groups)
    if n == 0 or not (request.wants_body or request.wants_name):
        return _no_match(scoped)
    units = body_units(groups) if request.wants_body else []
    by_gram = None if units else named_files(corpus, groups)
    if by_gram is not None:
        # A search for names only: the grams' files, few as a rule, are the rows that names are tested on.
        scoped = scoped.join(cut_lineage(by_gram), "file_id", "left_semi")
    tables = match_body(corpus, units)
    body_hits = reduce(lambda a, b: a.join(b, "file_id", "full_outer"), tables) if tables else None
    no, never = F.lit(None).cast("double"), [F.lit(False)] * n

    def slot(kind: str, i: int) -> Column:
        names = [c for c in (f"{kind}_{i}", f"literal_{kind}_{i}") if body_hits is not None and c in body_hits.columns]
        return _least([F.col(c) for c in names]) if names else no

    bodies = [slot("body", i) for i in range(n)]
    bigrams = [slot("bigram", i) for i in range(n)]
    names = titles = aliases = never
    if request.wants_name:
        names = field_tests(groups, F.col("file_name"))
        titles = field_tests(groups, F.coalesce("title", F.lit("")))
        aliases = field_tests(groups, F.coalesce(F.array_join("aliases", "\n"), F.lit("")))

    def hit(rank: int, score: Column, present: Column) -> Column:
        return F.when(present, F.struct(F.lit(rank).alias("match_rank"), score.alias("score")))

    by_name = F.lit(sc.NAME_SCORE)
    hits = []
    for i in range(n):
        hits += [
            hit(BODY, bodies[i], bodies[i].isNotNull()),
            hit(BIGRAM, bigrams[i], bigrams[i].isNotNull()),
            hit(NAME, by_name, names[i]),
            hit(TITLE, by_name, titles[i]),
            hit(ALIAS, by_name, aliases[i]),
        ]
    satisfied = [
        bodies[i].isNotNull() | bigrams[i].isNotNull() | names[i] | titles[i] | aliases[i] for i in range(n)
    ]
    rows = scoped
    if body_hits is not None:
        all_in_body = reduce(lambda a, b: a & b, [bodies[i].isNotNull() | bigrams[i].isNotNull() for i in range(n)])
        named = F.coalesce(_any([*names, *titles, *aliases]), F.lit(False)) if request.wants_name else F.lit(False)
        rows = scoped.where(~named).join(body_hits.where(all_in_body), "file_id")
        if request.wants_name:
            rows = rows.unionByName(scoped.where(named).join(body_hits, "file_id", "left"))
    matched = rows.where(reduce(lambda a, b: a & b, satisfied))
    kinds = F.array(*[F.lit(t) for t in SEGMENT_TYPES])
    return (
        matched.withColumn("best", F.array_min(F.array(*hits)))
        .withColumn("filename_match_level", level_of(n, request.q.strip(), names, titles, aliases))
        .select(*scoped.columns, "best.match_rank", "best.score", "filename_match_level")
        .withColumn("segment_type", F.get(kinds, F.col("match_rank")))
    )


def _no_match(scoped: DataFrame) -> DataFrame:
    return scoped.where(F.lit(False)).select(
        "*",
        F.lit(0).alias("match_rank"),
        F.lit(0.0).alias("score"),
        F.lit(0).alias("filename_match_level"),
        F.lit("body").alias("segment_type"),
    )


def drop_mentions(corpus, df: DataFrame, excluded: list[str]) -> DataFrame:
    """Remove files that mention an excluded term in name, folder or body."""
    if not excluded:
        return df
    kept = so.exclude_terms(df, excluded, body=None)
    bodies = corpus.segments.where(so.mentions(excluded, F.col("content"))).select("file_id")
    return kept.join(bodies, "file_id", "left_anti")


# --- the branch form, for callers that hold hits as rows ----------------------


def union_hits(*branches: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), branches)


def qualify(hits: DataFrame, n_terms: int) -> DataFrame:
    """Files whose hits cover all terms, with per-field term counts.

    ``hits`` holds (file_id, term_index, match_rank, score).
    """

    def terms_in(*ranks: int) -> Column:
        return F.count_distinct(F.when(F.col("match_rank").isin(*ranks), F.col("term_index")))

    return (
        hits.groupBy("file_id")
        .agg(
            F.count_distinct("term_index").alias("n_terms"),
            terms_in(NAME).alias("in_name"),
            terms_in(TITLE).alias("in_title"),
            terms_in(ALIAS).alias("in_alias"),
        )
        .where(F.col("n_terms") == n_terms)
    )


def best_hit(hits: DataFrame, keys: list[str] = ("file_id",)) -> DataFrame:
    """The hit with the smallest (rank, score) of each key, by one aggregate."""
    return (
        hits.groupBy(*keys)
        .agg(F.min(F.struct("match_rank", "score")).alias("best"))
        .select(*keys, "best.match_rank", "best.score")
    )
