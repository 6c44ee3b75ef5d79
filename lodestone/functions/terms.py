"""Query text to terms, as columns over a table of queries and for one request."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def raw_terms(q: Column) -> Column:
    return F.filter(F.split(q, r"(?U)\s+"), lambda t: t != "")


def _is_exclusion(term: Column) -> Column:
    return term.startswith("-") & (F.length(term) > 1)


def include_terms(q: Column) -> Column:
    """Terms to find. When every term has a minus sign they are all searched for."""
    terms = raw_terms(q)
    kept = F.transform(
        F.filter(terms, lambda t: ~_is_exclusion(t)),
        lambda t: F.when(t.startswith("\\-"), F.substring(t, F.lit(2), F.length(t))).otherwise(t),
    )
    return F.when(F.size(kept) > 0, kept).otherwise(terms)


def exclude_terms(q: Column) -> Column:
    terms = raw_terms(q)
    dropped = F.filter(terms, _is_exclusion)
    return F.when(
        F.size(dropped) < F.size(terms),
        F.transform(dropped, lambda t: F.substring(t, F.lit(2), F.length(t))),
    ).otherwise(F.array().cast("array<string>"))


def needs_literal_match(term: Column) -> Column:
    """Leading hyphen, or ASCII letters mixed with digits: substring search."""
    return term.startswith("-") | (term.rlike("[A-Za-z]") & term.rlike(r"\p{Nd}"))


@F.pandas_udf(T.StringType())
def normalize_query(q: pd.Series) -> pd.Series:
    """Key of the click history: NFKC, case folded, single spaces."""
    return q.map(lambda s: None if s is None else history_key(s))


def history_key(q: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", q).casefold().split())


@F.pandas_udf(T.StringType())
def casefold(terms: pd.Series) -> pd.Series:
    """Case folding of terms, in which ``ß`` equals ``ss``; ``lower`` would keep them apart."""
    return terms.map(lambda s: None if s is None else s.casefold())


@F.pandas_udf(T.ArrayType(T.StringType()))
def distinct_variants(typed: pd.Series, members: pd.Series) -> pd.Series:
    """The typed term and the members of its group, one spelling of each folded form."""
    groups = ([t, *(() if m is None else m)] for t, m in zip(typed, members))
    return pd.Series([fold_unique(x for x in group if x is not None) for group in groups], dtype=object)


def expand_terms(terms: DataFrame, rules: DataFrame) -> DataFrame:
    """Synonym variants of each (query_id, term_index, term).

    ``rules`` holds (group_id, position, term). The lowest group that lists the
    term wins; the typed spelling comes first. Terms are compared case folded.
    """
    folded = terms.withColumn("folded", casefold("term"))
    claim = rules.groupBy(casefold("term").alias("folded")).agg(F.min("group_id").alias("group_id"))
    groups = rules.groupBy("group_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "term"))), lambda s: s["term"]
        ).alias("members")
    )
    return (
        folded.join(claim, "folded", "left")
        .join(groups, "group_id", "left")
        .withColumn("variants", distinct_variants("term", "members"))
        .select("query_id", "term_index", F.posexplode_outer("variants").alias("variant_index", "term"))
    )


def highlight_terms(groups: Column) -> Column:
    """All variants of all terms, first spelling kept per lower-cased form."""
    return F.aggregate(
        F.flatten(groups),
        F.array().cast("array<string>"),
        lambda acc, t: F.when(
            F.exists(acc, lambda seen: F.lower(seen) == F.lower(t)), acc
        ).otherwise(F.array_append(acc, t)),
    )


# --- the same rules for one request held by the driver -----------------------


def split_query(q: str) -> tuple[list[str], list[str]]:
    terms = q.split()
    excluded = [t[1:] for t in terms if len(t) > 1 and t[0] == "-"]
    included = [t.removeprefix("\\") if t.startswith("\\-") else t for t in terms]
    included = [t for raw, t in zip(terms, included) if not (len(raw) > 1 and raw[0] == "-")]
    return (included, excluded) if included else (terms, [])


def fold_unique(values: Iterable[str]) -> list[str]:
    first: dict[str, str] = {}
    for value in values:
        first.setdefault(value.casefold(), value)
    return list(first.values())


def variants_of(term: str, synonyms: Sequence[Sequence[str]]) -> list[str]:
    wanted = term.casefold()
    for group in synonyms:
        if wanted in {member.casefold() for member in group}:
            return fold_unique([term, *group])
    return [term]


def is_literal(term: str) -> bool:
    letters = any(c.isascii() and c.isalpha() for c in term)
    return term.startswith("-") or (letters and any(c.isdigit() for c in term))


def word_list(term: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in term.lower()).split()
