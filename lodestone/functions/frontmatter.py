"""Properties at the head of a Markdown text: title, aliases, pin tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _head(text: Column) -> Column:
    """Lines between the two dashed lines a text may begin with; NULL without them."""

    def between(lines: Column) -> Column:
        bare = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda line: F.rtrim(line, F.lit(" \t")))
        end = F.array_position(bare, F.lit("---"))
        opens = F.rtrim(F.get(lines, 0), F.lit(" \t")) == "---"
        return F.when(opens, _let(end, lambda n: F.when(n > 1, F.slice(lines, F.lit(2), n - 1))))

    return F.when(text.startswith("---"), _let(F.split(text, r"\r?\n"), between))


def _is_item(line: Column) -> Column:
    """An indented line with a dash carries on the property above it."""
    return (F.ltrim(line, F.lit(" \t")) != line) & F.ltrim(line, F.lit(" \t")).startswith("-")


def _properties(text: Column, *keys: str) -> Column:
    """Each property of one of the keys as its lines: ``key: value``, then its items."""

    def runs(head: Column) -> Column:
        numbered = F.sequence(F.lit(1), F.greatest(F.size(head), F.lit(1)))
        starts = F.filter(numbered, lambda i: ~_is_item(F.get(head, i - 1)))

        def cut(at: Column) -> Column:
            return F.transform(at, lambda s, k: F.slice(head, s, F.coalesce(F.get(at, k + 1), F.size(head) + 1) - s))

        return _let(starts, cut)

    return F.filter(_let(_head(text), runs), lambda run: F.get(run, 0).contains(":") & _key(run).isin(*keys))


def _key(run: Column) -> Column:
    return F.lower(F.btrim(F.substring_index(F.get(run, 0), ":", 1), F.lit(" \t")))


def _tokens(run: Column) -> Column:
    """Comma-separated values of a property and of its items, quotes and brackets stripped."""
    first = F.get(run, 0)
    value = F.substring(first, F.locate(":", first) + 1, F.length(first))
    items = F.transform(
        F.slice(run, F.lit(2), F.size(run)),
        lambda line: F.substring(F.ltrim(line, F.lit(" \t")), F.lit(2), F.length(line)),
    )
    pieces = F.flatten(F.transform(F.concat(F.array(value), items), lambda p: F.split(p, ",")))
    return F.transform(
        pieces, lambda p: F.btrim(F.regexp_replace(p, r"^\s+|\s+$", ""), F.lit("[]'\" "))
    )


def _values(prop: Column) -> Column:
    return F.filter(_tokens(prop), lambda v: v != "")


def front_matter_title(text: Column) -> Column:
    firsts = F.filter(
        F.transform(_properties(text, "title"), lambda p: F.get(_values(p), 0)),
        lambda v: v.isNotNull(),
    )
    return F.coalesce(F.try_element_at(firsts, F.lit(-1)), F.lit(""))


def front_matter_aliases(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(_properties(text, "aliases", "alias"), _values)))


def has_pin_tag(text: Column) -> Column:
    """The first ``tag``/``tags`` property holds ``top``."""
    first = F.get(_properties(text, "tags", "tag"), 0)
    hit = F.exists(_tokens(first), lambda t: F.lower(F.ltrim(t, F.lit("#"))) == "top")
    return F.coalesce(hit, F.lit(False))
