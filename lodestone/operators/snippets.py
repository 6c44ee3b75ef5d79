"""Extracts with marked terms. Run them after paging: only shown rows need one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.functions import text as tx
from lodestone.operators import index as ix
from lodestone.session import cut_lineage

RADIUS = 48
CONTEXT_TOKENS = 36
RECORD_CHARS = 280
# The wording of hits outside the body.
NAME_HIT = "ファイル名一致: "
FOLDER_HIT = "フォルダー名一致: "
NAME_ONLY_NOTE = (
    "。 本文中には検索語の直接一致が見つからなかったため、ファイル名ベースの候補として表示しています。"
)


def _escape_text(value: str) -> str:
    for raw, escaped in tx.HTML_ESCAPES:
        value = value.replace(raw, escaped)
    return value


def mark_terms(escaped: Column, terms: list[str]) -> Column:
    """Mark every term in already escaped text, the longest alternative first."""
    literals = [tx.quote_regex(_escape_text(t)) for t in sorted(set(terms), key=lambda t: (-len(t), t)) if t]
    if not literals:
        return escaped
    return F.regexp_replace(escaped, f"(?iu)({'|'.join(literals)})", "<mark>$1</mark>")


def _window(text: Column, begin: Column, end: Column, terms: list[str]) -> Column:
    return F.concat(
        F.when(begin > 0, F.lit("...")).otherwise(""),
        mark_terms(tx.html_escape(F.substring(text, begin + 1, end - begin)), terms),
        F.when(end < F.length(text), F.lit("...")).otherwise(""),
    )


def literal_snippet(text: Column, terms: list[str], radius: int = RADIUS) -> Column:
    """A window over the first place of every term; NULL when none occurs."""
    if not terms:
        return F.lit(None).cast("string")

    def spans(lowered: Column) -> Column:
        """(start, end) of the first place of each term that occurs."""
        found = [F.instr(lowered, F.lit(t.lower())) for t in terms]
        pairs = [F.struct((at - 1).alias("s"), (at - 1 + len(t)).alias("e")) for at, t in zip(found, terms)]
        return F.filter(F.array(*pairs), lambda p: p["s"] >= 0)

    def cut(places: Column) -> Column:
        begin = F.greatest(F.array_min(places["s"]) - radius, F.lit(0))
        end = F.least(F.array_max(places["e"]) + radius, F.length(text))
        return tx.let(F.struct(begin.alias("b"), end.alias("e")), lambda w: _window(text, w["b"], w["e"], terms))

    return tx.let(tx.let(tx.length_keeping_lower(text), spans), lambda p: F.when(F.size(p) > 0, cut(p)))


def token_snippet(text: Column, terms: list[str], width: int = CONTEXT_TOKENS) -> Column:
    """``width`` white-space separated words around the first one that holds a term."""
    if not terms:
        return F.lit(None).cast("string")

    def holds(word: Column) -> Column:
        return F.array_max(F.array(*[F.lower(word).contains(t.lower()) for t in terms]))

    def cut(pieces: Column, first: Column) -> Column:
        begin = F.greatest(first - width // 2, F.lit(1)).cast("int")
        return F.concat(
            F.when(begin > 1, F.lit(" ... ")).otherwise(""),
            mark_terms(tx.html_escape(F.array_join(F.slice(pieces, begin, width), " ")), terms),
            F.when(begin + width - 1 < F.size(pieces), F.lit(" ... ")).otherwise(""),
        )

    def around(pieces: Column) -> Column:
        first = F.array_position(F.transform(pieces, holds), F.lit(True))
        return tx.let(first, lambda at: F.when(at > 0, cut(pieces, at)))

    return tx.let(F.split(text, r"\s+"), around)


def name_snippet(file_name: Column) -> Column:
    name = tx.html_escape(file_name)
    return F.concat(F.lit(NAME_HIT + "<mark>"), name, F.lit("</mark>" + NAME_ONLY_NOTE))


def term_snippet(kind: Column, segment: Column, text: Column, folder: Column, name: Column, terms: list[str]) -> Column:
    """Body hits show the body, folder hits the folder, the rest the name."""
    body = F.coalesce(literal_snippet(text, terms), token_snippet(text, terms))
    in_folder = F.concat(F.lit(FOLDER_HIT), literal_snippet(folder, terms))
    shown = F.when(kind == "folder", in_folder).when(segment.isin("body", "cjk_bigram"), body)
    return F.coalesce(shown, name_snippet(name))


def regex_snippet(text: Column, pattern: str, radius: int | None = RADIUS) -> Column:
    """First match of the pattern with its surroundings; NULL without a match."""
    java = f"(?iu){pattern}"

    def cut(before: Column) -> Column:
        at = F.length(before)
        found = F.regexp_substr(F.substring(text, at + 1, F.length(text)), F.lit(java))
        return tx.let(F.struct(at.alias("at"), found.alias("m")), lambda h: shown(h["at"], h["m"]))

    def shown(at: Column, found: Column) -> Column:
        after = at + F.length(found)
        begin = F.lit(0) if radius is None else F.greatest(at - radius, F.lit(0))
        end = F.length(text) if radius is None else F.least(after + radius, F.length(text))
        return F.concat(
            F.when(begin > 0, F.lit("...")).otherwise(""),
            tx.html_escape(F.substring(text, begin + 1, at - begin)),
            F.lit("<mark>"),
            tx.html_escape(found),
            F.lit("</mark>"),
            tx.html_escape(F.substring(text, after + 1, end - after)),
            F.when(end < F.length(text), F.lit("...")).otherwise(""),
        )

    return tx.let(F.get(F.split(text, java, 2), 0), cut)


def regex_row_snippet(kind: Column, text: Column, name: Column, folder: Column, pattern: str, body: bool, names: bool) -> Column:
    in_body = F.when(text.rlike(f"(?iu){pattern}"), regex_snippet(text, pattern)) if body else F.lit(None)
    in_name = (
        F.when(name.rlike(f"(?iu){pattern}"), F.concat(F.lit(NAME_HIT), regex_snippet(name, pattern, None)))
        if names
        else F.lit(None)
    )
    in_folder = F.concat(F.lit(FOLDER_HIT), regex_snippet(folder, pattern, None))
    return F.when(kind == "folder", in_folder).otherwise(F.coalesce(in_body, in_name, name_snippet(name)))


def record_snippet(text: Column, terms: list[str]) -> Column:
    return mark_terms(tx.html_escape(F.substring(text, 1, RECORD_CHARS)), terms)


def add_snippets(
    page: DataFrame,
    segments: DataFrame,
    terms: list[str],
    pattern: str | None = None,
    body: bool = True,
    names: bool = True,
) -> DataFrame:
    """Snippets of one page.

    The page (at most 1,000 rows) is settled first. Its ids then go to the scan of the
    bodies as a filter, so only row groups that hold a shown body are read.
    """
    page = cut_lineage(page)
    ids = [row.file_id for row in page.where("result_kind = 'file'").select("file_id").collect()]
    bodies = ix.bodies_of(segments, ids).select("file_id", F.col("content").alias("_content"))
    joined = page.join(bodies, "file_id", "left")
    kind, name = F.col("result_kind"), F.col("file_name")
    text = F.coalesce("_content", F.lit(""))
    folder = F.when(kind == "folder", F.col("full_path")).otherwise(
        px.parent_folder(F.col("full_path"), name)
    )
    if pattern is None:
        snippet = term_snippet(kind, F.col("segment_type"), text, folder, name, terms)
    else:
        snippet = regex_row_snippet(kind, text, name, folder, pattern, body, names)
    return joined.withColumn("snippet", snippet).drop("_content")
