"""Text columns: tokens, bi-grams, escaping. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}]+)"

# Code-point ranges that take part in bi-grams (hiragana, katakana,
# CJK extension A, CJK unified, CJK compatibility, half-width katakana, and the
# three marks U+3005, U+3006, U+303B).
CJK_CLASS = (
    "\u3040-\u309f\u30a0-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\uff66-\uff9f\u3005\u3006\u303b"
)
#: One range with all of them, which is quicker to test.
CJK_RANGE = "[\u3005-\uff9f]"


def words(text: Column) -> Column:
    """Lower-cased tokens: maximal runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def cjk_runs(text: Column) -> Column:
    """Runs of two and more characters that take part in bi-grams."""
    return F.regexp_extract_all(text, F.lit(f"([{CJK_CLASS}]{{2,}})"), F.lit(1))


def cjk_bigrams(text: Column, separate: bool = False) -> Column:
    """Overlapping two-character tokens of every CJK run, in text order.

    ``separate`` puts an empty token after each run, so tokens of different runs do
    not look adjacent.
    """
    def of_run(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(run) - 1)
        tokens = F.transform(starts, lambda i: F.substring(run, i, F.lit(2)))
        return F.array_append(tokens, F.lit("")) if separate else tokens

    return F.flatten(F.transform(cjk_runs(text), of_run))


def is_cjk_term(term: Column) -> Column:
    return term.rlike(f"^[{CJK_CLASS}]{{2,}}$")


_INSIDE, _OUTSIDE = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def occurrences(text: Column, needle: str) -> Column:
    """How often ``needle`` occurs in ``text``, overlaps counted."""
    return F.regexp_count(text, F.lit(f"{quote_regex(needle[0])}(?={quote_regex(needle[1:])})"))


def phrase_count(text: Column, phrase: list[str]) -> Column:
    """How often the token sequence ``phrase`` occurs in lower-cased ``text``.

    A search for the first word with its neighbourhood checked; no token list is built.
    """
    first = quote_regex(phrase[0])
    rest = "".join(f"{_OUTSIDE}+{quote_regex(w)}" for w in phrase[1:])
    pattern = f"{first}(?<!{_INSIDE}{first})(?={rest}(?!{_INSIDE}))"
    return F.regexp_count(text, F.lit(pattern))


# The five characters escaped in HTML output.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def html_escape(text: Column) -> Column:
    for raw, escaped in HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def strip_html(text: Column) -> Column:
    """Tags removed, then the escapes of :func:`html_escape` undone, then trimmed."""
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for raw, escaped in reversed(HTML_ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(raw))
    return F.trim(text)


def quote_regex(literal: str) -> str:
    """``literal`` as a Java pattern that matches exactly itself."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def length_keeping_lower(text: Column) -> Column:
    """Lower case with one output character per input character.

    U+0130 is the one letter whose lower form is two characters long.
    """
    return F.lower(F.translate(text, "İ", "I"))


def once(value: Column) -> Column:
    """A value that filters on it do not compute again.

    A filter on a plain expression is moved below the projection, which then evaluates
    it a second time for the rows that pass. It cannot be moved below a generator.
    """
    return F.explode_outer(F.array(value))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often it is used.

    For expressions of a few result rows; it runs outside generated code.
    """
    return F.get(F.transform(F.array(value), body), 0)
