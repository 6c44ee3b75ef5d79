"""Raw files and stored pages to plain text.

Decoding, dispatch and plain text stay in the JVM. Only rows whose format needs a
real parser (linked Markdown, JSON, XML, HTML) pass through Arrow to a short helper,
and a row that fails there is reported in ``error`` while the job goes on.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from html.parser import HTMLParser
from itertools import accumulate, groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import extensions as ext
from lodestone.schemas import PAGE

PARSED = "text string, error string"
# Extensions read as they are, and those that go through a parser.
PLAIN = (".txt",)
MARKDOWN = (".md", ".excalidraw.md")
JSON = (".json", ".excalidraw")
EMBEDDED_JSON = (".dio", ".dio.svg")
XML = (".xml",)


def decode_utf8(content: Column) -> Column:
    """Bytes to text. Broken bytes are dropped, line ends become ``\\n``.

    The replacement character that marks a broken byte may also be part of the
    text, so genuine ones are hidden behind an escape meanwhile.
    """
    text = content.cast("string")
    hide = (("\x00", "\x00a"), ("�", "\x00b"))
    for raw, escaped in hide:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    text = F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    for raw, escaped in reversed(hide):
        text = F.replace(text, F.lit(escaped), F.lit(raw))
    return F.regexp_replace(text, "\r\n?", "\n")


# --- helpers that see one text at a time -------------------------------------

_LINK_HEAD = re.compile(r"!?\[((?:\\[\[\]\\]|[^\]])*+)\]\(")
_LABEL_ESCAPE = re.compile(r"\\([\[\]\\])")
_TARGET_ESCAPE = re.compile(r"\\([()\\])")
_TARGET_STEP = re.compile(r"\\[()\\]|[()]")


def _closing_paren(text: str, start: int) -> int:
    depth = 1
    for step in _TARGET_STEP.finditer(text, start):
        depth += {"(": 1, ")": -1}.get(step.group(), 0)
        if depth == 0:
            return step.start()
    return -1


def flatten_links(text: str) -> str:
    """Markdown links and images become ``label target``."""
    out, at = [], 0
    last = text.rfind("](")
    pos = 0
    while pos <= last:
        head = _LINK_HEAD.search(text, pos)
        if head is None:
            break
        end = _closing_paren(text, head.end())
        if end < 0:
            pos = head.start() + 1
            continue
        label = _LABEL_ESCAPE.sub(r"\1", head.group(1)).strip()
        target = _TARGET_ESCAPE.sub(r"\1", text[head.end() : end]).strip()
        out += [text[at : head.start()], " ".join(filter(None, (label, target)))]
        at = pos = end + 1
    return "".join(out) + text[at:]


def json_leaves(value) -> list[str]:
    """Leaf values in document order: no keys, no nulls, no blanks."""
    leaves, pending = [], [value]
    while pending:
        item = pending.pop()
        if isinstance(item, dict):
            pending += reversed(item.values())
        elif isinstance(item, list):
            pending += reversed(item)
        elif item is not None:
            leaves.append(str(item).lower() if isinstance(item, bool) else str(item).strip())
    return [leaf for leaf in leaves if leaf]


def json_text(text: str) -> str:
    try:
        return "\n".join(json_leaves(json.loads(text)))
    except ValueError:
        return ""


def embedded_json_text(text: str) -> str:
    """Leaf values of JSON pieces inside other markup."""
    whole = json_text(text)
    if whole:
        return whole
    text, decoder, leaves, at = html.unescape(text), json.JSONDecoder(), [], 0
    while (opening := re.compile(r"[{\[]").search(text, at)) is not None:
        try:
            value, at = decoder.raw_decode(text, opening.start())
            leaves += json_leaves(value)
        except ValueError:
            at = opening.start() + 1
    return "\n".join(leaves)


def xml_text(text: str) -> str:
    try:
        nodes = ElementTree.fromstring(text).itertext()
        return "\n".join(filter(None, (node.strip() for node in nodes)))
    except ElementTree.ParseError:
        return ""


_HELPERS: dict[str, Callable[[str], str]] = {
    **dict.fromkeys(MARKDOWN, flatten_links),
    **dict.fromkeys(JSON, json_text),
    **dict.fromkeys(EMBEDDED_JSON, embedded_json_text),
    **dict.fromkeys(XML, xml_text),
}
_REGISTERED: dict[str, Callable[[bytes], str]] = {}


def register_extractor(extension: str, function: Callable[[bytes], str]) -> None:
    """Add or replace the reader of one extension: file bytes in, text out."""
    _REGISTERED[ext.tidy_extension(extension)] = function


def _isolated(function, value):
    if value is None:
        return None, None
    try:
        return function(value), None
    except Exception as error:  # noqa: BLE001 - any failure belongs to its row
        return None, str(error) or type(error).__name__


def _row_parser(helpers: dict):
    """Arrow function (key, value) -> struct(text, error)."""

    @F.pandas_udf(PARSED)
    def parse(key: pd.Series, value: pd.Series) -> pd.DataFrame:
        rows = [_isolated(helpers.get(k), v) for k, v in zip(key, value)]
        return pd.DataFrame(rows, columns=["text", "error"])

    return parse


def piece_function(spark: SparkSession, name: str = "extract_pieces", extractors: dict[str, Callable] | None = None) -> None:
    """Register the table function ``name`` (file_name, bytes) -> (piece, text, error) for SQL text.

    It reads with the built-in readers, those of ``register_extractor``, and ``extractors`` (extension: function of the
    bytes). A reader that returns a text gives one piece, one that returns or yields several gives a row each. A file
    whose reader fails has one more row with the error, after the pieces that came before; a file without a
    reader has an error, one without bytes no rows.
    """
    readers = {e: (lambda data, f=f: f(data.decode("utf-8", "replace"))) for e, f in {**dict.fromkeys(PLAIN, str), **_HELPERS}.items()}
    readers |= _REGISTERED
    readers |= {ext.tidy_extension(e): f for e, f in (extractors or {}).items()}
    by_length = sorted(readers, key=len, reverse=True)

    @F.udtf(returnType="piece int, text string, error string")
    class Pieces:
        def eval(self, file_name: str, data: bytes):
            if data is None:
                return
            lowered = (file_name or "").lower()
            reader = next((readers[e] for e in by_length if lowered.endswith(e)), None)
            number = 0
            try:
                if reader is None:
                    raise ValueError(f"no reader for {file_name}")
                found = reader(bytes(data))
                for piece in [found] if isinstance(found, str) else found:
                    yield number, piece, None
                    number += 1
            except Exception as error:  # noqa: BLE001 - any failure belongs to its row
                yield number, None, str(error) or type(error).__name__

    spark.udtf.register(name, Pieces)


def _one_column(function):
    @F.pandas_udf("string")
    def apply(value: pd.Series) -> pd.Series:
        return value.map(lambda v: None if v is None else function(v))

    return apply


def flatten_markdown(text: Column) -> Column:
    """Texts without a link skip the helper."""
    linked = F.when(text.contains("]("), text)
    return F.coalesce(_one_column(flatten_links)(linked), text)


def json_values_text(text: Column) -> Column:
    return _one_column(json_text)(text)


def embedded_json_values_text(text: Column) -> Column:
    return _one_column(embedded_json_text)(text)


def xml_node_text(text: Column) -> Column:
    return _one_column(xml_text)(text)


def extract_text(files: DataFrame, extra_content=(), extra_names=()) -> DataFrame:
    """Add ``file_ext``, ``content`` and ``error`` to rows of (file_name, bytes).

    Name-only files get NULL content and no error. An extension that is known but
    has no reader here is an error of that row.
    """
    known = ext.known_extensions(extra_content, extra_names)
    extra = [e for e in extra_content if e not in _HELPERS and e not in _REGISTERED]
    readers = [e for e in (*PLAIN, *_HELPERS, *extra) if e not in _REGISTERED]
    rows = files.withColumn("file_ext", ext.resolve_extension(F.col("file_name"), known))
    rows = rows.withColumn("kind", ext.extension_kind(F.col("file_ext"), extra_content, extra_names))
    rows = rows.withColumn(
        "decoded",
        F.when(F.col("file_ext").isin(*readers), decode_utf8(F.col("bytes"))),
    )
    as_is = F.col("file_ext").isin(*PLAIN, *extra) | (
        F.col("file_ext").isin(*MARKDOWN) & ~F.col("decoded").contains("](")
    )
    parsed = _row_parser(dict(_HELPERS))(F.col("file_ext"), F.when(~as_is, F.col("decoded")))
    rows = rows.withColumn("parsed", parsed)
    text, error = F.col("parsed.text"), F.col("parsed.error")
    if _REGISTERED:
        custom = _row_parser(dict(_REGISTERED))(
            F.col("file_ext"), F.when(F.col("file_ext").isin(*_REGISTERED), F.col("bytes"))
        )
        rows = rows.withColumn("custom", custom)
        text = F.coalesce(text, F.col("custom.text"))
        error = F.coalesce(error, F.col("custom.error"))
    readable = F.col("file_ext").isin(*PLAIN, *_HELPERS, *extra, *_REGISTERED)
    unsupported = F.concat(
        F.lit("Unsupported extension: "),
        F.coalesce("file_ext", F.regexp_extract(F.lower("file_name"), r"(\.[^.]*)$", 1)),
    )
    return rows.withColumn(
        "content", F.when(as_is, F.col("decoded")).otherwise(text)
    ).withColumn(
        "error",
        F.when(F.col("kind") == "name_only", F.lit(None).cast("string"))
        .when(F.coalesce(readable, F.lit(False)), error)
        .otherwise(unsupported),
    ).drop("decoded", "parsed", "custom")


# Elements whose text is not shown, and marks of a breadcrumb.
UNSEEN = ("script", "style", "noscript", "svg")
CRUMB_WORDS = ("breadcrumb", "bread-crumb", "パンくず")


class _Events(HTMLParser):
    """The markup as a flat list of (tag, attributes or None at its end, text)."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, dict | None, str | None]] = []
        self.feed(markup)

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, {k.lower(): v or "" for k, v in attrs}, None))

    def handle_endtag(self, tag):
        self.found.append((tag, None, None))

    def handle_data(self, data):
        self.found.append(("", None, data))


def _open_counts(events, tags, opens=lambda attributes: True) -> list[int]:
    """At each event, how many elements of these tags are open; an end without a start counts for nothing."""
    steps = (
        0 if tag not in tags else -1 if attributes is None else int(opens(attributes)) for tag, attributes, _ in events
    )
    return list(accumulate(steps, lambda count, step: max(0, count + step)))


def _is_crumb(attributes: dict) -> bool:
    marks = " ".join(attributes.get(n, "") for n in ("aria-label", "class", "id")).lower()
    return any(word in marks for word in CRUMB_WORDS)


def _read_page(markup: str):
    events = _Events(markup).found
    unseen, titled = _open_counts(events, UNSEEN), _open_counts(events, ("title",))
    trail = _open_counts(events, ("nav",), _is_crumb)
    data = _open_counts(events, ("script",), lambda attributes: "ld+json" in attributes.get("type", "").lower())
    texts = [(k, " ".join(text.split())) for k, (_, _, text) in enumerate(events) if text and not unseen[k]]
    links = [(k, a["href"], _is_crumb(a)) for k, (tag, a, _) in enumerate(events) if tag == "a" and a and a.get("href")]
    runs = groupby(zip(data, events), lambda pair: pair[0] > 0)
    blocks = ["".join(text or "" for _, (_, _, text) in run) for inside, run in runs if inside]
    return (
        " ".join(t for k, t in texts if t and titled[k]),
        " ".join(t for k, t in texts if t and not titled[k]),
        [link for _, link, _ in links],
        [link for k, link, marked in links if marked or trail[k]],
        blocks,
    )


@F.pandas_udf(PAGE)
def _read_pages(markup: pd.Series) -> pd.DataFrame:
    rows = [_read_page("" if m is None else m) for m in markup]
    return pd.DataFrame(rows, columns=PAGE.fieldNames())


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows of (url, html) with title, content, links, breadcrumb links, JSON-LD."""
    return pages.withColumn("page", _read_pages("html")).select("*", "page.*").drop("page")


def pin_tag_and_names(docs: DataFrame) -> DataFrame:
    """Title, aliases and pin flag from the head of ``.md`` bodies."""
    from lodestone.functions import frontmatter as fm

    is_md = (F.col("file_ext") == ".md") & F.col("content").isNotNull()
    return (
        docs.withColumn("title", F.when(is_md, fm.front_matter_title(F.col("content"))).otherwise(""))
        .withColumn(
            "aliases",
            F.when(is_md, fm.front_matter_aliases(F.col("content"))).otherwise(
                F.array().cast("array<string>")
            ),
        )
        .withColumn("has_top_tag", is_md & fm.has_pin_tag(F.col("content")))
    )
