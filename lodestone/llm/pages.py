"""HTML extraction: main text by structure, and by a suffix array over each host's pages.

``extract`` returns for every page its text and how much of it repeats on the host.

1. Markup is read into blocks of text in page order. A block is inside the main element (article
   or main), inside an element that is boilerplate by its tag, role or class, or neither.
2. The blocks of a host's pages become streams of tokens, a page's blocks one after another. Pages meet in
   groups of one host: all pages of a host of less than ``2 * GROUP`` pages and ``2 * GROUP_BYTES`` bytes, else
   dealt by a hash of their blocks. In a group, prefix doubling sorts the positions of its stream by the ``RUN`` tokens
   that follow (a suffix array to that depth, blocks end with a token of their own); neighbours in it that agree on all of
   them, on distinct pages, are long repeated substrings. What they cover is marked.
3. Runs that repeat between groups of a large host are found before: the runs of its pages, as numbers of 64 bits, meet
   by slices of their values, and each group is told which of its runs stand in another group. So a
   repeat is seen wherever on the host it is, as if all of its pages were one stream.
4. Blocks that are boilerplate by structure go. Blocks that are neither go if a page has a main
   element, or if at least ``COVERED`` of their tokens are repeated on another page; short blocks
   (under ``RUN`` tokens) count as repeated if all of their tokens are, up to the block's end. Blocks of the
   main element stay, repeated or not: an article may quote what other pages quote.

A slice holds about as many runs as a group; copies of a page fall into one group, where only the first one's blocks are
held. The table of large hosts is small, nothing else is broadcast. Blocks move once, runs of large hosts once.

Defined cases: a null html is an empty page with an empty text; a null or odd url belongs to the
host ''; pages with the same blocks count as one page in step 2, and are not repeated by each other; unclosed and misplaced tags are closed by their parents; null keys, repeated rows and
other columns pass through; columns named like an output raise ``ValueError``; an empty table gives
an empty table.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import kept, slices
from lodestone.session import small_batches

RUN, COVERED = 8, 0.9
#: Pages of a group of a large host, and bytes of html.
GROUP, GROUP_BYTES = 2_048, 16_000_000
#: Runs of large hosts that a worker gathers at once.
RUNS_AT_ONCE = 1 << 21

# Element names of HTML and customary names of page parts.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "select", "object", "canvas", "audio", "video"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "acronym", "ruby", "rt", "rp",
}
MAIN = {"article", "main"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert", "dialog", "form"}
PARTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "promo", "promotion", "sponsor", "sponsored", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "sidebar", "aside", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "comment", "comments", "disqus", "reply", "replies", "respond", "share",
    "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "form", "search", "widget",
    "toolbar", "pager", "pagination", "skip", "hidden", "disclaimer", "legal", "copyright",
}

#: Words that, beside those of ``PARTS``, name what holds a part.
HOLDERS = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "inner", "item", "items", "links", "list", "panel", "posts", "section", "slot", "top", "unit", "wrap", "wrapper"}
#: Ids that name the readers' comments inside a main element.
READERS = {"comments", "disqus_thread", "respond", "replies"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WHITE = re.compile(r"\s+")
HEADING = re.compile(r"h[1-6]")
#: What a block is.
MAIN_BLOCK, PLAIN_BLOCK, BOILERPLATE_BLOCK = 0, 1, 2


def names_part(name: str, in_main: bool) -> bool:
    """Whether a class names a part around the article: by any of its words, or in a main element by all of them.

    An article's own header is a part of it, and ``notice-text`` or ``search-trees`` may be what it is about.
    """
    words = {w for w in re.split(r"[^a-z]+", name) if w}
    if PARTS.isdisjoint(words):
        return False
    return not in_main or (words <= PARTS | HOLDERS and words.isdisjoint({"header", "masthead"}))


def is_boilerplate(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is a part of the page around the article. Ids of an article are targets of links, but for comments."""
    if name in BOILERPLATE and not (in_main and name == "header"):
        return True
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, words = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and words == "true") or (key == "style" and re.search(r"display\s*:\s*none", words)):
            return True
        if key == "role" and words in ROLES:
            return True
        if name in ("html", "body", *MAIN):
            continue
        if key == "id" and in_main:
            if words in READERS and not HEADING.fullmatch(name):
                return True
        elif key in ("class", "id") and any(names_part(w, in_main) for w in words.split()):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order, white space folded, empty ones left out."""
    found: list[tuple[int, str]] = []
    text: list[str] = []
    open_tags: list[tuple[str, int, bool]] = []  # name, kind before it, block element
    kind, at, size = PLAIN_BLOCK, 0, len(page)

    def close() -> None:
        if text:
            value = WHITE.sub(" ", entities.unescape("".join(text))).strip()
            if value:
                found.append((kind, value))
            text.clear()

    while at < size:
        match = TOKEN.search(page, at)
        if match is None:
            text.append(page[at:])
            break
        if match.start() > at:
            text.append(page[at : match.start()])
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        if match[1] or match[4]:  # an end tag: closes what is open inside as well
            if name in ("p", "br") and not any(t[0] == name for t in open_tags):
                close()
                continue
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == name:
                    if any(t[2] for t in open_tags[depth:]) or kind != open_tags[depth][1]:
                        close()
                    kind = open_tags[depth][1]
                    del open_tags[depth:]
                    break
            continue
        attributes = match[3] if match[3] is not None else match[6]
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if name == "br":
            text.append(" ")
            continue
        is_block = name not in INLINE
        if is_block:
            close()
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th"):  # their end tags may be left out
            siblings = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            last = next((d for d in range(len(open_tags) - 1, -1, -1) if open_tags[d][2]), None)
            if last is not None and open_tags[last][0] in siblings:
                kind = open_tags[last][1]
                del open_tags[last:]
        open_tags.append((name, kind, is_block))
        if kind != BOILERPLATE_BLOCK:
            if is_boilerplate(name, attributes, kind == MAIN_BLOCK):
                close()
                kind = BOILERPLATE_BLOCK
            elif name in MAIN:
                kind = MAIN_BLOCK
    close()
    return found


def repeated(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that stands on another page as well.

    Prefix doubling gives each position the rank of the tokens that follow it.
    """
    count = len(tokens)
    if not count:
        return np.zeros(0, bool)
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.zeros(count, np.int64)
        after[: max(0, count - step)] = rank[step:]
        rank, depth = np.unique(rank * (count + 2) + after, return_inverse=True)[1].astype(np.int64) + 1, depth + step
    suffixes = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.diff(rank[suffixes], prepend=0))
    first, last = np.minimum.reduceat(page[suffixes], starts), np.maximum.reduceat(page[suffixes], starts)
    shared = np.repeat(first != last, np.diff(np.append(starts, count)))
    heads = np.zeros(count + run, np.int64)
    begins = suffixes[shared]
    np.add.at(heads, begins, 1)
    np.add.at(heads, begins + run, -1)
    return np.cumsum(heads)[:count] > 0


class Codes(dict):
    """Numbers of tokens, the same in every worker; as many as fit are remembered."""

    def __missing__(self, token: str) -> int:
        code = int.from_bytes(blake2b(token.encode("utf-8"), digest_size=8).digest(), "little", signed=True)
        if len(self) < 1 << 20:
            self[token] = code
        return code


def stream_of(texts: list[str], codes: Codes, run: int) -> tuple[np.ndarray, list[int]]:
    """The tokens of a page's blocks one after another, and how many each block has.

    Short blocks are filled up to a run, so that equal ones are equal runs; every block ends in a mark.
    """
    stream, sizes = [], []
    for text in texts:
        tokens = text.split()
        sizes.append(len(tokens))
        stream += [codes[t] for t in tokens]
        stream += [-1] * max(1, run - len(tokens))
    return np.array(stream, np.int64), sizes


def runs_of(stream: np.ndarray, run: int) -> np.ndarray:
    """A number for the ``run`` tokens from each position on, as far as the page goes."""
    tokens, count = stream.view(np.uint64), max(0, len(stream) - run + 1)
    mixed = np.zeros(count, np.uint64)
    for j in range(run):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + count]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def coverage(pages: list[list[tuple[int, str]]], run: int, elsewhere: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """(tokens, repeated tokens) of each block of each page of a group; ``elsewhere``: sorted runs that other groups hold."""
    codes = Codes()
    streams, owner, sizes, heads = [], [], [], []
    owners: dict[tuple[str, ...], int] = {}
    for page in pages:
        texts = [text for _, text in page]
        number = owners.setdefault(tuple(texts), len(owners))  # copies of a page are one page
        stream, own = stream_of(texts, codes, run)
        sizes.append(own)
        streams += [stream, np.array([-2 - number])]  # nothing runs over from page to page
        owner.append(np.full(len(stream) + 1, number))
        head = np.zeros(len(stream) + 1, bool)
        if elsewhere is not None and len(elsewhere):
            runs = runs_of(stream, run)
            head[: len(runs)] = elsewhere[np.minimum(np.searchsorted(elsewhere, runs), len(elsewhere) - 1)] == runs
        heads.append(head)
    if not pages:
        return []
    covered = repeated(np.concatenate(streams), np.concatenate(owner), run)
    marks = np.concatenate([*heads, np.zeros(run, bool)]).astype(np.int64)
    marks[run:] -= marks[:-run].copy()
    covered |= np.cumsum(marks)[: len(covered)] > 0
    out, at = [], 0
    for blocks_sizes in sizes:
        own = []
        for size in blocks_sizes:
            own.append((size, int(covered[at : at + size].sum())))
            at += size + max(1, run - size)
        at += 1
        out.append(own)
    return out


def decided(read: list[list[tuple[int, str]]], run: int = RUN, elsewhere: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """(text, tokens, repeated tokens) of each page of a group of one host, from its blocks."""
    out = []
    for page, counts in zip(read, coverage(read, run, elsewhere), strict=True):
        has_main = any(kind == MAIN_BLOCK for kind, _ in page)
        keep = []
        for (kind, text), (size, again) in zip(page, counts, strict=True):
            if kind == MAIN_BLOCK or (kind == PLAIN_BLOCK and not has_main and again < COVERED * size):
                keep.append(text)
        out.append(("\n".join(keep), sum(s for s, _ in counts), sum(a for _, a in counts)))
    return out


def main_texts(pages: list[str], run: int = RUN) -> list[tuple[str, int, int]]:
    """The same of pages as html."""
    return decided([blocks(p) for p in pages], run)


def page_number(texts: list[str]) -> int:
    """The same for pages with the same blocks, whatever their kinds."""
    return int.from_bytes(blake2b("\n".join(texts).encode("utf-8"), digest_size=8).digest(), "little", signed=True)


def packed(runs: np.ndarray) -> bytes:
    """Ascending runs as the first one and the steps between them, byte by byte: the high bytes take hardly any room."""
    steps = np.diff(runs).astype("<u8").view(np.uint8).reshape(-1, 8)
    return runs[:1].tobytes() + zlib.compress(steps.T.tobytes())


def unpacked(value: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(value[8:]), np.uint8).reshape(8, -1).T)
    return np.cumsum(np.concatenate([np.frombuffer(value, "<u8", 1), steps.view("<u8").ravel()]), dtype=np.uint64)


def _read(rest: int):
    """Rows (rest, host, html) with html read into the page's number and its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, rest + 1):
            found = [blocks(page) for page in piece.column(rest + 1).to_pylist()]
            numbers = [page_number([text for _, text in page]) for page in found]
            held = [zlib.compress("\n".join(f"{kind}{text}" for kind, text in page).encode("utf-8")) for page in found]
            names = [*piece.schema.names[: rest + 1], "_page", "_blocks"]
            yield pa.RecordBatch.from_arrays([*piece.columns[: rest + 1], pa.array(numbers, pa.int64()), pa.array(held, pa.binary())], names=names)

    return run


def _runs(length: int):
    """Rows (host, parts, html) of large hosts to (host, slice, runs, parts): distinct runs with the part that holds them."""

    def sorted_rows(host: str, parts: int, runs: list[np.ndarray], own: list[int]) -> dict:
        part = np.repeat(np.array(own, np.uint32), [len(r) for r in runs])
        runs = np.concatenate(runs)
        order = np.lexsort((part, runs))
        runs, part = runs[order], part[order]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (part[1:] != part[:-1])
        runs, part = runs[new], part[new]
        number = ((runs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(runs)]
        kind = np.min_scalar_type(parts)
        spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return {
            "_host": [host] * len(spans), "_slice": [int(number[a]) for a, _ in spans], "_runs": [packed(runs[a:b]) for a, b in spans],
            "_width": [kind.itemsize] * len(spans), "_parts": [zlib.compress(part[a:b].astype(kind).tobytes()) for a, b in spans],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, size = Codes(), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for (host, parts), pages in held.items():
                found = [(number % parts, r) for number, r in pages.items() if len(r)]
                if found:
                    rows = sorted_rows(host, parts, [r for _, r in found], [p for p, _ in found])
                    yield pa.RecordBatch.from_pydict(rows, RUNS_LAYOUT)

        for piece in slices(batches, 2):
            for host, parts, page in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                texts = [text for _, text in blocks(page)]
                number, pages = page_number(texts), held.setdefault((host, parts), {})
                if number not in pages:
                    pages[number] = runs_of(stream_of(texts, codes, length)[0], length)
                    size += len(pages[number]) + 64
            if size >= RUNS_AT_ONCE:
                yield from out()
                held, size = {}, 0
        yield from out()

    return run


RUNS_LAYOUT = pa.schema([("_host", pa.string()), ("_slice", pa.int64()), ("_runs", pa.binary()), ("_width", pa.int32()), ("_parts", pa.binary())])


def _shared(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Of the runs of a slice of a host, those that several parts hold, for each of these parts."""
    runs = np.concatenate([unpacked(r) for r in rows.column("_runs").to_pylist()])
    part = np.concatenate(
        [np.frombuffer(zlib.decompress(p), f"u{w}").astype(np.int64) for p, w in zip(rows.column("_parts").to_pylist(), rows.column("_width").to_pylist(), strict=True)]
    )
    order = np.lexsort((part, runs))
    runs, part = runs[order], part[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (part[1:] != part[:-1])
    runs, part = runs[new], part[new]
    several = np.zeros(len(runs), bool)
    several[1:] = runs[1:] == runs[:-1]
    several[:-1] |= several[1:].copy()
    runs, part = runs[several], part[several]
    order = np.argsort(part, kind="stable")
    runs, part = runs[order], part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(runs)]
    spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return pa.table({
        "_host": pa.array([key[0].as_py()] * len(spans), pa.string()),
        "_part": pa.array([int(part[a]) for a, _ in spans], pa.int64()),
        "_shared": pa.array([packed(runs[a:b]) for a, b in spans], pa.binary()),
    })


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without html, with text, n_chars, n_tokens and n_repeated (tokens of all blocks, and repeated ones)."""
    own = {"text", "n_chars", "n_tokens", "n_repeated", "_host", "_part", "_parts", "_page", "_blocks", "_shared", "_html"}
    if own & set(pages.columns):
        raise ValueError(f"the columns {', '.join(sorted(own))} are the operator's")
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c != html]
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    source = pages.select(*rest, host.alias("_host"), F.coalesce(html, F.lit("")).alias("_html"))
    of_pages, of_bytes = F.floor(F.count("*") / GROUP), F.floor(F.sum(F.octet_length("_html")) / GROUP_BYTES)
    large = kept(source.groupBy("_host").agg(F.greatest(of_pages, of_bytes).alias("_parts")).where("_parts > 1"))
    width = len(rest)
    names = [*rest, "text", "n_tokens", "n_repeated"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:width])

    read = source.mapInArrow(_read(width), f"{schema}_host string, _page bigint, _blocks binary")
    part = F.pmod("_page", F.coalesce("_parts", F.lit(1)))
    dealt = read.join(large, "_host", "left").select(*rest, "_host", part.alias("_part"), "_page", "_blocks", F.lit(None).cast("binary").alias("_shared"))
    if not large.isEmpty():
        runs = source.join(large, "_host").select("_host", "_parts", "_html").mapInArrow(
            _runs(RUN), "_host string, _slice bigint, _runs binary, _width int, _parts binary")
        shared = runs.groupBy("_host", "_slice").applyInArrow(_shared, "_host string, _part bigint, _shared binary")
        dealt = dealt.unionByName(shared, allowMissingColumns=True)
    # what a group's runs share with other groups goes before its pages, and copies of a page lie together
    dealt = dealt.repartition("_host", "_part").sortWithinPartitions("_host", "_part", F.asc_nulls_first("_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, at, elsewhere, of = [], [], [], [], None

        def out() -> Iterator[pa.RecordBatch]:
            texts = [
                [(int(line[0]), line[1:]) for line in zlib.decompress(page).decode("utf-8").split("\n") if line] for page in found
            ]
            done = decided(texts, elsewhere=np.sort(np.concatenate(elsewhere)) if elsewhere else None)
            start = 0
            for piece in rows:
                mine = [done[k] for k in at[start : start + piece.num_rows]]
                start += piece.num_rows
                columns = [pa.array([m[0] for m in mine], pa.string()), *(pa.array([m[k] for m in mine], pa.int64()) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays([*piece.columns, *columns], names=names)

        for batch in batches:
            keys = list(zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True))
            turns = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for start, end in zip(turns, turns[1:], strict=False):
                if start == end:
                    continue
                if keys[start] != of:
                    yield from out()
                    rows, found, at, elsewhere = [], [], [], []
                of = keys[start]
                some = batch.slice(start, end - start)
                told = [unpacked(r) for r in some.column(width + 4).to_pylist() if r is not None]
                elsewhere += told
                some = some.slice(len(told))
                for page in some.column(width + 3).to_pylist():
                    if not found or page != found[-1]:
                        found.append(page)
                    at.append(len(found) - 1)
                if some.num_rows:
                    rows.append(pa.RecordBatch.from_arrays(some.columns[:width], names=rest))
        yield from out()

    result = dealt.mapInArrow(run, f"{schema}text string, n_tokens bigint, n_repeated bigint")
    return result.withColumn("n_chars", F.length("text").cast("bigint"))
