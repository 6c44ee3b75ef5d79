"""Text extraction, front matter, pages."""

import pytest
from pyspark.sql import functions as F

from lodestone import read_files, register_extractor
from lodestone.functions import extensions as ext
from lodestone.functions import frontmatter as fm
from lodestone.functions import urls as ux
from lodestone.operators import extract as xt
from lodestone.operators import links as lk
from lodestone.sources.documents import from_pages, list_files, split_failures


@pytest.mark.parametrize(
    "text, flat",
    [
        ("see [label](http://x/a(b).png)!", "see label http://x/a(b).png!"),
        ("![alt](C:\\tmp\\a(test).png)", "alt C:\\tmp\\a(test).png"),
        (r"[a\]b](x\)y)", "a]b x)y"),
        ("[](only)", "only"),
        ("[open](never closed", "[open](never closed"),
        ("[a] (b) ![x] [y](z)", "[a] (b) ![x] y z"),
        ("[[a](b)", "[a b"),
        ("!![i](j)", "!i j"),
        ("[a](b(c) [d](e)", "[a](b(c) d e"),
    ],
)
def test_links_are_flattened(text, flat):
    assert xt.flatten_links(text) == flat


def test_json_helpers():
    assert xt.json_text('{"a": " x ", "b": [1, 2.5, true, null, ""], "c": {"d": "e"}}') == "x\n1\n2.5\ntrue\ne"
    assert xt.json_text("{broken") == ""
    assert xt.embedded_json_text('<svg c="{&quot;k&quot;: [&quot;v&quot;]}"> {bad} [7]</svg>') == "v\n7"
    assert xt.xml_text("<a> x <b k='no'>y</b></a>") == "x\ny"
    assert xt.xml_text("<a>") == ""


def test_decoding_drops_broken_bytes(spark):
    raw = [b"a\xffb\r\nc\xe2\x82", "�\x00b ok".encode(), "日本\xff".encode("utf-8")]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    got = [r[0] for r in rows.orderBy("i").select(xt.decode_utf8(F.col("b"))).collect()]
    assert got == [b.decode("utf-8", "ignore").replace("\r\n", "\n") for b in raw]


def test_longest_extension_wins(spark):
    names = ["a.md", "b.excalidraw.md", "c.DIO.svg", "d.svg", "e.unknown", "md"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in rows.select(ext.resolve_extension(F.col("n"), ext.known_extensions())).collect()]
    assert got == [".md", ".excalidraw.md", ".dio.svg", ".svg", None, None]
    assert ext.extension_filter("md, TXT nope") == [".md", ".txt"]
    assert ext.extension_filter(" ") == ext.known_extensions()
    assert ext.extension_filter("nope") == ext.known_extensions()
    assert ext.extension_entries("py, .RB\npy") == [".py", ".rb"]


def test_front_matter(spark):
    texts = [
        "---\ntitle: \"A B\"\naliases:\n  - one\n  - two, one\nalias: three\ntags: [x, '#Top']\n---\nbody",
        "---\r\ntag: note\r\ntags: top\r\n---\r\n",
        "no head\n---\ntitle: x\n---\n",
        "---\ntitle: open",
        "---\ntags:\n  - TOP\n---",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    t = F.col("t")
    got = rows.select(fm.front_matter_title(t), fm.front_matter_aliases(t), fm.has_pin_tag(t)).collect()
    assert [tuple(r) for r in got] == [
        ("A B", ["one", "two", "three"], True),
        ("", [], False),
        ("", [], False),
        ("", [], False),
        ("", [], True),
    ]


def test_files_on_disk(spark, tmp_path):
    tree = {
        "a.md": "---\ntitle: T\n---\n[x](y)", "sub/b.txt": "plain", "sub/deep/c.json": '{"k": "v"}', "sub/node_modules/d.md": "no",
        "e.png": "bytes", "f.unknown": "?", "g.pdf": "%PDF", ".git/h.md": "no", "i.log": "custom text",
    }
    for name, body in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    docs, failed = read_files(spark, str(tmp_path), depth=2, rules=["node_modules", ".git"])
    rows = {r.file_name: r for r in docs.collect()}
    assert set(rows) == {"a.md", "b.txt", "c.json", "e.png"}
    assert (rows["a.md"].content.splitlines()[-1], rows["a.md"].title) == ("x y", "T")
    assert (rows["c.json"].content, rows["e.png"].content) == ("v", None)
    assert [r.error_message for r in failed.collect()] == ["Unsupported extension: .pdf"]
    shallow = list_files(spark, str(tmp_path), depth=0, extensions=[".md", ".txt"]).collect()
    assert [r.file_name for r in shallow] == ["a.md"]
    register_extractor("log", lambda b: b.decode().upper() if b != b"bad" else 1 / 0)
    try:
        listed = list_files(spark, str(tmp_path), extensions=[".log"])
        good, bad = split_failures(xt.extract_text(listed, extra_content=[".log"]), 0.0)
        assert [r.content for r in good.collect()] == ["CUSTOM TEXT"] and bad.count() == 0
        (tmp_path / "i.log").write_text("bad")
        listed = list_files(spark, str(tmp_path), extensions=[".log"])
        good, bad = split_failures(xt.extract_text(listed, extra_content=[".log"]), 0.0)
        assert good.count() == 0 and bad.first().error_message == "division by zero"
    finally:
        xt._REGISTERED.clear()


PAGE = """<html><head><meta charset=x><title>My  Title</title><style>p{}</style>
<script type="application/ld+json">{"@graph": [{"@type": ["X", "BreadcrumbList"], "itemListElement":
 [{"item": {"@id": "/docs/"}}, "/docs/guide/", {"url": "http://other/"}]}]}</script></head>
<body><nav aria-label="Breadcrumb"><a href="/">home</a></nav><p>a &amp; b<br>c</p><noscript>no</noscript>
<a href="../x?q=1#f">x</a><a href="mailto:m@x">m</a></body></html>"""


def test_pages_links_and_scope(spark):
    url = "HTTP://Site.org/docs/guide/page.html;v=1#top"
    pages = spark.createDataFrame([(url, PAGE), ("http://site.org/plain/p", "<p>x")], "url string, html string")
    doc = from_pages(pages, 5.0).where("size > 10").first()
    assert (doc.normalized_path, doc.file_name, doc.content) == (
        "http://site.org/docs/guide/page.html", "My Title", "home a & b c x m")
    assert from_pages(pages, 5.0).where("size < 10").first().file_name == "p"
    read = lk.pages_with_links(pages)
    scopes = {r.url: r.scope_url for r in lk.page_scope(read).collect()}
    assert scopes == {
        "http://site.org/docs/guide/page.html": "http://site.org/docs/guide/",
        "http://site.org/plain/p": "http://site.org/plain/",
    }
    edges = lk.page_links(read, lk.page_scope(read)).collect()
    assert edges == []
    assert {r.dst_url for r in lk.page_links(read).collect()} == {"http://site.org/", "http://site.org/docs/x?q=1"}


def test_crawl_is_breadth_first(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "skip"), ("skip", "far"), ("x", "y")]
    links = spark.createDataFrame(edges, "src_url string, dst_url string")
    seeds = spark.createDataFrame([("a",)], "url string")
    found = {r.url: r.depth for r in lk.crawl_frontier(links, seeds, 9, ["SKIP"]).collect()}
    assert found == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.url for r in lk.crawl_frontier(links, seeds, 1).collect()} == {"a", "b", "c"}
    capped = lk.crawl_frontier(links, seeds, 9, max_pages=2).collect()
    assert {r.url for r in capped} == {"a", "b"}


def test_text_fragment(spark):
    row = spark.sql("select 'http://x/y' as u, 'a <mark>b c&d!</mark> <mark>z</mark>' as s, 'none' as n")
    got = row.select(ux.text_fragment_url(F.col("u"), F.col("s")), ux.text_fragment_url(F.col("u"), F.col("n"))).first()
    assert tuple(got) == ("http://x/y#:~:text=b%20c%26d!", "http://x/y")


def test_breadcrumbs_take_one_worker_beside_a_core(spark):
    url, block = "http://site.org/docs/guide/page.html", '{"@type": "BreadcrumbList", "itemListElement": ["/", null, {"item": "/docs/"}, "http://[bad"]}'
    rows = [(url, ["/docs/guide/", None, "#x"], [block, "not json"]), (f"{url}?q=1", ["/docs/guide/"], None), ("http://site.org/a/b", None, []), (None, ["/"], [block])]
    pages = spark.createDataFrame(rows, "url string, breadcrumb_links array<string>, json_ld_blocks array<string>")
    scopes = lk.page_scope(pages)
    plan = scopes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1
    want = {url: "http://site.org/docs/", f"{url}?q=1": "http://site.org/docs/guide/", "http://site.org/a/b": "http://site.org/a/", None: None}
    assert {r.url: r.scope_url for r in scopes.collect()} == want
