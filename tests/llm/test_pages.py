"""Main text of pages: markup cases, and repeated runs against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import pages


def text_of(page):
    return pages.main_texts([page])[0][0]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<article><h1>Title</h1><p>One &amp; two&nbsp;&lt;3<br>four</p><p>five\n  six</article>", "Title\nOne & two <3 four\nfive six"),
        ("<nav><a>Home</a></nav><article><p>Body</p><aside>Side</aside><form>Mail <input></form><p>End</p></article><footer>F</footer>", "Body\nEnd"),
        ("<body><div class='cookie-notice'>We use</div><main><header><h1>H</h1></header><p>T</p><section id=comments><p>me too</section></main>", "H\nT"),
        ("<p>no article here<p>second <script>x='</p>'</script><style>p{}</style>part", "no article here\nsecond part"),
        ("<article><p><b>bold never closed<p>next</article><div>rest</div>", "bold never closed\nnext"),
        ("<article><p>a < b and c<d</p><!-- hidden --><p>x<!-- y -->z", "a < b and c<d\nxz"),
        ("<article><p>cut &amp", "cut &"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
        ("<article><p>in <span class=ad>buy now</span> text</p></article>", "in\ntext"),
        ("<div role=navigation>m</div><div>kept</div><div hidden>h</div><div style='display: none'>n</div>", "kept"),
        ("<article><div class='widget'><div>deep</div></div>tail</article>", "tail"),
        ('<main><h2 id="related-work">Related</h2><section id="legal-basis">Law</section><div class="search-trees">Trees</div><p class="notice-text">Note</p></main>', "Related\nLaw\nTrees\nNote"),
        ('<article><div class="article-header"><h1>T</h1></div><h2 id="comments">Comments</h2><p>on it</p><div id="comments">me too</div></article>', "T\nComments\non it"),
        ('<article><p>a</p><div class="ad-box wide">x</div><ul class="comment-list"><li>y</ul><div class="newsletter-signup">z</div><p class="lead ad">w</p></article>', "a"),
        ('<div class="search-trees">gone outside</div><div class="tree">kept</div>', "kept"),
        ("<ARTICLE><P>Upper</P></ARTICLE><FOOTER>f", "Upper"),
        ("<article>&#65;&#x42;&eacute;\x00</article>", "ABé\x00"),
    ],
)
def test_markup(page, want):
    assert text_of(page) == want


def test_repeated_runs_equal_brute_force():
    rng = random.Random(6)
    for run in (1, 3, 8):
        for _ in range(30):
            tokens = [rng.randrange(4) for _ in range(rng.randrange(0, 120))]
            owner = sorted(rng.randrange(5) for _ in tokens)
            want = [False] * len(tokens)
            for i in range(len(tokens)):
                for j in range(len(tokens)):
                    window = tokens[i : i + run]
                    if owner[i] != owner[j] and window == tokens[j : j + run] and (len(window) == run):
                        for k in range(i, i + run):
                            want[k] = True
            got = pages.repeated(np.array(tokens, np.int64), np.array(owner, np.int64), run)
            assert got.tolist() == want


def test_repeated_blocks_without_a_main_element_go():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared, short = " ".join(word() for _ in range(20)), "Follow us"
    own = [" ".join(word() for _ in range(30)) for _ in range(5)]
    made = [f"<div>{shared}</div><div>{o}</div><div>{short}</div><div>{o[:20]} {shared}</div>" for o in own]
    got = pages.main_texts(made)
    for o, (text, tokens, again) in zip(own, got, strict=True):
        lines = text.split("\n")
        assert o in lines and shared not in lines and short not in lines and tokens > again > 40
    inside = [f"<article><p>{shared}</p><p>{o}</p></article>" for o in own]
    assert [g[0] for g in pages.main_texts(inside)] == [f"{shared}\n{o}" for o in own]


@pytest.mark.parametrize("group", [4, 512])
def test_extract_equals_pages_one_by_one(spark, monkeypatch, group):
    monkeypatch.setattr(pages, "GROUP", group)
    rows = [(i if i % 7 else None, f"http://{'hot' if i % 3 else f'h{i % 5}'}.example/{i}", f"<nav>menu {i}</nav><article><p>text {i} é</p></article>") for i in range(90)]
    rows += [(200, None, None), (201, "odd url", "<p>x</p>"), (202, "", ""), rows[4], rows[4], (203, "http://long.example/", "<article>" + "<p>word word</p>" * 40_000)]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "page_id bigint, url string, html string, score double")
    got = pages.extract(df)
    assert set(got.columns) == {"page_id", "url", "score", "text", "n_chars", "n_tokens", "n_repeated"}
    want = sorted((str(k), str(u), text_of(h or "")) for k, u, h in rows)
    found = got.collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in found) == want
    assert all(r.n_chars == len(r.text) and r.score == 1.5 for r in found)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert pages.extract(empty).count() == 0
    with pytest.raises(ValueError):
        pages.extract(empty.withColumn("text", F.lit("")))


def test_copies_of_a_page_do_not_repeat_each_other():
    own = " ".join(f"word{i}" for i in range(30))
    page, other = f"<div>{own}</div><div>short</div>", f"<p>{' '.join(f'else{i}' for i in range(30))}</p>"
    for made in ([page, page], [page] * 40 + [other], [page, other, page]):
        assert all(text == f"{own}\nshort" and again == 0 for (text, _, again), m in zip(pages.main_texts(made), made, strict=True) if m == page)


def test_repeats_of_a_large_host_are_seen_between_groups(spark, monkeypatch):
    """Groups of a few pages give what one stream of all pages of the host gives."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [" ".join(word() for _ in range(14)) for _ in range(20)]
    made = []
    for i in range(80):
        own = " ".join(word() for _ in range(20))
        made.append(f"<div>{own}</div><div>{shared[i % 20]}</div><p>Follow us</p><div>{' '.join(own.split()[:9])} {shared[(i * 7) % 20]}</div><nav>m {i}</nav>")
    made += [made[3]] * 5 + [f"<article>{made[4]}</article>"]
    monkeypatch.setattr(pages, "GROUP", 6)
    monkeypatch.setattr(pages, "RUNS_AT_ONCE", 500)
    df = spark.createDataFrame([(i, f"http://big.example/{i}", m) for i, m in enumerate(made)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_tokens, r.n_repeated) for r in pages.extract(df).collect()}
    assert got == dict(enumerate(pages.main_texts(made)))
    assert all(shared[i % 20] not in got[i][0].split("\n") and "Follow us" not in got[i][0] for i in range(80))


def test_packed_runs_come_back():
    for values in ([7], [0, 1, 2], [5, 2**40, 2**63, 2**64 - 1]):
        runs = np.array(values, np.uint64)
        assert pages.unpacked(pages.packed(runs)).tolist() == values
