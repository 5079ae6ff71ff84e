"""Page extraction: held-out layouts, pages of the table, broken markup."""

import html
import re

import pytest

from corpus_fixtures import SF01
from custlytics.llm import html_crf as H

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def chain():
    return H.default_chain()


def test_held_out_layouts(chain):
    right = total = 0
    for page, labels in H.labelled_pages(200, seed=77):
        found = chain.viterbi(chain.scores(H.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total >= 0.99


def test_whole_table(spark, chain):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    rows = H.extract(pages, chain).collect()
    assert len(rows) == len(raw)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


ARTICLE = "<p>A first paragraph of some length, with a comma and an end.</p><p>And a second one that says a little more, as texts do.</p>"


@pytest.mark.parametrize("around", [
    "<nav><a href='/'>Home</a> <a href='/x'>News</a></nav><article>{}</article><footer>&copy; 2024 a site</footer>",
    "<div class=menu><ul><li><a href=/>One</a><li><a href=/>Two</a></ul></div><main>{}</main><div id=comments><div class=comment><p>I do not agree with this text at all, said a reader.</p></div></div>",
    "<header><h2>The Site</h2></header><div class='content'>{}</div><div class='sidebar'><h4>More</h4><p>Other things that you may want to read on this site.</p></div>",
    "<div class='cookie-notice'>We use cookies on this site to make it better. <button>Fine</button></div><div id='story'>{}</div><form><label>Mail</label><input><button>Subscribe</button></form>",
])
def test_layouts_by_hand(chain, around):
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{around.format(ARTICLE)}<script>x='<p>no</p>'</script></body></html>"
    text = H.main_text(page, chain)
    assert text == "A first paragraph of some length, with a comma and an end. And a second one that says a little more, as texts do."


def test_leaf_blocks():
    def texts(page):
        return [b.text for b in H.leaf_blocks(page)]
    assert texts("<p>a&amp;b &lt;i&gt;&nbsp; c<b>d</b>e<br>f<p>g") == ["a&b <i> cde f", "g"]
    assert texts("<ul><li>one<li>two <ul><li>in</ul></ul>out") == ["one", "two", "in", "out"]
    assert texts("x<!-- <p>no</p> --> y<script>if(a<b){}</script> z") == ["x y z"]
    assert texts("<a title='1>0' href=\"/?a>b\">t</a>") == ["t"]
    assert texts("<p>a</b></i>b</div>c</p>") == ["ab", "c"]
    assert texts("<script>never closed <p>a</p>") == [] and texts("<!-- open <p>a") == [] and texts("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]
    block = H.leaf_blocks("<div class='post main'><p id=x1>go <a href=/>there</a></p></div>")[0]
    assert block.tags == ("div", "p") and set(block.names) >= {"post", "main", "x"} and block.link_chars == 5


def test_edge_rows(spark, chain):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>only"), (4, "u", "<article><p>" + "Very long text here. " * 20000 + "</p></article>"),
            (5, "u", "<" * 5000), (5, "u", "<" * 5000), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<p a='" + "x" * 50000)]
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("x"))
    out = H.extract(pages, chain).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == 8 and got[1].text == got[2].text == "" and got[1].n_chars == 0 and got[2].url is None
    assert got[4].n_chars == len("Very long text here. " * 20000) - 1
    assert H.extract(pages.limit(0), chain).count() == 0


def test_viterbi_is_the_best_sequence(chain):
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(50):
        e = rng.normal(size=(6, 2))

        def value(path):
            return sum(e[i, s] for i, s in enumerate(path)) + chain.first[path[0]] + chain.last[path[-1]] + sum(
                chain.move[a, b] for a, b in zip(path, path[1:]))
        assert [int(x) for x in chain.viterbi(e)] == list(max(itertools.product((0, 1), repeat=6), key=value))


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>T</title><body><p>Body.</p>", ["Body."]),
    ("<head><meta charset=utf-8><style>p{}</style><link rel=x><script>'<body>'</script><article>Body.</article>", ["Body."]),
    ("<head><title>T</title>Body.", ["Body."]),
    ("<head>left out<title>T</title></head><p>Body.</p>", ["Body."]),
    ("<head><title>T</title><body><p>Body.</p><script>'</head>'</script><p>More.</p>", ["Body.", "More."]),
    ("<p>One.<svg class=\"i\"/> Two.</p><p>Three.</p>", ["One. Two.", "Three."]),
    ("<p>One.<svg/> Two.<svg hidden /> Three.<svg><text>no</text></svg> Four.</p>", ["One. Two. Three. Four."]),
    ("<p>One.<svg class=i/><text>no</text></svg> Two.</p>", ["One. Two."]),
    ("<p>One.</p><noscript><p>Two.</p>", ["One.", "Two."]),
    ("<p>One.</p><template><p>Two.</p><object data=x><p>Three.</p>", ["One.", "Two.", "Three."]),
    ("<p>One.</p><iframe src=x><p>Two.</p>", ["One.", "Two."]),
    ("<p>One.</p><iframe>no</iframe><noscript>no</noscript><object>no</object><template>no</template><p>Two.</p>", ["One.", "Two."]),
    ("<p>One.</p><script>x = '<p>no</p>'", ["One."]),
    ("<p>One.</p><style>no<p>no</p>", ["One."]),
])
def test_elements_without_end_tag_leave_the_rest_of_the_page(page, want):
    assert [b.text for b in H.leaf_blocks(page)] == want


def test_minified_pages_are_extracted(spark, chain):
    pages = [f"<html><head><title>T</title><body><article><p>{ARTICLE}</p></article>",
             f"<html><head><title>T</title></head><body><article><svg class=\"i\"/><p>{ARTICLE}</p></article></body></html>"]
    got = H.extract(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], PAGES)).collect()
    assert len(got) == 2 and all(len(value) > 50 for r in got for value in r if isinstance(value, str) and value != "u")


def test_unclosed_tags_cost_linear_time_and_memory():
    """Four times the page: about four times the time, and little memory."""
    import time
    import tracemalloc
    chain = H.default_chain()
    for unit in ("<font class='a b c'><p>x</p>", "<div>x", '<a "', "<b>x</i>", "</", "<li><font id=q>y</div>"):
        spent = []
        for size in (100_000, 400_000):
            page = unit * (size // len(unit))
            t = time.perf_counter()
            H.main_text(page, chain)
            spent.append(time.perf_counter() - t)
        assert spent[1] < 10 * spent[0] + 0.5, unit
        tracemalloc.start()
        H.leaf_blocks(unit * (1_000_000 // len(unit)), chain.names)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 << 20, unit


def test_features_of_a_deep_page_are_those_of_its_ancestors():
    page = "<div class='post'><font class='big'><p>one</p><b>two</b></font></div><section><i>three</i></section>"
    blocks = H.leaf_blocks(page)
    for b, found in zip(blocks, H.block_features(blocks), strict=True):
        assert {f for f in found if f.startswith(("in:", "name:"))} == {"in:" + t for t in b.tags} | {"name:" + n for n in b.names}
        nearest = next((t for t in reversed(b.tags) if t in H.BLOCK_TAGS), "none")
        assert "tag:" + nearest in found
