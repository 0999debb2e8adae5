import math

import pytest

from tidemark.llm import site_tree
from tidemark.llm.site_tree import main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body class="x">
<header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><!-- ad <p>no</p> --><div class="ad box">Buy</div>
<article><h1>Head&nbsp;line</h1><p>First <b>bold <i>it</i></b>,<br>second&#x21; &lt;tag&gt;<p>Next&amp
para</p><form><input>Find</form><div id="comments">Nice!</div><aside>See</aside></article>
<div class="cookie-notice">OK?</div><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Head line First bold it, second! <tag> Next& para"


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("plain & text", "plain & text"), ("<p>a<p>b</p>c", "a b c"), ("a < b <i>c</i>d", "a < b cd"), ("<main>x<nav>y</nav></main>z", "x"),
                                        ("<script>never closed <p>x", ""), ("<div>a</span></div>b", "a b"), ("<p title='>'>q</p>", "q"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
                                        ("&am &unknown; &#65;&#x42", "&am &unknown; AB"), ("<!-- open", ""), ("<textarea><p>x</textarea>y", "y"), ("<p>" * 2000 + "deep", "deep")])
def test_odd_pages(page, want):
    assert main_text(page) == want


def low_nodes(spark, pages, **options):
    df = spark.createDataFrame(pages, "host string, html string")
    tree = site_tree.importance(site_tree.node_counts(df, "host", "html"))
    return tree, site_tree.noisy(tree, **options)


def test_importance_is_the_entropy(spark):
    pages = [("h", f"<body><div class='same'>always</div><div class='own'>text {k}</div></body>") for k in range(8)] + [("h", "<body><div class='own'>text 0</div></body>")]
    tree, low = low_nodes(spark, pages)
    rows = {(r.tag, round(r.own, 6)): r.pages for r in tree.collect()}
    assert rows[("div", 0.0)] == 8
    # of 8 texts on 9 pages one is on two pages
    assert rows[("div", round(1 - math.log(2) / 8 / math.log(9), 6))] == 9
    p = [8 / 9, 1 / 9]
    assert rows[("body", round(-sum(x * math.log(x, 9) for x in p), 6))] == 9
    assert len(low.first().nodes) == 1


def test_repeated_branches_go_only_on_their_host(spark):
    frame = lambda k: f"<body><div class='lead'>same for all</div><section><p>own text {k}</p></section></body>"
    rows = [(k, "http://a.example/x", frame(k)) for k in range(10)] + [(50, "https://u@B.example:80/q", frame(50)), (51, None, frame(51)), (52, "no url", None), (53, "http://a.example/z", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in site_tree.extract(df).collect()}
    assert got[3] == ("own text 3", 10) and got[50][0] == "same for all own text 50" == got[51][0].replace("51", "50")
    assert got[52] == ("", 0) == got[53] and len(got) == 14


def test_articles_keep_shared_paragraphs(spark):
    """Copies of one page on one host keep their text; a widget that all differing articles repeat goes."""
    copy = "<article><h1>t</h1><p>the same text</p></article>"
    rows = [(k, "http://c.example/", copy) for k in range(9)] + [(100 + k, "http://d.example/", f"<article><p>own {k}</p><p>shared line</p><div class='rate'>Rate it</div></article>") for k in range(9)]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "t the same text" and got[104] == "own 4 shared line"


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "old", 9)], "page_id long, url string, html string, text string, host long")
    row = site_tree.extract(df).first()
    assert row.text == "x" and row.host == 9 and row.n_chars == 1
    assert site_tree.extract(df.limit(0)).count() == 0


def test_pages_of_the_test_tables(spark):
    import html
    import re

    for r in site_tree.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", inner)
        assert r.text == " ".join(" ".join(html.unescape(re.sub("<[^>]+>", "", b)) for b in blocks).split())
