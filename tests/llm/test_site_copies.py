"""Hosts of copied pages, and pages whose main text stands outside their article elements."""

from tidemark.llm import site_tree

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_copies_without_an_article_keep_their_text(spark):
    """One page 9 times, 3 pages 30 times each with other markup, and 6 pages that have nothing of their own but order."""
    copy = "<html><body><div class='x'><p>the same text</p></div></body></html>"
    rows = [(k, "http://a.example/", copy) for k in range(9)]
    rows += [(100 + k, "http://b.example/", f"<body><!-- {k} --><div><p>document {k % 3}</p></div><script>t={k}</script></body>") for k in range(90)]
    rows += [(200 + k, "http://c.example/", "<body>" + "<p>again</p>" * (k + 1) + "</body>") for k in range(6)]
    got = texts(spark, rows)
    assert all(got[k] == "the same text" for k in range(9))
    assert all(got[100 + k] == f"document {k % 3}" for k in range(90))
    assert all(got[200 + k] == " ".join(["again"] * (k + 1)) for k in range(6))


def test_copies_do_not_hide_what_all_pages_repeat(spark):
    page = lambda k: f"<body><div class='lead'>same for all</div><section><p>own text {k}</p></section></body>"
    got = texts(spark, [(k, "http://a.example/", page(k % 10)) for k in range(300)])
    assert all(got[k] == f"own text {k % 10}" for k in range(300))


def test_main_text_beside_teasers(spark):
    page = lambda k: f"<body><div id='content'><p>a long own text number {k} of this page</p></div><article class='teaser'><p>read this too</p></article></body>"
    story = lambda k: f"<body><div class='up'>on all pages and rather long</div><article><p>story {k}</p></article><div class='by'>{k}</div></body>"
    rows = [(k, "http://a.example/", page(k)) for k in range(9)] + [(100 + k, "http://b.example/", story(k)) for k in range(9)]
    got = texts(spark, rows)
    assert all(got[k] == f"a long own text number {k} of this page" and got[100 + k] == f"story {k}" for k in range(9))
