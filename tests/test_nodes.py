"""The node table, selectors, strips and articles on small pages of our own."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions.markup import MAX_DEPTH, tokenize
from pagemill.operators import article as A
from pagemill.operators import nodes as N

URL = "https://example.org/docs/a"
PROSE = "The first of the rivers, long and slow, runs past the old mill and under the bridge, where boats were built. "


def pages(spark, *htmls):
    return spark.createDataFrame([(k, URL, h) for k, h in enumerate(htmls)], "page_id int, url string, html string")


def test_intervals_nest_and_end_tags_are_implied():
    rows = tokenize("<html><body><ul><li>a<li>b<ul><li>c</ul></ul><p>x<b>y<p>z</body>", URL)
    by = {r[0]: r for r in rows}
    for pos, last, parent, *_ in rows:
        assert pos <= last and (parent < 0 or by[parent][0] < pos <= last <= by[parent][1])
    lists = [(r[5], r[3], [s[1] for s in r[9]]) for r in rows if r[5] == "li"]
    assert lists == [("li", 1, ["html", "body", "ul", "li"]), ("li", 2, ["html", "body", "ul", "li"]), ("li", 1, ["html", "body", "ul", "li", "ul", "li"])]
    assert [(r[8], [s[1] for s in r[9]][-1]) for r in rows if r[5] == "#text"][-3:] == [("x", "p"), ("y", "b"), ("z", "p")]
    assert [r[8] for r in tokenize("&amp;<br/><img src=x>t", URL) if r[5] == "#text"] == ["&", "t"]


def test_a_reference_ends_with_a_semicolon():
    rows = tokenize("<title>a &amp; b&amp</title><script>x && y &amp; \"&lt\"</script>R&D &copy 2 &#65;&#x42; &#65 &copy;&quot<a href='/x?a=1&copy=2&amp;b=3'>\ufdd0</a>&", URL)
    assert [r[8] for r in rows if r[5] == "#text"] == ["a & b&amp", 'x && y &amp; "&lt"', "R&D &copy 2 AB &#65 \u00a9&quot", "\ufdd0", "&"]
    assert [r[6]["href"] for r in rows if r[5] == "a"] == ["/x?a=1&copy=2&b=3"]


def test_deep_and_broken_markup_keeps_paths_short():
    rows = tokenize("<div>" * 5000 + "deep", URL)
    assert max(len(r[9]) for r in rows) == MAX_DEPTH + 1 and rows[-1][8] == "deep"
    for html in (None, "", "<", "</p></p>", "<table><tr><td>", "\0", "<p" * 99, '<a href="http://[bad">x'):
        assert isinstance(tokenize(html, None), list)


@pytest.mark.parametrize(("selector", "names"), [
    ("p", "p1 p2 p3"), ("div > p", "p1 p3"), ("div p", "p1 p2 p3"), ("#d1 .x", "p2 s1"), ("section > .x, #p3", "p2 p3 s1"),
    ("[data-k]", "d1 s1"), ('[data-k="v w"]', "d1"), ("[data-k^=v]", "d1"), ("[class*='y-']", "p3"), ("[class~=z]", "p3"),
    ("div div > p.z", "p3"), ("div > div > section", ""), ("body *[id$='2']", "d2 p2"),
])
def test_selectors(spark, selector, names):
    html = (
        '<body><div id=d1 data-k="v w"><p id=p1>1</p><section id=s0><p id=p2 class="x">2</p><span id=s1 class="x q" data-k>s</span></section>'
        '<div id=d2><p id=p3 class="y-a z">3</p></div></div></body>'
    )
    nodes = N.page_nodes(pages(spark, html, html))
    found = N.select_nodes(nodes, selector).select("page", "pos").join(nodes, ["page", "pos"]).select("page_id", F.col("attrs")["id"].alias("id")).collect()
    for page in (0, 1):
        assert sorted(r.id for r in found if r.page_id == page) == sorted(names.split())


def test_selectors_that_are_not_understood():
    for bad in ("", "p:first-child", "a + b", "> p", "p,"):
        with pytest.raises(ValueError, match="selector"):
            N.parse_selector(bad)


def text_left(nodes):
    return nodes.filter("tag = '#text'").groupBy("page_id").agg(N.joined_text(F.collect_list(F.struct("pos", "text"))).alias("t")).collect()


def test_strips_take_whole_elements(spark):
    html = (
        "<nav>n<p>n2</p></nav><div class='banner x'>b<div>b2</div></div><p>keep</p><aside><aside>a</aside>a2</aside>"
        "<div id='my-site-banner'>s</div><div class=my-cookie-banner>c<span>c2</span></div><i>!</i><ul class=l><li><b>strong</b> item</li></ul>"
    )
    nodes = N.page_nodes(pages(spark, html))
    assert [r.t for r in text_left(N.strip(nodes, N.CHROME))] == ["bb2keeps!strong item"]
    assert [r.t for r in text_left(N.strip(nodes, N.PROMO))] == ["nn2keepaa2cc2!strong item"]
    assert [r.t for r in text_left(N.strip(nodes, N.CONSENT))] == ["nn2bb2keepaa2s!strong item"]
    assert [r.t for r in text_left(N.strip(nodes, (*N.CHROME, *N.PROMO, "ul.l > li b", "i")))] == ["keep item"]


def golden(spark, *htmls):
    return A.article_text(pages(spark, *htmls)).orderBy("page_id").collect()


def test_articles_are_found_by_density(spark):
    chrome = "<nav>" + "".join(f'<a href="/{k}">Link number {k} of the menu, quite long</a>' for k in range(30)) + "</nav>"
    links = "<div class=related>" + "".join(f'<p><a href="/r{k}">A related story, with a title that is long enough to count, number {k}</a></p>' for k in range(20)) + "</div>"
    story = "".join(f"<p>{PROSE * 2}Part {k}.</p>" for k in range(5))
    plain = f"<html><head><title> A  title </title></head><body>{chrome}<div class=layout><div id=story>{story}</div>{links}</div><footer><p>{PROSE}</p></footer></body></html>"
    loose = f"<body><div><div class=banner>{PROSE * 9}</div><div>{PROSE}<br>{PROSE}</div></div></body>"
    short = '<body><article><a href="/1">x</a><h2>y</h2>' + "w " * 70 + '<a href="/2">z</a><h3>v</h3></article></body>'
    stub = '<html><head><title>T</title></head><body><div id="root"></div><noscript>Enable scripts, please, to see this page at all</noscript></body></html>'
    bare = "<body><p>too short</p></body>"
    out = golden(spark, plain, loose, short, stub, bare, None, "")
    assert (out[0].ok, out[0].method, out[0].title) == (True, "density", "A title")
    assert out[0].text.split("\n\n") == [f"{PROSE * 2}Part {k}." for k in range(5)]
    assert out[1].method == "density" and out[1].text == (PROSE * 2).strip().replace(". The", ". The")
    assert out[2].ok and "w w" in out[2].text
    assert (out[4].ok, out[4].method, out[4].text) == (True, "body", "too short")
    assert [(r.ok, r.failure, r.spa_stub, r.text) for r in (out[3], *out[5:])] == [
        (False, "extraction_failed", True, None),
        (False, "extraction_failed", False, None), (False, "extraction_failed", False, None),
    ]


def test_siblings_of_the_best_element_belong_to_the_article(spark):
    part = "".join(f"<p>{PROSE * 3}</p>" for _ in range(4))
    html = f"<body><div><div>{part * 2}<p>one</p></div><div>{part}<p>two</p></div><div><a href=/x>{PROSE}</a></div></div></body>"
    (row,) = golden(spark, html)
    assert "one" in row.text and "two" in row.text and row.text.count(PROSE.strip()) == 36


def test_an_article_is_picked_where_nothing_scores(spark):
    words = "".join(f"<p>word number {k}</p>" for k in range(30))
    (row,) = golden(spark, f"<body><p>out</p><main>{words}</main></body>")
    assert row.method == "pick" and row.text.startswith("word number 0\n\n") and "out" not in row.text


def test_only_rows_that_can_match_are_matched_against_the_picks(spark):
    html = '<body><p>plain</p><a href="/x">link</a><div>bare</div><ARTICLE>a</ARTICLE><main>m</main><p class=post-content>c</p><div role=main>r</div><p id=docs>d</p></body>'
    steps = [s[0][1] for p in A.PICKS for s in N.parse_selector(p)]
    hit = F.greatest(*[N.matches(tests) for tests in steps])
    rows = N.page_nodes(pages(spark, html)).select("tag", A._may_match(steps).alias("may"), hit.alias("hit")).collect()
    assert sorted(r.tag for r in rows if r.hit) == sorted(r.tag for r in rows if r.may) == ["article", "div", "main", "p", "p"]
