"""The page reader on small pages of our own."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import compile as C
from pagemill.operators import pages as P
from pagemill.operators.nodes import page_nodes

URL = "https://example.org/docs/a"
LONG = "word " * 60
HEAD = (
    '<meta name=author content="An Author"><script type="application/ld+json">{"@graph":[{"datePublished":"2024-05-01"}]}</script>'
    "<link rel=canonical href=\"/docs/c\"><meta property='og:image' content='/i.png'><meta name=description content=' a  b '>"
)
BODIES = {
    "lists": "<ul><li>src<ul><li>core</li><li>utils</ul><li>tests</ul><ol><li>one<p>more</p></li><li>two</ol>",
    "inline": '<pre><code>with x:\n    y</code></pre><blockquote><p>said so</p><p>twice</p></blockquote><p>see <a href="../b">that <b>one</b></a> <img src="/i.png" alt="pic"></p><p><b> spaced </b>out <i></i><em>x</em>y</p><hr>end',
    "tables": "<table><tr><th>Team<th>Q1<th>Q2<tr><td>P<td>12<td>a|b<tr><td>R<td>7</table><table><tr><td>x<table><caption>in side</caption><tr><td>in<td>ner</table><td>y</table><table><tr><td>single</table>",
    "blocks": '<nav><p>menu</p></nav><p><b>one<br><p>two</p><h2 id="s">Head</h2><ul><li>item <a href="/x">x</a><a href="/x">again</a></li></ul><aside><p>ad</p></aside><script>var p="</p>"</script><div><figure id=d>f</figure></div><div><p id=d>g</p></div>',
    "media": '<h2>H</h2><img srcset="/a.png 1x, /b.png 2x" alt="A"><a href="/f.pdf?x">file <b>1</b></a><img src="/a.png"><h3>K</h3><video src=v.mp4></video>',
    "links": '<a href="/X">One</a><a href="/x">Two</a><a href="#f">no</a><a href="//Other.org/ä b?q=1#z">  a\n b </a><a href="mailto:a@b">m</a>',
}
NAMES = list(BODIES)


@pytest.fixture(scope="module")
def read(spark):
    rows = [(k, URL, f"<html lang=en><head><title>T</title>{HEAD}</head><body><article>{BODIES[name]}<p>{LONG}</p></article></body></html>") for k, name in enumerate(NAMES)]
    nodes = page_nodes(spark.createDataFrame(rows, "page_id int, url string, html string"))
    out = {name: {} for name in NAMES}
    for part in ("blocks", "tables", "media", "links", "meta", "markdown"):
        for r in getattr(P, f"page_{part}")(nodes).collect():
            out[NAMES[r.page_id]].setdefault(part, []).append(r)
    for parts in out.values():
        for part in ("blocks", "tables", "media", "links"):
            parts.setdefault(part, []).sort(key=lambda r: r.pos)
    return out


def test_lists_nest_by_four_spaces(read):
    md = read["lists"]["markdown"][0].markdown
    assert "# T\n\n*   src\n    *   core\n    *   utils\n*   tests\n\n1.  one\n    more\n2.  two\n\nword" in md


def test_code_quotes_links_and_images(read):
    md = read["inline"]["markdown"][0].markdown
    assert "```\nwith x:\n    y\n```" in md and "\n> said so\n>\n> twice\n\n" in md
    assert "[that **one**](https://example.org/b) ![pic](https://example.org/i.png)" in md
    assert "**spaced** out _x_y\n\n* * *\n\nend\n\nword" in md


def test_ragged_and_nested_tables(read):
    md = read["tables"]["markdown"][0].markdown
    assert "| Team | Q1 | Q2 |\n| --- | --- | --- |\n| P | 12 | a\\|b |\n| R | 7 |  |\n\n| xin sideinner | y |\n| --- | --- |" in md
    found = [(t.caption, t.headers, t.rows) for t in read["tables"]["tables"]]
    assert found == [("", ["Team", "Q1", "Q2"], [["P", "12", "a|b"], ["R", "7"]]), ("in side", [], [["in", "ner"]])]


def test_blocks_skip_chrome_and_close_paragraphs(read):
    blocks = read["blocks"]["blocks"]
    assert [(b.type, b.text) for b in blocks[:6]] == [
        ("paragraph", "one"), ("paragraph", "two"), ("heading", "Head"), ("list_item", "item xagain"), ("figure", "f"), ("paragraph", "g"),
    ]
    assert [b.pos for b in blocks] == list(range(7))
    assert (blocks[2].selector, blocks[2].level, blocks[0].level) == ("#s", 2, None)
    # an id that two elements have is no anchor
    assert blocks[5].selector == "html:nth-of-type(1) > body:nth-of-type(1) > article:nth-of-type(1) > div:nth-of-type(2) > p:nth-of-type(1)"
    assert [(x.text, x.href) for x in blocks[3].links] == [("x", "https://example.org/x")]


def test_metadata_media_and_links(read):
    meta = read["media"]["meta"][0]
    assert (meta.title, meta.author, meta.published, meta.canonical, meta.lang) == ("T", "An Author", "2024-05-01", "https://example.org/docs/c", "en")
    assert (meta.og_image, meta.description, meta.og_title) == ("https://example.org/i.png", "a b", None)
    assert [(m.url, m.kind, m.alt, m.heading) for m in read["media"]["media"]] == [
        ("https://example.org/a.png", "image", "A", "H"), ("https://example.org/f.pdf?x", "download", "file 1", "H"),
        ("https://example.org/docs/v.mp4", "video", None, "K"),
    ]
    assert [(x.url, x.title) for x in read["links"]["links"]] == [("https://example.org/X", "One"), ("https://other.org/%C3%A4%20b?q=1", "a b")]


def test_metadata_falls_back(spark):
    pages = [
        '<time datetime="2020-01-02">x</time><a rel=author>By <b>Me</b></a>', '<script type="application/ld+json">[{"a":1},{"author":{"name":"N"}}]</script>',
        '<script type="application/ld+json">broken</script><meta itemprop=datePublished content=2021>', '<script type="application/ld+json">{"author":"S","datePublished":"2022"}</script>',
    ]
    df = spark.createDataFrame([(k, URL, h) for k, h in enumerate(pages)], "page_id int, url string, html string")
    out = [(r.published, r.author) for r in P.page_meta(page_nodes(df)).orderBy("page_id").collect()]
    assert out == [("2020-01-02", "By Me"), (None, "N"), ("2021", None), ("2022", "S")]


def test_hostile_pages_do_not_crash(spark):
    pages = [None, "", "<", "</p></p>", "<div>" * 5000 + "deep", "<table><tr><td>", "\0", "<p>" * 3000, '<a href="http://[bad">x</a><a href="javascript:x">y</a>']
    df = spark.createDataFrame([(i, None if i == 0 else URL, h) for i, h in enumerate(pages)], "page_id int, url string, html string")
    nodes = page_nodes(df)
    out = {r.page_id: r.markdown for r in P.page_markdown(nodes).collect()}
    assert len(out) == len(pages) and "deep" in out[4] and out[8] == "xy"
    assert P.page_meta(nodes).count() == len(pages)
    assert [P.page_tables(nodes).count(), P.page_media(nodes).count(), P.page_links(nodes).count(), P.page_blocks(nodes).count()] == [0, 0, 0, 0]
    none = page_nodes(df.limit(0))
    assert P.page_markdown(none).count() == P.page_blocks(none).count() == P.page_meta(none).count() == 0


def test_limits_of_a_page(spark):
    html = "<main>" + "".join(f"<p>p{k} {'x' * 9000 if k == 3 else ''}</p><img src=i{k}.png>" for k in range(450)) + "".join(f"<table><tr><td>a<td>{k}</table>" for k in range(45)) + "</main>"
    nodes = page_nodes(spark.createDataFrame([(1, URL, html)], "page_id int, url string, html string"))
    blocks = P.page_blocks(nodes)
    assert blocks.count() == P.MAX_BLOCKS and blocks.agg(F.max(F.length("text"))).first()[0] == P.MAX_TEXT
    assert P.page_media(nodes).count() == P.MAX_MEDIA and P.page_tables(nodes).count() == P.MAX_TABLES


def test_fields_by_selectors():
    html = '<div class="row a"><span data-x="1">10,5</span></div><div class=row><span>20</span></div><p id=q>t</p>'
    spec = {"all": {"selector": "div.row > span", "multiple": True}, "x": {"selector": ".row [data-x]", "attr": "data-x"}, "q": {"selector": "#q"},
            "none": {"selector": "p.row"}, "half": {"selector": ".row span", "divide": 2}, "c": {"const": 1}, "r": {"regex": "id=(.)"}}
    assert C.extract_fields(html, spec) == {"all": "10,5; 20", "x": "1", "q": "t", "none": None, "half": "52.5", "c": "1", "r": "q"}


def test_queries_take_whole_pages(spark, tmp_path):
    from pagemill.queries import QUERIES, reconcile

    wide = "".join("<tr>" + "".join(f"<td>{'y' * 2500 if (r, c) == (3, 2) else f'{r}.{c}'}</td>" for c in range(45)) + "</tr>" for r in range(210))
    links = "".join(f"<a href=/l{k}>l{k}</a> " for k in range(40))
    html = (
        "<article>" + "".join(f"<p>p{k} {'x' * 9000 if k == 3 else 'word'}</p>" for k in range(420)) + f"<p>{links}</p>"
        + "".join(f"<table><tr><td>a</td><td>{k}</td></tr></table>" for k in range(42)) + f"<table>{wide}</table></article>"
    )
    spark.createDataFrame([(1, URL, html)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    blocks = QUERIES["page_blocks"](spark, str(tmp_path))
    row = blocks.agg(F.count_if(F.col("type") == "paragraph"), F.max(F.length(F.when(F.col("type") == "paragraph", F.col("text")))), F.max("links")).first()
    assert row[0] >= 421 and row[1] == 9003 and row[2] == 40
    tables = QUERIES["page_tables"](spark, str(tmp_path)).collect()
    whole = max(tables, key=lambda r: r.rows)
    assert len(tables) == 44 and whole.rows == 210 and len(whole.cells.split(";")[0].split(",")) == 45 and "y" * 2500 in whole.cells
    view = reconcile.views(spark, str(tmp_path)).first()
    assert len(view.tables) == 43 and max(len(t.rows) for t in view.tables) == 210 and len(view.tables[-1].rows[3]) == 45
    assert len(view.tables[-1].rows[3][2]) == 2500 and sum(b.type == "paragraph" for b in view.blocks) == 421
