"""Listings and site maps made of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..operators import records as R
from ..operators.nodes import page_nodes, within
from ..registry import query, table
from ..storage import materialize
from .classify import _ENDS, LINKS, link_arrays
from .text import sql_any


#: A listing of the links in a page's menu: a title row for each, and one that tells of it, then a blank one.
_HEAD, _META, _BLANK = "<tr><td>{k}.</td><td><a href=\"/{w}\">{w} story</a> ({w}.net)</td></tr>", "<tr><td>{n} points by {w} {k} hours ago | {k} comments</td></tr>", "<tr><td> </td></tr>"


@query("paired_records", r"""
WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS b, list_filter(regexp_extract_all(html, '<a href="/([^"]*)"', 1), lambda w: regexp_matches(w, '^[A-Za-z]+$')) AS ws FROM pages),
k AS (SELECT page_id, b, len(ws) AS m, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS w FROM a)
SELECT page_id, CAST(k AS VARCHAR) AS rank, w || ' story' AS title, lower(b) || '/' || w AS url, w || '.net' AS site, w AS author, CAST(length(w) AS INTEGER) AS points,
  CAST(k AS INTEGER) AS comments, k || ' hours ago' AS age, CAST(3 * (k - 1) AS INTEGER) AS "row"
FROM k WHERE m > 1
""")
def paired_records(spark, sf_dir):
    """The records of a listing that stands in every page, read from the table's rows."""
    w = F.filter(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), 1), lambda x: x.rlike("^[A-Za-z]+$"))

    def story(x, i):
        out = F.lit(_HEAD + _META + _BLANK)
        for name, value in (("{w}", x), ("{k}", (i + 1).cast("string")), ("{n}", F.length(x).cast("string"))):
            out = F.replace(out, F.lit(name), value)
        return out

    listing = F.concat(F.lit("</nav><table>"), F.array_join(F.transform(w, story), ""), F.lit("</table>"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("</nav>"), listing).alias("html"))
    found = R.table_rows(page_nodes(pages)).select("page_id", F.explode(R.paired_records(F.col("rows"))).alias("r"))
    return found.select("page_id", "r.*")


#: Pages as links name them: a link's word leads to the first page, by address, whose title begins with it.
_EDGES = r"""
t AS (SELECT page_id, url, lower(regexp_extract(trim(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&')), '^(\S*)', 1)) AS word FROM pages),
home AS (SELECT word, arg_min(page_id, url || ' ' || page_id) AS next FROM t WHERE word <> '' GROUP BY word),
l AS (SELECT DISTINCT page_id, lower(replace(replace(unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)), '&quot;', '"'), '&amp;', '&')) AS word FROM pages),
e AS (SELECT DISTINCT l.page_id AS node, home.next FROM l JOIN home USING (word))
"""


def page_edges(spark, sf_dir):
    nodes = page_nodes(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    urls = nodes.filter("tag = '#page'").select("page", "page_id", "url")
    titles = nodes.filter((F.col("tag") == "#text") & within(F.col("path"), ["title"])).groupBy("page").agg(F.min_by("text", "pos").alias("text"))
    word = F.lower(F.regexp_extract(F.trim("text"), r"^(\S*)", 1))
    named = urls.join(titles, "page").select("page_id", "url", word.alias("word")).filter("word <> ''")
    home = named.groupBy("word").agg(F.min_by("page_id", F.concat("url", F.lit(" "), F.col("page_id").cast("string"))).alias("next"))
    href = F.col("attrs")["href"]
    links = nodes.filter((F.col("tag") == "a") & href.startswith("/")).select("page_id", F.lower(F.substring(href, 2, 1 << 20)).alias("word"))
    return materialize(links.distinct().join(home, "word").select(F.col("page_id").alias("node"), "next").distinct(), "edges")


@query("second_level", f"""
WITH {_EDGES}, one AS (SELECT node AS start, next AS node FROM e WHERE node <> next),
hubs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY node) AS k FROM one) WHERE k <= 3)
SELECT start, node, CAST(1 AS INTEGER) AS level FROM one
UNION ALL
SELECT DISTINCT h.start, e.next, CAST(2 AS INTEGER) FROM hubs h JOIN e ON h.node = e.node WHERE e.next <> h.start AND NOT EXISTS (FROM one o WHERE o.start = h.start AND o.node = e.next)
""")
def second_level(spark, sf_dir):
    """What each page links to, and what the first three of those pages link to in turn."""
    starts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("start"), F.col("page_id").alias("node"))
    return R.link_rounds(starts, page_edges(spark, sf_dir), rounds=2, hubs=R.MAP_HUBS).filter("level > 0")


@query("link_distance", f"""
WITH RECURSIVE {_EDGES}, r AS (
  SELECT page_id AS node, 0 AS level FROM pages WHERE url LIKE '%?%'
  UNION
  SELECT e.next, r.level + 1 FROM r JOIN e ON r.node = e.node WHERE r.level < 40
)
SELECT node, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY node
""")
def link_distance(spark, sf_dir):
    """How many links away each page is from the nearest page whose address has a query, as far as links reach."""
    starts = table(spark, sf_dir, "pages").filter(F.col("url").contains("?")).select(F.lit(0).alias("start"), F.col("page_id").alias("node"))
    return R.link_rounds(starts, page_edges(spark, sf_dir)).select("node", "level")


_NONSENSE = rf"""({sql_any("p", C.NONSENSE_PATHS)} OR regexp_matches(p, '{_ENDS}$') OR regexp_matches(lower(url), '{_ENDS}\?')
  OR {sql_any("lower(trim(title))", C.SOFT_404_TITLES)} OR (p NOT IN ('/', '') AND {sql_any("p", C.SOFT_404_PATHS)}))"""
_MAPPED = rf"""
WITH a AS (SELECT page_id, i, url, title, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS p, row_number() OVER (PARTITION BY page_id, lower(url) ORDER BY i) AS k FROM {LINKS}),
b AS (SELECT *, {_NONSENSE} AS nonsense FROM a WHERE k = 1), c AS (SELECT *, row_number() OVER (PARTITION BY page_id, nonsense ORDER BY i) AS place FROM b)
"""


@query("site_map", _MAPPED + """
SELECT page_id, CAST(count(*) FILTER (WHERE NOT nonsense AND place <= 64) AS INTEGER) AS urls, CAST(count(*) FILTER (WHERE nonsense) AS INTEGER) AS filtered,
  coalesce(string_agg(url, ' ' ORDER BY i) FILTER (WHERE NOT nonsense AND place <= 64), '') AS listed FROM c GROUP BY page_id
""")
def site_map(spark, sf_dir):
    """The pages around every page that has links: what is worth following, and how much is not."""
    hosts = table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))
    links = link_arrays(spark, sf_dir).filter(F.size("links") > 0).join(hosts, "page_id")
    maps = R.site_map(links, "page_id", "host", "links")
    return maps.select("page_id", F.size("urls").alias("urls"), "filtered", F.array_join("urls", " ").alias("listed"))
