"""Queries over feeds, robots files and addresses, made of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordered as O
from ..registry import query, table
from ..sources import web as S

#: Items that are read of a feed.
FEED = 200


def feeds(spark, sf_dir):
    """One feed a source out of whole texts: the first of all its documents, as many as are read of a feed."""
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("k", first).filter(F.col("k") <= FEED)
    docs = docs.withColumn("source", F.coalesce("source", F.lit("")))
    i = F.col("doc_id").cast("string")
    summary = F.concat(F.lit("<![CDATA[<p>a &lt; b "), "text", F.lit("</p>]]>"))
    rss = F.concat(F.lit("<item><title>T &amp; "), i, F.lit("</title><link>http://h/"), i, F.lit("</link><pubDate>2024</pubDate><description>"), summary, F.lit("</description></item>"))
    return docs.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", rss.alias("x")))), lambda s: s["x"]), "").alias("items")).select(
        "source", F.concat(F.lit("<?xml version='1.0'?><rss><channel><title>Feed "), "source", F.lit("</title>"), "items", F.lit("</channel></rss>")).alias("xml")
    )


@query("feed_items", r"""
SELECT coalesce(source, '') AS source, 'T & ' || doc_id AS title, 'http://h/' || doc_id AS link, '2024' AS published, substr(trim(regexp_replace('a < b ' || text, '\s+', ' ', 'g')), 1, 4000) AS summary
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k <= 200
""")
def feed_items(spark, sf_dir):
    return items_of(feeds(spark, sf_dir))


def items_of(df):
    df = df.filter(S.is_feed(F.lit("text/html"), F.col("xml")))
    return df.select("source", F.explode(S.rss_items(F.col("xml"))).alias("i")).select("source", "i.*")


@query("json_feed", """
SELECT doc_id, true AS json_feed, 'T' || doc_id AS title, 'http://h/' || doc_id AS link,
  substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), 1, 4000) AS summary FROM documents WHERE text IS NOT NULL
""".replace("\\\\", "\\"))
def json_feed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    i = F.col("doc_id").cast("string")
    item = F.struct(F.concat(F.lit("T"), i).alias("title"), F.concat(F.lit("http://h/"), i).alias("url"), F.col("text").alias("content_text"))
    body = F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.array(item).alias("items")))
    df = docs.select("doc_id", body.alias("body"))
    return df.select("doc_id", S.is_json_feed(F.lit(None).cast("string"), F.col("body")).alias("json_feed"), F.explode(S.json_feed_items(F.col("body"))).alias("i")).select(
        "doc_id", "json_feed", "i.title", "i.link", "i.summary"
    )


@query("feed_markdown", """
SELECT coalesce(source, '') AS source, 1 + 1 + 2 * CAST(count(*) AS INTEGER) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k <= 200 GROUP BY source
""")
def feed_markdown(spark, sf_dir):
    return lines_of(feeds(spark, sf_dir))


def lines_of(df):
    markdown = S.feed_markdown(F.col("source"), S.rss_items(F.col("xml")))
    return df.select("source", F.size(F.split(markdown, "\n")).cast("int").alias("lines"))


@query("body_cap", "SELECT page_id, strlen(html) > 3000 AS over, CASE WHEN strlen(html) <= 3000 THEN sha256(html) ELSE sha256(regexp_extract(substr(html, 1, 3000), '(?s)^(.*>)', 1)) END AS kept FROM pages WHERE html IS NOT NULL")
def body_cap(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter("html is not null")
    return pages.select("page_id", S.cap_body(F.col("html"), 3000, False).isNull().alias("over"), F.sha2(S.cap_body(F.col("html"), 3000, True), 256).alias("kept"))


@query("plain_text", """
SELECT doc_id, NOT contains(x, chr(7)) AS passes, CASE WHEN regexp_matches(x, '(?m)^(#{1,6} |[-*] |```|\\d+\\. |\\|)') THEN sha256(x) ELSE sha256('```' || chr(10) || x || chr(10) || '```') END AS body
FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '# ' || text WHEN doc_id % 6 = 1 THEN repeat(chr(7), 400) || text ELSE text END AS x FROM documents WHERE text IS NOT NULL)
""".replace("\\\\", "\\"))
def plain_text(spark, sf_dir):
    i = F.col("doc_id")
    x = F.when(i % 6 == 0, F.concat(F.lit("# "), "text")).when(i % 6 == 1, F.concat(F.repeat(F.lit("\x07"), F.lit(400)), "text")).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("x", x)
    return docs.select("doc_id", S.passes_as_text(F.lit("text/plain"), F.col("x")).alias("passes"), F.sha2(S.fenced_text(F.col("x")), 256).alias("body"))


@query("format_detect", """
SELECT page_id, page_id % 4 = 0 AS pdf, CASE WHEN page_id % 3 = 0 THEN '/next/' || page_id END AS refresh FROM pages WHERE html IS NOT NULL
""")
def format_detect(spark, sf_dir):
    i = F.col("page_id")
    url = F.when(i % 4 == 0, F.concat(F.lit("http://h/a"), i.cast("string"), F.lit(".PDF?x=1"))).otherwise(F.col("url"))
    html = F.when(i % 3 == 0, F.concat(F.lit('<META http-equiv="Refresh" content="0; URL=/next/'), i.cast("string"), F.lit('">'), "html")).otherwise(F.col("html"))
    pages = table(spark, sf_dir, "pages").filter("html is not null")
    return pages.select("page_id", S.is_pdf(F.lit("text/html"), url, html).alias("pdf"), S.refresh_target(html).alias("refresh"))


@query("robots", r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, starts_with(path, '/' || ['en', 'de', 'fr', 'es'][1 + length(h) % 4] || '/') OR starts_with(path, '/en/1') AS disallowed, CAST(length(h) % 5 AS DOUBLE) AS delay FROM p
""")
def robots(spark, sf_dir):
    """Each page against the robots file of its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("h"), T.url_path(F.col("url")).alias("path"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), F.length("h") % 4 + 1)
    body = F.concat(
        F.lit("# rules\nUser-agent: evil\nDisallow: /\n\nUser-Agent: *\nDisallow: /"), lang, F.lit("/\nDisallow: /en/1 # part\nDisallow:\nCrawl-delay: "),
        (F.length("h") % 5).cast("string"), F.lit("\n\nUser-agent: other\nDisallow: /x"),
    )
    rules = pages.select("h").distinct().select("h", S.robots_rules(body).alias("r"))
    return pages.join(rules, "h").select("page_id", S.is_disallowed(F.col("path"), F.col("r.disallow")).alias("disallowed"), F.col("r.delay").alias("delay"))


@query("sitemap", """
SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host, CAST(least(50, count(DISTINCT url)) AS INTEGER) AS urls FROM pages WHERE url IS NOT NULL GROUP BY 1
""".replace("\\\\", "\\"))
def sitemap(spark, sf_dir):
    """One sitemap a host, with its first 50 different pages, twice one of them and a foreign one."""
    pages = table(spark, sf_dir, "pages").filter("url is not null").select("url", T.host_key(F.col("url")).alias("host")).distinct()
    pages = pages.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy("url"))).filter("k <= 50")
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = pages.groupBy("host").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.min(loc), F.lit("<loc>http://foreign.net/</loc></urlset>")).alias("xml"))
    return maps.select("host", F.size(S.sitemap_urls(F.col("xml"), F.col("host"), 50)).alias("urls"))


_NET = "['10.0.0.1', '172.20.1.1', '172.32.1.1', '192.168.3.4', '169.254.1.1', '8.8.8.8', 'localhost', 'db.internal', 'printer.local']"


@query("url_privacy", f"""
SELECT page_id, CASE WHEN page_id % 11 = 10 THEN 'bad_scheme' WHEN page_id % 11 = 9 THEN 'public' ELSE ['private_ip', 'private_ip', 'public', 'private_ip', 'private_ip', 'public', 'localhost', 'internal_name', 'internal_name'][1 + page_id % 11] END AS privacy FROM pages WHERE url IS NOT NULL
""")
def url_privacy(spark, sf_dir):
    i = F.col("page_id")
    hosts = F.array(*[F.lit(x.strip(" '")) for x in _NET.strip("[]").split(",")])
    url = F.when(i % 11 == 10, "ftp://h/x").when(i % 11 == 9, F.col("url")).otherwise(F.concat(F.lit("http://"), F.try_element_at(hosts, (i % 11 + 1).cast("int")), F.lit(":80/x")))
    return table(spark, sf_dir, "pages").filter("url is not null").select("page_id", S.url_privacy(url).alias("privacy"))


@query("headers_merge", r"""
SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS accept, regexp_extract(html, 'lang="([a-z]*)"', 1) AS cookie, CAST(2 AS INTEGER) AS n FROM pages
""")
def headers_merge(spark, sf_dir):
    """Each page's default headers under its own, whatever their case."""
    lang = F.regexp_extract("html", 'lang="([a-z]*)"', 1)
    merged = S.merge_headers(F.create_map(F.lit("Accept"), F.lit("a"), F.lit("Cookie"), lang), F.create_map(F.lit("ACCEPT"), T.url_host(F.col("url"))))
    return table(spark, sf_dir, "pages").select("page_id", merged["accept"].alias("accept"), merged["cookie"].alias("cookie"), F.size(merged).alias("n"))


@query("proxy_list", """
SELECT user_id, CAST(count(DISTINCT event_type) + 1 AS INTEGER) AS n, 'http://u:p@h' || count(*) || ':81' AS last FROM events GROUP BY user_id
""")
def proxy_list(spark, sf_dir):
    """A list of what each user's events name, some of it twice and some broken."""
    kinds = F.transform(F.array_sort(F.collect_set("event_type")), lambda k: F.concat(F.lit("socks5://"), k, F.lit(":1")))
    text = F.concat(F.lit("# list\n"), F.array_join(F.concat(kinds, kinds), "\n"), F.lit("\n\nbroken\n h"), F.count("*").cast("string"), F.lit(" , 81, u, p\n"))
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(text.alias("text"))
    entries = S.proxy_entries(F.col("text"))
    return lists.select("user_id", F.size(entries).alias("n"), F.element_at(entries, -1).alias("last"))


@query("host_throttle", """
WITH a AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT event_id, CAST(max(t - k * 500) OVER (PARTITION BY user_id ORDER BY k) + k * 500 AS BIGINT) AS start_ms FROM a
""")
def host_throttle(spark, sf_dir):
    """Earliest start of each request if a host may be asked once in 500 ms: a running maximum says it."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    keys, order = ["user_id"], ["ts", "event_id"]
    placed = O.with_place(O.in_parts(df, keys, order), keys, order, "k").withColumn("free", F.col("t") - F.col("k") * 500)
    latest = O.with_running_max(placed, keys, order, "free", "latest")
    return latest.select("event_id", (F.col("latest") + F.col("k") * 500).cast("bigint").alias("start_ms"))


@query("round_robin", "SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 5 AS INTEGER) AS slot FROM events")
def round_robin(spark, sf_dir):
    """Turns of each user over five slots."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id")
    placed = O.with_place(O.in_parts(df, ["user_id"], ["event_id"]), ["user_id"], ["event_id"], "k")
    return placed.select("event_id", F.pmod("k", F.lit(5)).cast("int").alias("slot"))
