"""Formats that come beside pages: feeds, robots files, sitemaps, plain text, addresses that must not be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

JSON_FEED = (
    "struct<version: string, title: string, items: array<struct<title: string, url: string, external_url: string, "
    "content_html: string, content_text: string, summary: string, date_published: string, date_modified: string>>>"
)
#: Most characters of a summary.
SUMMARY = 4000


def is_feed(content_type: Column, body: Column) -> Column:
    kind, head = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 512))
    return T.contains_any(kind, ("rss", "atom", "feed+json", "application/xml", "text/xml")) | T.contains_any(
        head, ("<rss", "<feed", "<rdf:rdf", "jsonfeed.org")
    )


def is_json_feed(content_type: Column, body: Column) -> Column:
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 512))
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("feed+json") | (head.contains("{") & head.contains("jsonfeed.org"))


def html_to_text(html: Column) -> Column:
    """Summary text: no tags, the usual entities decoded, white space collapsed, clamped."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, SUMMARY)


def rss_items(xml: Column) -> Column:
    """Items of an RSS, RDF or Atom feed: array of (title, link, published, summary)."""

    def one(node, names):
        out = None
        for n in names:
            raw = F.regexp_extract(node, rf"(?is)<{n}(?:\s[^>]*)?>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{n}>", 1)
            value = F.nullif(F.trim(F.regexp_replace(raw, r"\s+", " ")), F.lit(""))
            out = value if out is None else F.coalesce(out, value)
        return out

    nodes = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)

    def item(node):
        atom = F.coalesce(
            F.nullif(F.regexp_extract(node, r"(?is)<link\b(?=[^>]*rel=\"alternate\")[^>]*href=\"([^\"]*)\"", 1), F.lit("")),
            F.nullif(F.regexp_extract(node, r"(?is)<link\b(?![^>]*rel=)[^>]*href=\"([^\"]*)\"", 1), F.lit("")),
            F.nullif(F.regexp_extract(node, r"(?is)<link\b[^>]*href=\"([^\"]*)\"", 1), F.lit("")),
        )
        return F.struct(
            html_to_text(one(node, ("title",))).alias("title"), F.coalesce(one(node, ("link",)), atom, F.lit("")).alias("link"),
            F.coalesce(one(node, ("pubDate", "published", "updated", "dc:date")), F.lit("")).alias("published"),
            html_to_text(one(node, ("description", "content:encoded", "summary", "content"))).alias("summary"),
        )

    return F.slice(F.transform(nodes, item), 1, 200)


def json_feed_items(body: Column) -> Column:
    feed = F.from_json(body, JSON_FEED)

    def item(x):
        return F.struct(
            F.coalesce(x["title"], F.lit("")).alias("title"), F.coalesce(x["url"], x["external_url"], F.lit("")).alias("link"),
            F.coalesce(x["date_published"], x["date_modified"], F.lit("")).alias("published"),
            html_to_text(F.coalesce(x["content_html"], x["content_text"], x["summary"])).alias("summary"),
        )

    return F.slice(F.transform(feed["items"], item), 1, 200)


def feed_markdown(title: Column, items: Column) -> Column:
    lines = F.transform(
        items,
        lambda x: F.concat(
            F.lit("- ["), x["title"], F.lit("]("), x["link"], F.lit(")"),
            F.when(x["published"] != "", F.concat(F.lit(" — "), x["published"])).otherwise(""),
            F.when(x["summary"] != "", F.concat(F.lit("\n  "), x["summary"])).otherwise(""),
        ),
    )
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(lines, "\n"))


def cap_body(html: Column, cap: int, partial: bool) -> Column:
    """A body over ``cap`` bytes: null, or its part up to the last whole tag."""
    cut = F.substring(html, 1, cap)
    part = F.regexp_extract(cut, r"(?s)^(.*>)", 1)
    return F.when(F.octet_length(html) <= cap, html).when(F.lit(partial), part)


def passes_as_text(content_type: Column, body: Column) -> Column:
    """Plain text: a text type, no NUL and under 2 % unprintable characters in the first 4096."""
    head = F.substring(F.coalesce(body, F.lit("")), 1, 4096)
    odd = F.length(F.regexp_replace(head, r"[^\x01-\x08\x0B\x0C\x0E-\x1F]", ""))
    kind = F.lower(content_type).rlike("^(text/(plain|markdown|csv|x-)|application/(json|x-yaml|yaml|toml))")
    return kind & ~head.contains("\0") & (odd < 0.02 * F.greatest(F.length(head), F.lit(1)))


def fenced_text(body: Column) -> Column:
    looks = body.rlike(r"(?m)^(#{1,6} |[-*] |```|\d+\. |\|)")
    return F.when(looks, body).otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```")))


def is_pdf(content_type: Column, url: Column, body: Column) -> Column:
    return F.lower(content_type).contains("application/pdf") | F.lower(T.url_path(url)).endswith(".pdf") | body.startswith("%PDF-")


def refresh_target(html: Column) -> Column:
    """Where a meta refresh leads."""
    tag = F.regexp_extract(html, r"(?is)(<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>)", 1)
    return F.nullif(F.trim(F.regexp_extract(tag, r"(?is)url\s*=\s*[\"']?([^\"'>;]+)", 1)), F.lit(""))


def robots_rules(body: Column) -> Column:
    """(disallow, delay) of the ``*`` group of a robots file."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    start = F.struct(
        F.lit(False).alias("ours"), F.lit(False).alias("agents"), F.array().cast("array<string>").alias("disallow"), F.lit(0.0).alias("delay")
    )

    def step(acc, line):
        key, value = F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
        agent = key == "user-agent"
        ours = F.when(agent, (value == "*") | (acc["agents"] & acc["ours"])).otherwise(acc["ours"])
        add = ~agent & acc["ours"] & (key == "disallow") & (value != "")
        delay = F.when(~agent & acc["ours"] & (key == "crawl-delay"), F.coalesce(value.try_cast("double"), F.lit(0.0))).otherwise(0.0)
        return F.struct(
            ours.alias("ours"), F.when(line == "", acc["agents"]).otherwise(agent).alias("agents"),
            F.when(add, F.concat(acc["disallow"], F.array(value))).otherwise(acc["disallow"]).alias("disallow"),
            F.greatest(acc["delay"], delay).alias("delay"),
        )

    return F.aggregate(lines, start, step, lambda acc: F.struct(acc["disallow"].alias("disallow"), acc["delay"].alias("delay")))


def is_disallowed(path: Column, disallow: Column) -> Column:
    return F.exists(disallow, lambda d: path.startswith(d))


def robots_sitemaps(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1))


def sitemap_urls(xml: Column, host: Column, most: int) -> Column:
    """Addresses of a sitemap on the same host, each once."""
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.slice(F.array_distinct(F.filter(found, lambda u: T.host_key(u) == host)), 1, most)


def url_privacy(url: Column) -> Column:
    """``public``, or why an address must not be fetched: bad_scheme, localhost, internal_name or private_ip."""
    host = T.url_host(url)
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    a, b = octets[0], octets[1]
    dotted = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    private = (
        a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    )
    six = F.lower(F.regexp_extract(url, r"://\[([^\]]*)\]", 1))
    private_six = six.isin("::1", "::") | six.rlike(r"^(fe[89ab]|f[cd])") | six.rlike(r"^::ffff:(0|10|127|192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01]))\.")
    return (
        F.when(~T.url_scheme(url).isin("http", "https"), "bad_scheme").when((host == "localhost") | host.endswith(".localhost"), "localhost")
        .when(host.rlike(r"\.(local|internal)$"), "internal_name").when(dotted & private, "private_ip").when(private_six, "private_ip")
        .otherwise("public")
    )


def merge_headers(base: Column, over: Column) -> Column:
    """Two header maps, names in any case; those of ``over`` win."""

    def low(m):
        return F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))

    first, second = low(base), low(over)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def proxy_entries(text: Column) -> Column:
    """Proxy addresses of a list: ``host,port[,user,password]`` or ``scheme://host:port`` lines."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))

    def one(x):
        parts = F.transform(F.split(x, ","), lambda p: F.trim(p))
        auth = F.when(F.size(parts) >= 4, F.concat(parts[2], F.lit(":"), parts[3], F.lit("@"))).otherwise("")
        return F.when(x.contains("://"), x).when(F.size(parts) >= 2, F.concat(F.lit("http://"), auth, parts[0], F.lit(":"), parts[1]))

    return F.array_distinct(F.array_compact(F.transform(lines, one)))
