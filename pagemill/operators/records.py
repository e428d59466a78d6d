"""Records out of a page's rows and links: listings in pairs of rows, and a map of the site around a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize
from . import nodes as N
from .classify import nonsense_link

# Limits and patterns that results depend on.
RECORDS, LEAST_ROWS, LEAST_RECORDS = 200, 4, 2
RANK, POINTS, BY, AGO = r"^[0-9]+\.?$", r"(?i)([0-9]+)\s+points?\b", r"(?i)\bby\s+(\S+)", r"(?i)([0-9]+\s+(?:minute|hour|day|week|month|year)s?\s+ago)"
COMMENTS, SITE = r"(?i)([0-9]+)\s+comments?", r"\(([^)]+)\)"
MAP_LINKS, MAP_HUBS = 64, 3

RECORD = "struct<rank: string, title: string, url: string, site: string, author: string, points: int, comments: int, age: string, row: int>"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def paired_records(rows: Column) -> Column:
    """Records of a listing: a row with a rank or a link, and the row after it that tells points or an author.

    ``rows``: array of (cells, title, url), in order; title and url of a row's first link, null without one. Blank rows
    between pairs are passed over. Fewer than two pairs are no listing, and give none.
    """
    filled = F.filter(rows, lambda r: F.size(r["cells"]) > 0)

    def pair(rs, k):
        head, meta = F.element_at(rs, k + 1), F.array_join(F.element_at(rs, k + 2)["cells"], " ")
        is_meta = meta.rlike(r"(?i)\b[0-9]+\s+points?\b") | meta.rlike(BY)
        is_head = F.exists(head["cells"], lambda c: c.rlike(RANK)) | head["url"].isNotNull()
        rank = F.try_element_at(F.filter(head["cells"], lambda c: c.rlike(RANK)), F.lit(1))
        other = F.filter(head["cells"], lambda c: ~c.eqNullSafe(rank))
        longest = F.try_element_at(F.array_sort(F.transform(other, lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("c")))), F.lit(1))["c"]
        title = F.coalesce(F.nullif(F.trim(head["title"]), F.lit("")), longest, F.lit(""))
        host = F.nullif(F.regexp_replace(T.url_host(F.coalesce(head["url"], F.lit(""))), r"^www\.", ""), F.lit(""))
        site = F.coalesce(_first(meta, SITE), _first(F.array_join(head["cells"], " "), SITE), host)
        comments = F.coalesce(_first(meta, COMMENTS).cast("int"), F.when(meta.rlike(r"(?i)\bdiscuss\b"), 0))
        record = F.struct(
            F.regexp_replace(rank, r"\.$", "").alias("rank"), F.nullif(title, F.lit("")).alias("title"), head["url"].alias("url"), site.alias("site"),
            _first(meta, BY).alias("author"), _first(meta, POINTS).cast("int").alias("points"), comments.alias("comments"),
            _first(meta, AGO).alias("age"), k.alias("row"),
        )
        return is_meta & is_head, F.when((title != "") | head["url"].isNotNull(), record)

    def scan(rs):
        def step(acc, k):
            fits, record = pair(rs, k)
            found = fits & (k >= acc["next"]) & (F.size(acc["out"]) < RECORDS)
            after = F.try_element_at(rs, k + 3)
            blank = F.coalesce(~F.exists(after["cells"], lambda c: F.trim(c) != ""), F.lit(False))
            out = F.when(found & record.isNotNull(), F.concat(acc["out"], F.array(record))).otherwise(acc["out"])
            return F.struct(F.when(found, k + F.when(blank, 3).otherwise(2)).otherwise(acc["next"]).alias("next"), out.alias("out"))

        start = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{RECORD}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(rs) - 2), start, step, lambda acc: acc["out"])

    listed = F.element_at(F.transform(F.array(filled), lambda rs: F.when(F.size(rs) >= LEAST_ROWS, scan(rs))), 1)
    return F.when(F.size(listed) >= LEAST_RECORDS, listed).otherwise(F.array().cast(f"array<{RECORD}>"))


def table_rows(nodes: DataFrame) -> DataFrame:
    """(page_id, table, rows): the rows of every innermost table, as ``paired_records`` takes them, with their first links."""
    table, tr = N.nearest(F.col("path"), ["table"])["pos"], N.nearest(F.col("path"), ["tr"])["pos"]
    cell = N.nearest(F.col("path"), ["td", "th"])["pos"]
    rows = nodes.withColumn("table", table).withColumn("tr", tr).filter("table is not null and tr > table")
    texts = F.collect_list(F.when(F.col("tag") == "#text", F.struct("pos", "text")))
    cells = rows.withColumn("cell", cell).filter("cell > tr").groupBy("page", "page_id", "table", "tr", "cell").agg(N.squeeze(N.joined_text(texts)).alias("text"))
    anchor = N.nearest(F.col("path"), ["a"])["pos"]
    links = rows.withColumn("a", anchor).filter("a > tr").groupBy("page", "tr", "a").agg(
        N.squeeze(N.joined_text(texts)).alias("title"), F.max(F.when(F.col("pos") == F.col("a"), F.col("url"))).alias("url")
    )
    first = links.filter("url is not null").groupBy("page", "tr").agg(F.min_by(F.struct("title", "url"), "a").alias("link"))
    filled = cells.groupBy("page", "page_id", "table", "tr").agg(F.array_sort(F.collect_list(F.struct("cell", "text"))).alias("cells"))
    row = F.struct("tr", F.transform("cells", lambda c: c["text"]).alias("cells"), F.col("link.title").alias("title"), F.col("link.url").alias("url"))
    listed = filled.join(first, ["page", "tr"], "left").groupBy("page", "page_id", "table").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    bare = F.transform("rows", lambda r: F.struct(r["cells"].alias("cells"), r["title"].alias("title"), r["url"].alias("url")))
    return listed.select("page_id", "table", bare.alias("rows"))


def site_map(pages: DataFrame, key: str, host: str, links: str, most: int = MAP_LINKS, same_host: bool = True) -> DataFrame:
    """``key`` with ``urls``, the links of each page that a reader would follow, and ``filtered``, how many are none.

    ``links``: array of (url, title), in order. Each address once, whatever its case; at most ``most``; of the page's own host.
    """
    def fits(x):
        return F.lit(True) if not same_host else T.host_key(x["url"]) == F.regexp_replace(F.col(host), r"^www\.", "")

    low = F.transform(F.col(links), lambda x: F.lower(x["url"]))
    first = F.filter(F.col(links), lambda x, i: F.array_position(low, F.lower(x["url"])) == i + 1)
    own = F.filter(first, fits)
    good = F.filter(own, lambda x: ~nonsense_link(x["url"], T.url_path(x["url"]), x["title"]))
    return pages.select(
        key, F.slice(F.transform(good, lambda x: x["url"]), 1, most).alias("urls"), (F.size(own) - F.size(good)).alias("filtered")
    )


def link_rounds(starts: DataFrame, edges: DataFrame, rounds: int | None = None, hubs: int | None = None, order: str = "node") -> DataFrame:
    """(start, node, level): what links reach from each of ``starts`` (start, node), by rounds; materialised.

    Semi-naive: a round joins only what the one before reached first with ``edges`` (node, next), and drops by an anti join
    what is known. Without ``rounds`` it goes on until nothing is new, else so many times. ``hubs``: each start goes on
    from the first so many of a round's nodes, by ``order``, an expression over (start, node). A start is at level 0; what
    it never reaches has no row. Repeated starts, edges and circles add nothing; nulls join nothing.
    """
    frontier = materialize(starts.select("start", "node").distinct().filter("start is not null and node is not null").withColumn("level", F.lit(0)), "level")
    known, level = frontier, 0
    while rounds is None or level < rounds:
        level += 1
        going = frontier
        if hubs is not None and level > 1:
            place = F.row_number().over(Window.partitionBy("start").orderBy(F.expr(order)))
            going = frontier.withColumn("__n", place).filter(F.col("__n") <= hubs)
        reached = going.select("start", "node").join(edges.select("node", "next"), "node").select("start", F.col("next").alias("node")).distinct()
        fresh = reached.filter("node is not null").join(known.select("start", "node"), ["start", "node"], "left_anti")
        frontier = materialize(fresh.withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known
