"""What a page holds, from its node table: blocks, tables, media, links, metadata and markdown.

An element or text belongs to what its path passes, so a row finds its block, cell, anchor or list without a join; texts are
put together by grouping within the page. Only the page's content root and its unique ids are joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import HEADINGS
from . import nodes as N
from .article import picked

KINDS = {
    "p": "paragraph", "li": "list_item", "dt": "list_item", "dd": "list_item", "pre": "code", "blockquote": "quote",
    "table": "table", "figure": "figure", **dict.fromkeys(HEADINGS, "heading"),
}
MAX_BLOCKS, MAX_TEXT, MAX_LINKS = 400, 8000, 32
MAX_TABLES, MAX_ROWS, MAX_COLUMNS, MAX_CELL = 40, 200, 40, 2000
MAX_MEDIA, MAX_TITLE = 32, 120
DOWNLOAD = r"(?i)\.(pdf|zip|gz|docx?|xlsx?|pptx?|csv|epub)$"
LISTS, QUOTE = ("ul", "ol"), "blockquote"


def _key() -> list[str]:
    return ["page", "page_id"]


def _first(value: Column) -> Column:
    return F.first(value, ignorenulls=True)


def _ranked(df: DataFrame, most: int | None, order: str = "pos") -> DataFrame:
    """The first ``most`` rows of each page, or all."""
    if most is None:
        return df
    place = F.row_number().over(Window.partitionBy("page").orderBy(order))
    return df.withColumn("__n", place).filter(F.col("__n") <= most).drop("__n")


def _kept(texts: Column) -> Column:
    """The rows whose one-element array is not empty, with its ``text``; a filter on a text that is made here would make it twice."""
    return F.explode(texts).alias("text")


def _texts(rows: DataFrame, place: Column, name: str) -> DataFrame:
    """(page, ``name``, text): the squeezed text of the rows of each ``place``."""
    pieces = F.collect_list(F.struct("pos", "text"))
    return (
        rows.filter((F.col("tag") == "#text") & place.isNotNull()).groupBy("page", place.alias(name))
        .agg(N.squeeze(N.joined_text(pieces)).alias("text"))
    )


def content(nodes: DataFrame) -> DataFrame:
    """The nodes below each page's content root, with ``own``: their path below it.

    The root is the element picked by name; else the body, else the page.
    """
    body = nodes.filter("tag = 'body'").groupBy("page").agg(F.min_by(F.struct("pos", "last"), "pos").alias("body"))
    whole = nodes.filter("tag = '#page'").select("page", F.struct("pos", "last").alias("whole"))
    best = picked(nodes).select("page", F.struct("pos", "last").alias("best"))
    roots = whole.join(body, "page", "left").join(best, "page", "left").select("page", F.coalesce("best", "body", "whole").alias("root"))
    held = nodes.join(roots, "page").filter((F.col("pos") > F.col("root.pos")) & (F.col("pos") <= F.col("root.last")))
    return held.withColumn("own", F.filter("path", lambda p: p["pos"] > F.col("root.pos"))).drop("root")


def with_selectors(df: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """``df`` with the selector of ``path``: steps by place among siblings, from the innermost element whose id is the page's only one."""
    ids = nodes.filter(F.coalesce(F.col("attrs")["id"], F.lit("")) != "").groupBy("page", F.col("attrs")["id"].alias("id"))
    unique = ids.agg(F.count("*").alias("n"), F.min("pos").alias("at")).filter("n = 1").groupBy("page").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "id"))).alias("__ids")
    )
    known = F.coalesce(F.col("__ids"), F.create_map().cast("map<int,string>"))
    anchor = F.try_element_at(F.filter(path, lambda p: F.map_contains_key(known, p["pos"])), F.lit(-1))["pos"]
    steps = F.transform(
        F.filter(path, lambda p: F.col("__at").isNull() | (p["pos"] > F.col("__at"))),
        lambda p: F.concat(p["tag"], F.lit(":nth-of-type("), p["nth"].cast("string"), F.lit(")")),
    )
    lead = F.when(F.col("__at").isNotNull(), F.array(F.concat(F.lit("#"), F.try_element_at(known, F.col("__at"))))).otherwise(F.array().cast("array<string>"))
    found = df.join(unique, "page", "left").withColumn("__at", anchor)
    return found.withColumn("selector", F.array_join(F.concat(lead, steps), " > ")).drop("__ids", "__at")


def _up_to(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def page_blocks(
    nodes: DataFrame, most: int | None = MAX_BLOCKS, longest: int | None = MAX_TEXT, most_links: int | None = MAX_LINKS
) -> DataFrame:
    """(page_id, pos, type, text, links, selector, level): the content's outermost blocks outside chrome.

    ``most`` of them a page, with ``longest`` characters and ``most_links`` links each; with None all of them, whole.
    """
    inside = content(nodes)
    stop = F.try_element_at(F.filter("own", lambda p: p["tag"].isin(*KINDS, *N.SKIPPED)), F.lit(1))
    rows = inside.withColumn("stop", stop).filter(F.col("stop.tag").isin(*KINDS))
    rows = rows.filter((F.col("tag") == "#text") | (F.col("tag") == "a") | (F.col("pos") == F.col("stop.pos")))
    item = F.struct("pos", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("tag") == "a", F.col("url")).alias("href"), N.nearest(F.col("path"), ["a"])["pos"].alias("a"))
    held = rows.groupBy(*_key(), F.col("stop.pos").alias("at"), F.col("stop.tag").alias("tag")).agg(
        F.array_sort(F.collect_list(item)).alias("items"), _first(F.when(F.col("pos") == F.col("stop.pos"), F.col("path"))).alias("path")
    )

    def link(x: Column) -> Column:
        own = F.filter("items", lambda y: y["a"] == x["pos"])
        return F.struct(N.squeeze(F.array_join(F.transform(own, lambda y: y["text"]), "")).alias("text"), x["href"].alias("href"))

    named = F.filter("items", lambda x: x["href"].isNotNull())
    once = F.filter(named, lambda x, k: F.array_position(F.transform(named, lambda y: y["href"]), x["href"]) == k + 1)
    text = N.squeeze(F.array_join(F.transform("items", lambda x: x["text"]), ""))
    blocks = held.select(
        *_key(), F.col("at").alias("pos"), "tag", text.alias("text"), F.transform(_up_to(once, most_links), link).alias("links"), "path"
    ).filter("text <> ''")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    place = (F.row_number().over(Window.partitionBy("page").orderBy("pos")) - 1).alias("pos")
    level = F.when(F.col("tag").isin(*HEADINGS), F.substring("tag", 2, 1).cast("int"))
    shown = F.col("text") if longest is None else F.substring("text", 1, longest).alias("text")
    return with_selectors(_ranked(blocks, most), nodes, "path").select(
        "page_id", place, kinds[F.col("tag")].alias("type"), shown, "links", "selector", level.alias("level")
    )


def _cells(inside: DataFrame) -> DataFrame:
    """(page, page_id, table, tr, pos, th, head, text): cells by their row and table, with their whole text."""
    cell = N.nearest(F.col("own"), ["td", "th"])["pos"]
    parent = F.try_element_at(F.col("own"), F.lit(-2))
    table = N.nearest(F.col("own"), ["table"])["pos"]
    head = F.exists("own", lambda p: (p["tag"] == "thead") & (p["pos"] > F.col("table")))
    cells = inside.filter(F.col("tag").isin("td", "th") & (parent["tag"] == "tr")).withColumn("table", table).filter("table is not null")
    cells = cells.select(*_key(), "table", parent["pos"].alias("tr"), "pos", (F.col("tag") == "th").alias("th"), head.alias("head"))
    return cells.join(_texts(inside, cell, "pos"), ["page", "pos"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def page_tables(
    nodes: DataFrame, most: int | None = MAX_TABLES, most_rows: int | None = MAX_ROWS, most_columns: int | None = MAX_COLUMNS,
    longest: int | None = MAX_CELL,
) -> DataFrame:
    """(page_id, pos, caption, headers, rows, selector): data tables, which hold no other table and have a header or two columns.

    ``most`` of them a page, with ``most_rows`` and ``most_columns`` each and ``longest`` characters a cell; with None all, whole.
    """
    inside = content(nodes)
    tables = inside.filter("tag = 'table'")
    outer = tables.select("page", F.explode(F.filter("own", lambda p: (p["tag"] == "table") & (p["pos"] < F.col("pos")))).alias("p")).select(
        "page", F.col("p.pos").alias("pos")
    )
    inner = tables.join(outer.distinct(), ["page", "pos"], "left_anti").select("page", F.col("pos").alias("table"), "path")
    shown = lambda c: c["text"] if longest is None else F.substring(c["text"], 1, longest)
    row = F.struct("tr", F.col("head"), F.col("all_th"), F.transform(_up_to(F.array_sort("cells"), most_columns), shown).alias("cells"))
    rows = _cells(inside).groupBy(*_key(), "table", "tr").agg(
        F.collect_list(F.struct("pos", "text")).alias("cells"), F.bool_or("head").alias("head"), F.bool_and("th").alias("all_th")
    )
    held = rows.groupBy(*_key(), "table").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    heads = F.filter("rows", lambda r: r["head"])
    first_row = ~F.exists("rows", lambda r: r["head"]) & F.element_at("rows", 1)["all_th"]
    values = F.when(first_row, F.slice("rows", 2, F.size("rows"))).otherwise(F.filter("rows", lambda r: ~r["head"]))
    headers = F.when(first_row, F.element_at("rows", 1)["cells"]).otherwise(
        F.coalesce(F.try_element_at(heads, F.lit(1))["cells"], F.array().cast("array<string>"))
    )
    captions = _texts(inside, N.nearest(F.col("own"), ["caption"])["pos"], "at").join(
        inside.filter("tag = 'caption'").select("page", F.col("pos").alias("at"), N.nearest(F.col("own"), ["table"])["pos"].alias("table")), ["page", "at"]
    ).groupBy("page", "table").agg(F.min_by("text", "at").alias("caption"))
    data = held.join(inner, ["page", "table"]).join(captions, ["page", "table"], "left").select(
        *_key(), F.col("table").alias("pos"), F.coalesce("caption", F.lit("")).alias("caption"), headers.alias("headers"),
        F.transform(_up_to(values, most_rows), lambda r: r["cells"]).alias("rows"), "path",
    )
    data = data.filter((F.size("headers") > 0) | F.exists("rows", lambda r: F.size(r) >= 2))
    return with_selectors(_ranked(data, most), nodes, "path").select("page_id", "pos", "caption", "headers", "rows", "selector")


def page_media(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, url, kind, alt, heading): pictures, clips and files of the content, each with the heading before it."""
    inside = content(nodes)
    heading = N.nearest(F.col("own"), HEADINGS)["pos"]
    headings = _texts(inside, heading, "pos").filter("text <> ''").select("page", "pos", F.col("text").alias("heading"))
    titles = _texts(inside, N.nearest(F.col("own"), ["a"])["pos"], "pos").select("page", "pos", F.col("text").alias("title"))
    kinds = F.create_map(*[F.lit(x) for pair in (("img", "image"), ("video", "video"), ("audio", "audio"), ("source", "source")) for x in pair])
    path = F.regexp_replace(F.coalesce(F.col("attrs")["href"], F.lit("")), r"[?#].*", "")
    kind = F.when((F.col("tag") == "a") & path.rlike(DOWNLOAD), "download").otherwise(kinds[F.col("tag")])
    found = inside.withColumn("kind", kind).filter("kind is not null and url is not null").join(titles, ["page", "pos"], "left")
    given = F.coalesce(F.nullif(F.col("attrs")["alt"], F.lit("")), F.nullif(F.col("attrs")["title"], F.lit("")), F.when(F.col("kind") == "download", F.col("title")))
    rows = found.select(*_key(), "pos", "url", "kind", F.nullif(N.squeeze(given), F.lit("")).alias("alt"))
    both = rows.unionByName(headings, allowMissingColumns=True)
    before = F.last("heading", ignorenulls=True).over(Window.partitionBy("page").orderBy("pos"))
    seen = F.row_number().over(Window.partitionBy("page", "url").orderBy("pos"))
    named = both.withColumn("heading", before).filter("url is not null").withColumn("__seen", seen).filter("__seen = 1")
    return _ranked(named, MAX_MEDIA).select("page_id", "pos", "url", "kind", "alt", "heading")


def page_links(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, url, title): every anchor's address once, whatever its letters, with the text of its first anchor."""
    anchors = nodes.filter("tag = 'a' and url is not null").select(*_key(), "pos", "url")
    seen = F.row_number().over(Window.partitionBy("page", F.lower("url")).orderBy("pos"))
    texts = _texts(nodes, N.nearest(F.col("path"), ["a"])["pos"], "pos")
    first = anchors.withColumn("__seen", seen).filter("__seen = 1").join(texts, ["page", "pos"], "left")
    return first.select("page_id", "pos", "url", F.substring(F.coalesce("text", F.lit("")), 1, MAX_TITLE).alias("title"))


def _linked_data(text: Column) -> tuple[Column, Column]:
    """(date, author) of the first item of a JSON-LD text that has either."""
    data = F.try_parse_json(text)
    items = F.when(F.schema_of_variant(data).startswith("ARRAY"), F.try_variant_get(data, "$", "array<variant>")).otherwise(
        F.concat(F.array(data), F.coalesce(F.try_variant_get(data, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")))
    )
    told = F.transform(items, lambda v: F.struct(
        F.try_variant_get(v, "$.datePublished", "string").alias("date"),
        F.coalesce(F.try_variant_get(v, "$.author.name", "string"), F.try_variant_get(v, "$.author", "string")).alias("author"),
    ))
    first = F.try_element_at(F.filter(told, lambda x: x["date"].isNotNull() | x["author"].isNotNull()), F.lit(1))
    return first["date"], first["author"]


def page_meta(nodes: DataFrame) -> DataFrame:
    """One row a page: page_id, title, lang, published, author, canonical, og_title, og_image, description."""
    attrs, tag = F.col("attrs"), F.col("tag")
    value = F.nullif(N.squeeze(attrs["content"]), F.lit(""))

    def first(what: Column, when: Column) -> Column:
        return F.min_by(what, F.when(when & what.isNotNull(), F.col("pos")))

    def meta(key: str, name: str, what: Column = value) -> Column:
        return first(what, (tag == "meta") & (F.lower(attrs[key]) == name))

    def own_text(name: str, more: Column) -> DataFrame:
        elements = nodes.filter((tag == name) & more if name else more).select("page", "pos")
        place = N.nearest(F.col("path"), [name])["pos"] if name else F.col("parent")
        return elements.join(_texts(nodes, place, "pos"), ["page", "pos"])

    titles = own_text("title", F.lit(True)).groupBy("page").agg(F.min_by("text", "pos").alias("title"))
    by = nodes.filter(attrs["rel"] == "author").groupBy("page").agg(F.min_by(F.struct("pos", "last"), "pos").alias("e")).select("page", "e.*")
    bylines = N.subtree_text(nodes, by).select("page", F.nullif(N.squeeze(F.col("text")), F.lit("")).alias("byline"))
    scripts = nodes.filter((tag == "script") & (attrs["type"] == "application/ld+json")).select("page", "pos", "last")
    date, author = _linked_data(F.col("text"))
    linked = N.subtree_text(nodes, scripts).select("page", "pos", date.alias("ld_date"), author.alias("ld_author"))
    linked = linked.filter("ld_date is not null or ld_author is not null").groupBy("page").agg(
        F.min_by(F.struct("ld_date", "ld_author"), "pos").alias("ld")
    )
    heads = nodes.groupBy(*_key()).agg(
        first(F.nullif(N.squeeze(attrs["lang"]), F.lit("")), tag == "html").alias("lang"),
        F.coalesce(meta("property", "article:published_time"), meta("itemprop", "datepublished"), meta("name", "date"), meta("name", "dc.date")).alias("date"),
        first(F.nullif(N.squeeze(attrs["datetime"]), F.lit("")), tag == "time").alias("time"),
        F.coalesce(meta("name", "author"), meta("property", "article:author")).alias("author"),
        first(F.col("url"), (tag == "link") & (attrs["rel"] == "canonical")).alias("canonical"),
        F.coalesce(meta("property", "og:title"), meta("name", "title")).alias("og_title"),
        meta("property", "og:image", F.col("url")).alias("og_image"),
        F.coalesce(meta("property", "og:description"), meta("name", "description")).alias("description"),
    )
    blank = lambda c: F.nullif(N.squeeze(c), F.lit(""))
    return heads.join(titles, "page", "left").join(bylines, "page", "left").join(linked, "page", "left").select(
        "page_id", "title", "lang", F.coalesce("date", blank(F.col("ld.ld_date")), "time").alias("published"),
        F.coalesce("author", blank(F.col("ld.ld_author")), "byline").alias("author"), "canonical", "og_title", "og_image", "description",
    )


# markdown: marks stand as private characters until white space has been moved out of them

MARKS = {"b": 1, "strong": 1, "i": 2, "em": 2, "code": 3}
_SIGNS = {1: "**", 2: "_", 3: "`"}
MARK = "array<struct<pos: int, open: string, close: string>>"
_OPEN, _CLOSE, _END = (lambda k: chr(0xE000 + k)), (lambda k: chr(0xE010 + k)), chr(0xE015)


def _marked(pieces: Column) -> Column:
    """Pieces (pos, text, marks) to one text: a mark opens before the first piece that has it and closes after the last."""
    none = F.array().cast(MARK)

    def after(marks: Column, others: Column, name: str) -> Column:
        left = F.filter(marks, lambda m: ~F.array_contains(F.transform(others, lambda o: o["pos"]), m["pos"]))
        texts = F.transform(left, lambda m: m[name])
        return F.array_join(F.reverse(texts) if name == "close" else texts, "")

    start = F.struct(F.lit("").alias("out"), none.alias("marks"))
    fold = F.aggregate(
        pieces, start,
        lambda s, x: F.struct(
            F.concat(s["out"], after(s["marks"], x["marks"], "close"), after(x["marks"], s["marks"], "open"), x["text"]).alias("out"),
            x["marks"].alias("marks"),
        ),
        lambda s: F.concat(s["out"], after(s["marks"], none, "close")),
    )
    closing = f"(?:[{_CLOSE(1)}-{_CLOSE(3)}]|{_CLOSE(4)}[^{_END}]*{_END})"
    text = F.regexp_replace(fold, f"([{_OPEN(1)}-{_OPEN(4)}]+)(\\s+)", "$2$1")
    text = F.regexp_replace(text, f"(\\s+)({closing}+)", "$2$1")
    for _ in range(2):
        text = F.regexp_replace(text, f"[{_OPEN(1)}-{_OPEN(4)}]{closing}", "")
    for k, sign in _SIGNS.items():
        text = F.regexp_replace(text, f"[{_OPEN(k)}{_CLOSE(k)}]", sign)
    return F.translate(F.replace(F.replace(text, F.lit(_CLOSE(4)), F.lit("](")), F.lit(_OPEN(4)), F.lit("[")), _END, ")")


def _chain(path: Column) -> Column:
    """The lists, items and quotes that a path passes, outermost first."""
    return F.filter(path, lambda p: p["tag"].isin(*LISTS, "li", QUOTE))


def _runs(inside: DataFrame) -> DataFrame:
    """(page, page_id, pos, text, chain): paragraphs, headings, code and items, each a run of text outside tables."""
    collapsed = F.regexp_replace("text", r"\s+", " ")
    image = F.when(F.col("url").isNotNull(), F.concat(F.lit("!["), N.squeeze(F.coalesce(F.col("attrs")["alt"], F.lit(""))), F.lit("]("), F.col("url"), F.lit(")")))
    pre = N.within(F.col("own"), ["pre"])
    piece = F.when(F.col("tag") == "img", image).when(F.col("tag") == "br", "  \n").when(pre, F.col("text")).otherwise(collapsed)
    anchors = F.coalesce(F.col("hrefs"), F.create_map().cast("map<int,string>"))
    codes = F.create_map(*[x for t, k in MARKS.items() for x in (F.lit(t), F.lit(k))])
    def sign(p: Column) -> Column:
        opened, closed = F.lit(None).cast("string"), F.lit(None).cast("string")
        for k in _SIGNS:
            opened = F.when(codes[p["tag"]] == k, _OPEN(k)).otherwise(opened)
            closed = F.when(codes[p["tag"]] == k, _CLOSE(k)).otherwise(closed)
        link = p["tag"] == "a"
        return F.struct(
            p["pos"].alias("pos"), F.when(link, _OPEN(4)).otherwise(opened).alias("open"),
            F.when(link, F.concat(F.lit(_CLOSE(4)), F.try_element_at(anchors, p["pos"]), F.lit(_END))).otherwise(closed).alias("close"),
        )

    inline = F.filter("own", lambda p: p["tag"].isin(*MARKS) | ((p["tag"] == "a") & F.map_contains_key(anchors, p["pos"])))
    marks = F.when(pre, F.array().cast(MARK)).otherwise(F.transform(inline, sign))
    hrefs = inside.filter("tag = 'a' and url is not null").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("pos", "url"))).alias("hrefs"))
    rows = inside.filter(F.col("tag").isin("#text", "img", "br") & ~N.within(F.col("own"), ["table"])).join(hrefs, "page", "left")
    # told by what a piece is made of: a test of the piece itself would make it twice
    there = F.when(F.col("tag") == "img", F.col("url").isNotNull()).when(F.col("tag") == "br", True).otherwise(F.col("text").isNotNull())
    held = rows.filter(there).select(*_key(), "run", "pos", piece.alias("text"), marks.alias("marks"), "own")
    runs = held.groupBy(*_key(), "run").agg(
        F.min("pos").alias("pos"), F.min_by("own", "pos").alias("own"), F.array_sort(F.collect_list(F.struct("pos", "text", "marks"))).alias("pieces")
    )
    raw = F.array_join(F.transform("pieces", lambda x: x["text"]), "")
    body = F.when(F.exists("pieces", lambda x: F.size(x["marks"]) > 0), _marked(F.col("pieces"))).otherwise(raw)
    heading = N.nearest(F.col("own"), HEADINGS)["tag"]
    code = F.concat(F.lit("```\n"), F.regexp_replace(raw, r"^\n+|\n+$", ""), F.lit("\n```"))
    bare = F.when(pre, "").otherwise(F.regexp_replace(body, r"^\s+|\s+$", ""))

    def text(b: Column) -> Column:
        return F.when(pre, code).when(b == "", None).when(
            heading.isNotNull(), F.concat(F.repeat(F.lit("#"), F.substring(heading, 2, 1).cast("int")), F.lit(" "), N.squeeze(b))
        ).otherwise(b)

    return runs.select(*_key(), "pos", _kept(F.array_compact(F.transform(F.array(bare), text))), _chain(F.col("own")).alias("chain"))


def _table_blocks(inside: DataFrame) -> DataFrame:
    """(page, page_id, pos, text, chain): outermost tables as pipes, ragged rows filled up; nested ones are text of their cells."""
    first = F.try_element_at(F.filter("own", lambda p: p["tag"] == "table"), F.lit(1))["pos"]
    rows = inside.withColumn("table", first).filter("table is not null")
    inner = F.filter("own", lambda p: p["pos"] > F.col("table"))
    own_cell = F.try_element_at(F.filter(inner, lambda p: p["tag"].isin("td", "th")), F.lit(1))["pos"]
    parent = F.try_element_at(F.col("own"), F.lit(-2))
    cells = rows.filter(F.col("tag").isin("td", "th") & (own_cell == F.col("pos")) & (parent["tag"] == "tr"))
    cells = cells.select(*_key(), "table", parent["pos"].alias("tr"), "pos").join(_texts(rows, own_cell, "pos"), ["page", "pos"], "left")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|"))
    lines = cells.groupBy(*_key(), "table", "tr").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))).alias("cells"))
    tables = lines.groupBy(*_key(), "table").agg(F.array_sort(F.collect_list(F.struct("tr", "cells"))).alias("rows"), F.max(F.size("cells")).alias("width"))

    def line(cells: Column) -> Column:
        filled = F.concat(F.transform(cells, lambda c: c["text"]), F.array_repeat(F.lit(""), F.col("width") - F.size(cells)))
        return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    whole = F.transform("rows", lambda r: line(r["cells"]))
    chains = rows.filter((F.col("tag") == "table") & (F.col("pos") == F.col("table"))).select("page", "table", _chain(F.col("own")).alias("chain"))
    return tables.select(*_key(), "table", F.array_join(F.concat(F.slice(whole, 1, 1), F.array(rule), F.slice(whole, 2, F.size(whole))), "\n").alias("text")).join(
        chains, ["page", "table"]
    ).select(*_key(), F.col("table").alias("pos"), "text", "chain")


def page_markdown(nodes: DataFrame) -> DataFrame:
    """One row a page: page_id, markdown. Headings by ``#``, items by ``*   `` or a number, four spaces a level, fenced code.

    A block's lines begin with what its lists and quotes ask for; it stands right below the block before it within a list,
    else an empty line apart. The page's title leads, if the text does not have it as a heading.
    """
    inside = content(nodes).filter(~N.within(F.col("own"), N.SKIPPED))
    rules = inside.filter("tag = 'hr'").select(*_key(), "pos", F.lit("* * *").alias("text"), _chain(F.col("own")).alias("chain"))
    blocks = _runs(inside).unionByName(_table_blocks(inside)).unionByName(rules)
    last = F.coalesce(F.lag("chain").over(Window.partitionBy("page").orderBy("pos")), F.array().cast("array<struct<pos: int, tag: string, nth: int>>"))
    blocks = blocks.withColumn("common", F.array_intersect(F.transform("chain", lambda c: c["pos"]), F.transform(last, lambda c: c["pos"])))
    ordered = lambda c, k: F.when(F.element_at("chain", k)["tag"] == "ol", F.concat(c["nth"].cast("string"), F.lit(".  "))).otherwise("*   ")

    def lead(c: Column, k: Column) -> Column:
        new = ~F.array_contains("common", c["pos"])
        return F.when(c["tag"] == QUOTE, "> ").when(c["tag"] == "li", F.when(new, F.when(k > 0, ordered(c, F.greatest(k, F.lit(1)))).otherwise("*   ")).otherwise("    ")).otherwise("")

    def rest(c: Column) -> Column:
        return F.when(c["tag"] == QUOTE, "> ").when(c["tag"] == "li", "    ").otherwise("")

    shared = F.filter("chain", lambda c: F.array_contains("common", c["pos"]))
    before, others = F.array_join(F.transform(shared, rest), ""), F.array_join(F.transform("chain", rest), "")
    innermost = F.try_element_at(shared, F.lit(-1))["tag"]
    gap = F.when(innermost == QUOTE, F.concat(F.lit("\n"), F.rtrim(before), F.lit("\n"))).when(innermost.isNotNull(), "\n").otherwise("\n\n")
    text = F.concat(gap, F.array_join(F.transform("chain", lead), ""), F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), others)))
    bodies = blocks.select("page", "pos", text.alias("text")).groupBy("page").agg(N.joined_text(F.collect_list(F.struct("pos", "text"))).alias("body"))
    titles = _texts(nodes, N.nearest(F.col("path"), ["title"])["pos"], "pos").groupBy("page").agg(F.min_by("text", "pos").alias("title"))
    pages = nodes.filter("tag = '#page'").select(*_key()).join(bodies, "page", "left").join(titles, "page", "left")
    body, title = F.coalesce("body", F.lit("")), F.concat(F.lit("# "), F.col("title"))
    named = F.when((F.col("title") != "") & ~F.contains(body, title), F.concat(title, F.lit("\n\n"))).otherwise("")
    whole = F.concat(named, F.regexp_replace(body, r"^\s+", ""))
    return pages.select("page_id", F.regexp_replace(F.regexp_replace(whole, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("markdown"))
