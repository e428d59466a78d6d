"""Pages as a node table: one row an element or text, with the interval it spans.

Whether a node lies in another is a comparison of intervals, or a look at its path; selectors are joins of intervals and
strips are running maxima over them. Everything of one page shares one partitioning, by page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import tokenize
from ..storage import materialize

FIELDS = (
    "pos int, last int, parent int, nth int, run int, tag string, attrs map<string,string>, url string, text string, "
    "path array<struct<pos: int, tag: string, nth: int>>"
)
_TYPES = {
    "pos": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "nth": pa.int32(), "run": pa.int32(), "tag": pa.string(),
    "attrs": pa.map_(pa.string(), pa.string()), "url": pa.string(), "text": pa.string(),
    "path": pa.list_(pa.struct([("pos", pa.int32()), ("tag", pa.string()), ("nth", pa.int32())])),
}
#: Nodes that a batch of rows holds at most, beyond one page's.
BATCH_NODES = 8192
#: Elements whose content is no reading matter.
SKIPPED = ("script", "style", "noscript", "template", "svg", "nav", "footer", "header", "aside", "form", "button", "input", "select", "textarea", "iframe")

# What is stripped before a page is read, each a selector.
PROMO = (".banner", ".banner-content", '[class*="promo-banner"]', '[class*="site-banner"]', '[id*="site-banner"]')
CHROME = (
    "nav", "footer", '[role="navigation"]', '[role="contentinfo"]', "aside", ".sidebar", ".site-footer", ".site-header",
    ".page-footer", ".page-header", ".global-header", ".global-footer", "#onetrust-consent-sdk", "#onetrust-banner-sdk",
    "#CybotCookiebotDialog", ".qc-cmp2-container", ".fc-consent-root", '[class*="cookie-banner"]', '[class*="cookie-consent"]',
    '[id*="cookie-notice"]',
)
CONSENT = (
    "#onetrust-consent-sdk", "#onetrust-banner-sdk", "#CybotCookiebotDialog", ".qc-cmp2-container", "#didomi-host",
    ".fc-consent-root", ".sp_message_container", '[class*="cookie-banner"]', '[class*="cookie-consent"]', '[id*="cookie-notice"]',
    '[class*="consent-banner"]',
)


def _columns(rows: list[list]) -> list[pa.Array]:
    """The rows of a tokenizer as columns; maps and paths are made of flat ones."""
    columns = [list(c) for c in zip(*rows, strict=True)]
    attrs, paths = columns[6], columns[9]
    pairs = [x for a in attrs if a for x in a.items()]
    ends, steps = list(accumulate((len(a or ()) for a in attrs), initial=0)), [s for path in paths for s in path]
    known = pa.array([None if a is None else n for a, n in zip([*attrs, {}], ends, strict=True)], pa.int32())
    keys, values = (pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1))
    fields = [pa.array([s[k] for s in steps], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32()))]
    path = pa.StructArray.from_arrays(fields, fields=list(_TYPES["path"].value_type))
    offsets = pa.array(accumulate(map(len, paths), initial=0), pa.int32())
    made = {6: pa.MapArray.from_arrays(known, keys, values), 9: pa.ListArray.from_arrays(offsets, path)}
    return [made[k] if k in made else pa.array(c, t) for k, (c, t) in enumerate(zip(columns, _TYPES.values(), strict=True))]


def page_nodes(df: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", marks: dict[str, Column] | None = None) -> DataFrame:
    """The materialised node table of ``df``: page (a number of the row), page_id, and a row for each element and text.

    Each page has a row of its own too, of the tag ``#page``, with its address and ``marks``, text of the row, as attributes;
    a null or empty page has that one only. Repeated rows are pages of their own.
    """
    kind = df.schema[key].dataType.simpleString()
    given = F.create_map(*[x for k, c in (marks or {}).items() for x in (F.lit(k), c.cast("string"))]) if marks else F.lit(None)
    source = df.select(
        F.monotonically_increasing_id().alias("page"), F.col(key).alias("page_id"), F.col(html).alias("html"), F.col(url).alias("url"),
        given.cast("map<string,string>").alias("marks"),
    )

    # a table of few splits would be tokenized, and its nodes read again, by few tasks; one of many is left as it lies
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if source.rdd.getNumPartitions() < tasks:
        source = source.repartition(tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, at = batch.column(1), [], []

            def out() -> pa.RecordBatch:
                numbers = pa.array([k for k, n in at for _ in range(n)])  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(numbers), ids.take(numbers), *_columns(rows)], names=["page", "page_id", *_TYPES])  # noqa: B023

            for k in range(batch.num_rows):
                base, marks = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
                found = tokenize(batch.column(2)[k].as_py(), base)
                rows.append([-1, len(found) - 1, -2, 1, 0, "#page", dict(marks or ()), base, None, []])
                rows += found
                at.append((k, len(found) + 1))
                if len(rows) >= BATCH_NODES:
                    yield out()
                    rows, at = [], []
            if rows:
                yield out()

    return materialize(source.mapInArrow(read, f"page bigint, page_id {kind}, {FIELDS}"), "nodes")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def classes(attrs: Column) -> Column:
    return F.split(F.trim(F.coalesce(attrs["class"], F.lit(""))), r"\s+")


# selectors

_STEP = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*))\s*)?\]""")


def parse_selector(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives of steps (combinator, tests): tags, ids, classes and attributes under descendant and child steps."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        steps, combinator, rest = [], " ", alternative.strip()
        while rest:
            tests = []
            while m := _STEP.match(rest):
                tag, name, cls, attr, op, *values = m.groups()
                tests.append(("tag", tag) if tag else ("id", name) if name else ("class", cls) if cls else ("attr", attr, op, next((v for v in values if v is not None), "")))
                rest = rest[m.end() :]
            if not tests:
                raise ValueError(f"selector not understood: {selector!r}")
            steps.append((combinator, tests))
            if rest:
                m = re.match(r"\s*(>)\s*|\s+", rest)
                if not m:
                    raise ValueError(f"selector not understood: {selector!r}")
                combinator, rest = m[1] or " ", rest[m.end() :]
        if not steps:
            raise ValueError(f"selector not understood: {selector!r}")
        out.append(steps)
    return out


def _test(kind: str, name: str, op: str | None = None, value: str = "") -> Column:
    attrs = F.col("attrs")
    if kind == "tag":
        return F.lit(True) if name == "*" else F.col("tag") == name.lower()
    if kind == "id":
        return attrs["id"] == name
    if kind == "class":
        return F.array_contains(classes(attrs), name)
    held = attrs[name.lower()]
    if op is None:
        return held.isNotNull()
    if op == "~=":
        return F.array_contains(F.split(held, r"\s+"), value)
    given = {"=": held == value, "*=": held.contains(value), "^=": held.startswith(value), "$=": held.endswith(value)}
    return given[op] & F.lit(value != "" or op == "=")


def matches(tests: list[tuple]) -> Column:
    """Whether a row is an element that passes the tests of one step."""
    out = ~F.col("tag").startswith("#")
    for test in tests:
        out &= F.coalesce(_test(*test), F.lit(False))
    return out


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """(page, pos, last) of the elements that ``selector`` matches. Each further step is a join of intervals within the page."""
    found: DataFrame | None = None
    for steps in parse_selector(selector):
        own: DataFrame | None = None
        for combinator, tests in steps:
            here = nodes.filter(matches(tests)).select("page", "pos", "last", "parent")
            if own is not None:
                above = own.select(F.col("page").alias("p"), F.col("pos").alias("first"), F.col("last").alias("end"))
                within = (F.col("parent") == F.col("first")) if combinator == ">" else F.col("pos").between(F.col("first") + 1, F.col("end"))
                here = here.join(above, (F.col("page") == F.col("p")) & within, "left_semi")
            own = here
        own = own.select("page", "pos", "last")
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def _in_order() -> Window:
    return Window.partitionBy("page").orderBy("pos")


def strip(nodes: DataFrame, selectors: Sequence[str], also: Column | None = None) -> DataFrame:
    """``nodes`` without the elements that any of ``selectors`` matches, or for which ``also`` holds, and without what they hold.

    A node goes if an element that goes, before it or itself, spans its place: a running maximum in the order of the page.
    """
    one_step, joined = F.lit(False) if also is None else F.coalesce(also, F.lit(False)), []
    for selector in selectors:
        for steps in parse_selector(selector):
            if len(steps) == 1:
                one_step |= matches(steps[0][1])
            else:
                joined.append(steps)
    gone = one_step
    if joined:
        longer = select_nodes(nodes, ", ".join(s for s in selectors if any(len(x) > 1 for x in parse_selector(s))))
        nodes = nodes.join(longer.select("page", "pos", F.lit(True).alias("__hit")), ["page", "pos"], "left")
        gone |= F.coalesce(F.col("__hit"), F.lit(False))
    spanned = F.max(F.when(gone, F.col("last"))).over(_in_order())
    kept = nodes.withColumn("__end", spanned).filter(F.coalesce(F.col("__end") < F.col("pos"), F.lit(True)))
    return kept.drop("__end", "__hit")


def within(path: Column, tags: Sequence[str]) -> Column:
    """Whether a path passes an element of ``tags``."""
    return F.exists(path, lambda p: p["tag"].isin(*tags))


def nearest(path: Column, tags: Sequence[str]) -> Column:
    """The innermost element of ``tags`` on a path, or null."""
    return F.try_element_at(F.filter(path, lambda p: p["tag"].isin(*tags)), F.lit(-1))


def joined_text(pieces: Column) -> Column:
    """The texts of an array of (pos, text), in order."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["text"]), "")


def subtree_text(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``roots`` (page, pos, last, ...) with the whole ``text`` each spans, in order; roots may lie in one another."""
    texts = nodes.filter("tag = '#text'").select(F.col("page").alias("p"), F.col("pos").alias("at"), F.col("text").alias("piece"))
    held = roots.join(texts, (F.col("page") == F.col("p")) & F.col("at").between(F.col("pos"), F.col("last")), "left")
    pieces = F.collect_list(F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("pos"), F.col("piece").alias("text"))))
    return held.groupBy(*roots.columns).agg(joined_text(pieces).alias("text"))


# the skeleton of a page

SKELETON_NODES, SKELETON_DEPTH, SKELETON_MAINS = 400, 12, 8
_BARE = ("script", "style", "noscript", "svg", "path", "link", "meta")
_INTERACTIVE = ("a", "button", "input", "select", "textarea", "summary")


def _short(text: Column, most: int = 80) -> Column:
    bare = F.nullif(squeeze(text), F.lit(""))
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("…"))).otherwise(bare)


def skeleton(nodes: DataFrame, most: int | None = SKELETON_NODES, deepest: int = SKELETON_DEPTH) -> DataFrame:
    """(page_id, pos, parent, depth, tag, id, classes, role, test_id, aria, text, interactive, main_score): bounded trees.

    The elements of each page's body in order, down to ``deepest`` levels, ``most`` of them, or all with None: as whatever is cut by depth or tag is a
    whole interval, the first ones in order are always a tree. ``text`` is that of an element with one text and nothing else;
    ``main_score`` says how likely an element holds the page's matter.
    """
    body = nodes.filter("tag = 'body'").groupBy("page").agg(F.min_by(F.struct("pos", "last", F.size("path").alias("at")), "pos").alias("body"))
    held = nodes.join(body, "page").filter((F.col("pos") >= F.col("body.pos")) & (F.col("pos") <= F.col("body.last")))
    attrs, depth = F.col("attrs"), F.size("path") - F.col("body.at")
    elements = held.filter((F.col("tag") != "#text") & (depth <= deepest) & ~within(F.col("path"), _BARE))
    first = elements if most is None else elements.withColumn("n", F.row_number().over(_in_order())).filter(F.col("n") <= most)
    texts = held.filter("tag = '#text'").select("page", F.explode(F.transform("path", lambda p: p["pos"])).alias("pos"), F.col("pos").alias("at"), "parent", "text")
    whole = texts.groupBy("page", "pos").agg(
        joined_text(F.collect_list(F.struct(F.col("at").alias("pos"), "text"))).alias("whole"), F.sum((F.col("parent") == F.col("pos")).cast("int")).alias("own")
    )
    marks = nodes.filter(F.col("tag").isin("article", "h1", "h2")).select("page", F.explode(F.transform("path", lambda p: p["pos"])).alias("pos"), F.col("pos").alias("mark"))
    marked = marks.filter("mark > pos").select("page", "pos", F.lit(True).alias("marked")).distinct()
    both = first.join(whole, ["page", "pos"], "left").join(marked, ["page", "pos"], "left")
    alone = (F.col("own") == 1) & (F.col("last") == F.col("pos") + 1)
    score = (
        F.when((F.col("tag") == "main") | F.coalesce(attrs["role"] == "main", F.lit(False)), 40).otherwise(0)
        + F.when(F.coalesce(attrs["id"].rlike("(?i)content|main|readme|article"), F.lit(False)), 20).otherwise(0)
        + F.when(F.coalesce(F.length(squeeze(F.col("whole"))) > 120, F.lit(False)), 25).otherwise(0) + F.when(F.col("marked"), 15).otherwise(0)
    )
    acts = F.col("tag").isin(*_INTERACTIVE) | F.coalesce(attrs["role"] == "button", F.lit(False)) | attrs["onclick"].isNotNull() | attrs["tabindex"].isNotNull()
    given = F.filter(classes(attrs), lambda c: c != "")
    return both.select(
        "page_id", "pos", F.when(F.col("pos") > F.col("body.pos"), F.col("parent")).alias("parent"), depth.alias("depth"), "tag",
        F.nullif(attrs["id"], F.lit("")).alias("id"), F.slice(given, 1, 3).alias("classes"), F.nullif(attrs["role"], F.lit("")).alias("role"),
        F.nullif(attrs["data-testid"], F.lit("")).alias("test_id"), _short(attrs["aria-label"]).alias("aria"), F.when(alone, _short(F.col("whole"))).alias("text"),
        acts.alias("interactive"), (score / 100).alias("main_score"),
    )


def main_candidates(tree: DataFrame, most: int = SKELETON_MAINS) -> DataFrame:
    """(page_id, selector, score): of each skeleton the elements that most likely hold the page's matter, best first."""
    hint = (
        F.when(F.col("id").isNotNull(), F.concat(F.lit("#"), "id"))
        .when(F.col("test_id").isNotNull(), F.concat(F.lit('[data-testid="'), "test_id", F.lit('"]')))
        .when(F.size("classes") > 0, F.concat("tag", F.lit("."), F.array_join("classes", "."))).otherwise(F.col("tag"))
    )
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("main_score"), "pos"))
    return tree.filter("main_score >= 0.45").withColumn("n", place).filter(F.col("n") <= most).select("page_id", hint.alias("selector"), F.col("main_score").alias("score"))
