"""The reading matter of a page: scored by text density over the node table, else picked by element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import BLOCKS, HEADINGS
from ..storage import materialize
from . import nodes as N
from .access import SPA_MARKERS

# Elements that hold a page's own text, in order of preference, and how much text makes them do.
PICKS = (
    "article", '[role="main"]', "main", ".docs-content", ".docs-post-content", ".markdown-body", "#main-content", "#content",
    "div.section", "div.sect1", "#docs", ".article-body", ".post-content",
)
PICK_TEXT, PICK_LINKED_TEXT, PICK_LINKS = 200, 120, 4
STUB_TEXT = 500

#: Least text of a paragraph that counts, and ancestors it counts for.
PARAGRAPH_TEXT, ANCESTORS = 25, 5
#: Elements that may hold an article; what stands in others counts for the next of these outside them.
HOLDERS = tuple(sorted(BLOCKS - {"p", "pre", "blockquote", "dd", "dt", "li", "head", "title", "html", "hr", *HEADINGS})) + ("tbody", "tr", "td")
#: Words in a class or id that speak for or against an element.
FOR, AGAINST = "article|body|content|entry|main|post|story|text", r"\bads?\b|advert|comment|footer|footnote|masthead|promo|related|share|sidebar|sponsor|widget"
WEIGHT = 25.0


def _sum_to(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def _trimmed(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))


def _may_match(steps: list[list[tuple]]) -> Column:
    """Whether a row has what any of ``steps`` needs, an attribute or a tag: few rows do, so few are matched in full."""
    names = {"class" if t[0] == "class" else "id" if t[0] == "id" else t[1].lower() for tests in steps for t in tests if t[0] != "tag"}
    bare = [tests for tests in steps if all(t[0] == "tag" for t in tests)]
    out = F.lit(False)
    for tests in bare:
        out |= N.matches(tests)
    for name in sorted(names):
        out |= F.col("attrs")[name].isNotNull()
    return F.coalesce(out, F.lit(False))


def picked(nodes: DataFrame, selectors: Sequence[str] = PICKS) -> DataFrame:
    """(page, pos, last): of each page the first element of the first of ``selectors`` with enough text or links."""
    own: DataFrame | None = None
    simple = [N.parse_selector(x) for x in selectors]
    if all(len(steps) == 1 for x in simple for steps in x):  # no step to join: one look at each row
        ranks = F.array_compact(F.array(*[F.when(F.greatest(*[N.matches(s[0][1]) for s in x], F.lit(False)), k) for k, x in enumerate(simple)]))
        own = nodes.filter(_may_match([s[0][1] for x in simple for s in x])).select("page", "pos", "last", F.explode(ranks).alias("rank"))
    else:
        for rank, selector in enumerate(selectors):
            found = N.select_nodes(nodes, selector).withColumn("rank", F.lit(rank))
            own = found if own is None else own.unionByName(found)
    first = own.groupBy("page", "rank").agg(F.min_by(F.struct("pos", "last"), "pos").alias("e")).select("page", "e.pos", "e.last", "rank")
    held = N.subtree_text(nodes, first)
    marks = nodes.filter(F.col("tag").isin("h2", "h3", "a")).select(F.col("page").alias("p"), F.col("pos").alias("at"))
    counted = held.join(marks, (F.col("page") == F.col("p")) & F.col("at").between(F.col("pos") + 1, F.col("last")), "left")
    counted = counted.groupBy("page", "pos", "last", "rank", _trimmed(F.col("text")).alias("chars")).agg(F.count("at").alias("marks"))
    good = (F.col("chars") > PICK_TEXT) | ((F.col("chars") > PICK_LINKED_TEXT) & (F.col("marks") >= PICK_LINKS))
    best = counted.filter(good).groupBy("page").agg(F.min_by(F.struct("pos", "last"), "rank").alias("e"))
    return best.select("page", "e.pos", "e.last")


def paragraphs(nodes: DataFrame) -> DataFrame:
    """(page, page_id, run, pos, text, linked, path): the runs of text outside chrome; linked: characters within anchors."""
    text = nodes.filter((F.col("tag") == "#text") & ~N.within(F.col("path"), (*N.SKIPPED, "head")))
    linked = F.when(N.within(F.col("path"), ("a",)), F.length(N.squeeze(F.col("text")))).otherwise(0)
    return (
        text.groupBy("page", "page_id", "run").agg(
            F.min("pos").alias("pos"), F.min_by("path", "pos").alias("path"), F.sum(linked).alias("linked"),
            N.squeeze(N.joined_text(F.collect_list(F.struct("pos", "text")))).alias("text"),
        )
        .filter("text <> ''")
    )


def scored(nodes: DataFrame) -> DataFrame:
    """(page, pos, last, parent, tag, score): elements that hold paragraphs, by text density.

    A paragraph of n characters and k commas counts 1 + k + min(3, n / 100) for its parent, half of it for the next element
    and a third of a level's share for those further out. What share of an element's text is linked takes as much of its
    score away.
    """
    runs = paragraphs(nodes)
    # what an article may stand in, innermost first: elements that are not paragraphs themselves
    above = F.reverse(F.filter("path", lambda p: p["tag"].isin(*HOLDERS)))
    value = 1 + F.length("text") - F.length(F.replace(F.col("text"), F.lit(","), F.lit(""))) + F.least(F.lit(3.0), F.floor(F.length("text") / 100))
    spread = runs.select(
        "page", F.length("text").alias("chars"), "linked", F.when(F.length("text") >= PARAGRAPH_TEXT, value).otherwise(0.0).alias("value"),
        F.posexplode(above).alias("level", "e"),
    )
    share = F.when(F.col("level") == 0, 1.0).when(F.col("level") == 1, 0.5).otherwise(1.0 / (3.0 * F.greatest(F.col("level"), F.lit(1))))
    sums = spread.groupBy("page", F.col("e.pos").alias("pos")).agg(
        _sum_to(F.when(F.col("level") < ANCESTORS, F.col("value") * share)).alias("raw"),
        (F.sum("linked") / F.sum("chars")).alias("density"), F.sum("chars").alias("chars"),
    )
    names = F.lower(F.concat_ws(" ", F.col("attrs")["class"], F.col("attrs")["id"]))
    weight = F.when(names.rlike(FOR), WEIGHT).otherwise(0.0) - F.when(names.rlike(AGAINST), WEIGHT).otherwise(0.0)
    held = sums.filter("raw > 0").join(nodes.select("page", "pos", "last", "parent", "tag", weight.alias("weight")), ["page", "pos"])
    return held.select("page", "pos", "last", "parent", "tag", "chars", ((F.col("raw") + F.col("weight")) * (1 - F.col("density"))).alias("score"))


def likely(nodes: DataFrame) -> DataFrame:
    """``nodes`` without promotion, consent and elements whose names speak against them only; a page's own frame stays."""
    names = F.lower(F.concat_ws(" ", F.col("attrs")["class"], F.col("attrs")["id"]))
    unlikely = ~F.col("tag").isin("#page", "#text", "html", "body", "article", "main") & names.rlike(AGAINST) & ~names.rlike(FOR)
    return N.strip(nodes, (*N.PROMO, *N.CONSENT), unlikely)


def article_roots(nodes: DataFrame) -> DataFrame:
    """(page, pos, last, method): the elements that make up each page's article, in likely ``nodes``.

    The best scored element, and those of its siblings that come near it; where no element has a positive score, the
    element picked by name; where none is, the body, or the page without one.
    """
    all_scored = materialize(scored(nodes).filter("score > 0"), "scores")
    by_score = Window.partitionBy("page").orderBy(F.desc("score"), F.desc("pos"))  # of equals the inner one
    ranked = all_scored.withColumn("rank", F.row_number().over(by_score))
    best = F.struct("pos", "parent", "score")
    ranked = ranked.withColumn("best", F.max(F.when(F.col("rank") == 1, best)).over(Window.partitionBy("page")))
    beside = (F.col("parent") == F.col("best.parent")) & (F.col("score") >= F.greatest(F.lit(10.0), 0.2 * F.col("best.score")))
    kept = ranked.filter((F.col("rank") == 1) | beside).select("page", "pos", "last", F.lit("density").alias("method"))
    rest = nodes.join(all_scored.select("page").distinct(), "page", "left_anti")
    by_name = picked(rest).withColumn("method", F.lit("pick"))
    bare = rest.filter(F.col("tag").isin("body", "#page")).join(by_name.select("page"), "page", "left_anti")
    body = bare.groupBy("page").agg(F.max_by(F.struct("pos", "last"), F.struct(F.col("tag") == "body", -F.col("pos"))).alias("e"))
    return kept.unionByName(by_name).unionByName(body.select("page", "e.pos", "e.last", F.lit("body").alias("method")))


def article_text(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row a page: page_id, ok, method, title, text, failure, spa_stub.

    ``text`` has the article's paragraphs, parted by empty lines. A page without text is an ``extraction_failed``; it is a
    stub if it has little text and a mount point for scripts. Null and empty pages fail. Repeated rows give a row each.
    """
    low, marked = F.lower(F.coalesce(F.col(html), F.lit(""))), F.lit(False)
    for marker in SPA_MARKERS:
        marked |= low.contains(marker)
    nodes = N.page_nodes(df, html=html, url=url, marks={"mount": marked})
    clean = materialize(likely(nodes), "likely")
    roots = materialize(article_roots(clean), "roots")
    inside = roots.select(F.col("page").alias("p"), F.col("pos").alias("root"), "last", "method")
    runs = paragraphs(clean).join(inside, (F.col("page") == F.col("p")) & F.col("pos").between(F.col("root"), F.col("last")), "left_semi")
    texts = runs.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    titles = nodes.filter(N.within(F.col("path"), ("title",)) & (F.col("tag") == "#text")).groupBy("page").agg(
        F.nullif(N.squeeze(F.min_by("text", "pos")), F.lit("")).alias("title")
    )
    found = roots.groupBy("page").agg(F.min("method").alias("method")).join(texts, "page").join(titles, "page", "left")
    body = nodes.filter((F.col("tag") == "#text") & ~N.within(F.col("path"), ("head",))).groupBy("page").agg(
        F.length(N.squeeze(N.joined_text(F.collect_list(F.struct("pos", "text"))))).alias("body")
    )
    pages = nodes.filter("tag = '#page'").select("page", "page_id", (F.col("attrs")["mount"] == "true").alias("mount"))
    ok = F.col("text").isNotNull()
    return pages.join(found, "page", "left").join(body, "page", "left").select(
        "page_id", ok.alias("ok"), "method", F.when(ok, F.col("title")).alias("title"), "text",
        F.when(~ok, "extraction_failed").alias("failure"), (~ok & (F.coalesce("body", F.lit(0)) < STUB_TEXT) & F.col("mount")).alias("spa_stub"),
    )
