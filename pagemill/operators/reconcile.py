"""Blocks against the text that was made of a page: which survive, where they stand, which bear on a question, what they cost.

Everything is a projection of one row; a page carries its blocks as an array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .rank import block_scores, clears_floor, focus_match

# Forms that results depend on.
LINKED = r"\[([^\]]+)\]\([^)]*\)"
EMPHASIS = r"(\*{1,3}|_{1,3}|`+)([^*_`]+)\1"
WHITE = r"[\x09-\x0D\x85\p{Z}]+"
#: Fewest characters of a line that shows a block has survived in part.
LEAST_LINE = 8
#: Shortest anchor, and most links that are taken for it.
ANCHOR, PRIMARY = 3, 48


def reflow_form(text: Column) -> Column:
    """Text as it is looked for: links and emphasis unwrapped, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), LINKED, "$1"), EMPHASIS, "$2")
    return F.trim(F.regexp_replace(plain, WHITE, " "))


def surviving_blocks(blocks: Column, compiled: Column, original: Column) -> Column:
    """(pos, text) of the blocks that a page's compiled text still holds.

    A block survives whole, or, if it has lines, as those of its lines that are still there, half of them at least. An unchanged
    text keeps every block; blank blocks do not survive a changed one.
    """
    hay = reflow_form(compiled)

    def lines_left(x, haystack):
        lines = F.filter(F.transform(F.split(F.replace(x, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x)), lambda s: s != "")
        needle = F.transform(lines, lambda s: F.struct(s.alias("s"), reflow_form(s).alias("n")))
        left = F.filter(needle, lambda z: (F.length(z["n"]) >= LEAST_LINE) & haystack.contains(z["n"]))
        enough = (F.size(F.split(x, "\n")) > 1) & (F.size(left) > 0) & (F.size(left) * 2 >= F.size(lines))
        return F.when(enough, F.array_join(F.transform(left, lambda z: z["s"]), "\n"))

    def judge(haystack):
        def one(x, i):
            needle = reflow_form(x)
            text = F.when((needle != "") & haystack.contains(needle), x).when(needle != "", lines_left(x, haystack))
            return F.struct(i.alias("pos"), text.alias("text"))

        return F.filter(F.transform(blocks, one), lambda s: s["text"].isNotNull())

    same = F.transform(blocks, lambda x, i: F.struct(i.alias("pos"), x.alias("text")))
    return F.when(compiled == original, same).otherwise(F.element_at(F.transform(F.array(hay), judge), 1))


def surface_spans(blocks: Column, surface: Column) -> Column:
    """(start, end) of each block in a text, or null: searched behind the one before, else from the start; from 0."""
    span = "struct<start: int, end: int>"

    def step(acc, x):
        ahead = _find(surface, x, acc["at"])
        found = F.when(ahead > 0, ahead).otherwise(_find(surface, x, F.lit(0)))
        hit = (F.coalesce(x, F.lit("")) != "") & (found > 0)
        made = F.when(hit, F.struct((found - 1).alias("start"), (found - 1 + F.length(x)).alias("end"))).otherwise(F.lit(None).cast(span))
        return F.struct(
            F.when(hit, found - 1 + F.length(x)).otherwise(acc["at"]).alias("at"), F.concat(acc["spans"], F.array(made)).alias("spans")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
    return F.aggregate(blocks, start, step, lambda acc: acc["spans"])


def _find(text: Column, needle: Column, after: Column) -> Column:
    """Place from 1 of ``needle`` behind the first ``after`` characters; 0 if there is none."""
    return F.call_function("locate", needle, text, after + 1)


def focus_relevant(blocks: Column, terms: list[str], focus: str) -> Column:
    """(score, relevant) of each block: it clears the floor of the claim's terms, or matches the focus by itself."""
    scores = block_scores(blocks, terms)
    return F.zip_with(
        blocks, scores,
        lambda x, s: F.struct(s["score"].alias("score"), (clears_floor(s["matched"], len(terms)) | focus_match(x, focus)["matched"]).alias("relevant")),
    )


def focus_order(judged: Column) -> Column:
    """Positions of the blocks: relevant ones first, the better score first, then order. Nothing is dropped."""
    ranked = F.array_sort(
        F.transform(judged, lambda s, i: F.struct((~s["relevant"]).alias("off"), (-F.round(s["score"], 9)).alias("minus"), i.alias("pos")))
    )
    return F.transform(ranked, lambda s: s["pos"])


def keepers(kept: Column, judged: Column) -> Column:
    """``kept`` positions, or none if no kept block is relevant while another is."""
    relevant = F.filter(F.transform(judged, lambda s, i: F.when(s["relevant"], i)), lambda i: i.isNotNull())
    return F.when((F.size(relevant) > 0) & ~F.arrays_overlap(kept, relevant), F.array().cast("array<int>")).otherwise(kept)


def _cost(*parts: Column) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + T.token_estimate(p)
    return F.greatest(F.lit(1), total)


def _sum(items: Column) -> Column:
    return F.aggregate(F.transform(items, T.token_estimate), F.lit(0), lambda a, x: a + x)


def block_cost(text: Column, selector: Column, kind: Column) -> Column:
    """Estimated tokens of a block beside the text; one at least, as of all sidecars."""
    return _cost(text, selector, kind)


def table_cost(caption: Column, selector: Column, headers: Column, rows: Column) -> Column:
    cells = F.flatten(rows)
    return F.greatest(F.lit(1), T.token_estimate(caption) + T.token_estimate(selector) + _sum(headers) + _sum(cells))


def chunk_cost(text: Column, headers: Column) -> Column:
    return F.greatest(F.lit(1), T.token_estimate(text) + _sum(headers))


def media_cost(*parts: Column) -> Column:
    """Of address, kind, alternative text, heading and selector."""
    return _cost(*parts)


def primary_hit(path: Column, title: Column, anchors: list[str]) -> Column:
    """Whether a link's path or title names one of ``anchors`` (lower case, of three characters or more)."""
    use = sorted({a for a in anchors if len(a) >= ANCHOR})
    if not use:
        return F.lit(False)
    return T.contains_any(F.lower(path), use) | F.coalesce(T.contains_any(F.lower(title), use), F.lit(False))


def digest_entries(text: Column) -> Column:
    """(url, focus_query) of a digest's input, a JSON array of addresses and objects or a delimited list.

    Each address once, whatever its case; null if one is no http address, if nothing is left, or if the JSON is no array.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    listed = F.from_json(bare, "array<string>")
    none = F.lit(None).cast("string")
    of_json = F.transform(
        listed,
        lambda x: F.when(
            x.startswith("{"), F.struct(F.get_json_object(x, "$.url").alias("url"), F.get_json_object(x, "$.focus_query").alias("focus_query"))
        ).otherwise(F.struct(x.alias("url"), none.alias("focus_query"))),
    )
    of_list = F.transform(F.split(bare, r"[\n\r,;]"), lambda x: F.struct(x.alias("url"), none.alias("focus_query")))
    raw = F.filter(F.when(bare.startswith("["), of_json).otherwise(of_list), lambda e: F.trim(F.coalesce(e["url"], F.lit(""))) != "")
    entries = F.transform(
        raw,
        lambda e: F.struct(
            _absolute(F.trim(e["url"])).alias("url"), F.nullif(F.trim(e["focus_query"]), F.lit("")).alias("focus_query")
        ),
    )
    once = F.aggregate(
        entries, F.array().cast("array<struct<url: string, focus_query: string>>"),
        lambda acc, e: F.when(F.exists(acc, lambda a: F.lower(a["url"]) == F.lower(e["url"])), acc).otherwise(F.concat(acc, F.array(e))),
    )
    return F.when((F.size(entries) > 0) & ~F.exists(entries, lambda e: e["url"].isNull()), once)


def _absolute(url: Column) -> Column:
    """An http address with scheme and host in lower case and a path; null for anything else."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#\s]+)", 1))
    tail = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#\s]+(.*)$", 1)
    path = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(head.rlike("^https?://"), F.concat(head, path))
