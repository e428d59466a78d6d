"""Forms in which a page's blocks and tables are handed on, each with the reader that takes it apart again."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pages as P

BLOCK = "struct<type: string, level: int, text: string>"
TABLE = "struct<caption: string, headers: array<string>, rows: array<array<string>>>"
VIEW = f"struct<blocks: array<{BLOCK}>, tables: array<{TABLE}>>"

# What is said of a form that is asked for and not to be had.
UNSUPPORTED, CANNOT_ENCODE = "unsupported_codec", "codec_cannot_encode"


class Codec(NamedTuple):
    """``encode`` takes (text, blocks, tables); ``decode`` a surface, to (blocks, tables) or null."""

    encode: Callable[[Column, Column, Column], Column] | None
    decode: Callable[[Column], Column] | None


def _compact_block(b: Column) -> Column:
    text = F.trim(b["text"])
    level = F.least(F.greatest(F.coalesce(b["level"], F.lit(2)), F.lit(1)), F.lit(6))
    return (
        F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(b["type"] == "list_item", F.concat(F.lit("- "), text)).when(b["type"] == "quote", F.concat(F.lit("> "), text))
        .when(b["type"] == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(text)
    )


def _compact_table(t: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    caption = F.when(F.trim(t["caption"]) != "", F.concat(F.lit("**"), F.trim(t["caption"]), F.lit("**\n"))).otherwise("")
    headers = F.when(F.size(t["headers"]) > 0, t["headers"]).otherwise(F.try_element_at(t["rows"], F.lit(1)))
    rule = line(F.transform(headers, lambda _: F.lit("---")))
    lines = F.concat(F.array(line(headers), rule), F.transform(t["rows"], line))
    return F.when(headers.isNull(), F.rtrim(caption, F.lit("\n"))).otherwise(F.concat(caption, F.array_join(lines, "\n")))


def encode_compact(text: Column, blocks: Column, tables: Column) -> Column:
    """Blocks a line apart, headings by their level, then tables; the text itself where there are none."""
    full = F.filter(blocks, lambda b: F.trim(b["text"]) != "")
    parts = F.filter(F.concat(F.transform(full, _compact_block), F.transform(tables, _compact_table)), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))).otherwise(text)


def decode_compact(surface: Column) -> Column:
    """The blocks and tables of a compact form. A paragraph that looks like another kind of block is read as that kind."""
    none = F.lit(None).cast("int")
    # code may hold empty lines: only those outside of fences part blocks
    parts = F.regexp_extract_all(F.regexp_replace(surface, "\n$", ""), F.lit("(?s)(```\n.*?\n```(?=\n\n|$)|[^\n](?:(?!\n\n).)*)"), 1)

    def block(kind: str, text: Column, level: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("type"), level.alias("level"), text.alias("text"))

    def read(p: Column) -> Column:
        marks = F.length(F.regexp_extract(p, "^(#{1,6}) ", 1))
        return (
            F.when(p.rlike("(?s)^```\n.*\n```$"), block("code", F.substring(p, F.lit(5), F.length(p) - 8)))
            .when(marks > 0, block("heading", F.regexp_replace(p, "^#{1,6} ", ""), marks))
            .when(p.startswith("- "), block("list_item", F.regexp_replace(p, "^- ", "")))
            .when(p.startswith("> "), block("quote", F.regexp_replace(p, "^> ", ""))).otherwise(block("paragraph", p))
        )

    def cells(line: Column) -> Column:
        return F.split(F.substring(line, F.lit(3), F.length(line) - 4), r" \| ", -1)

    def table(p: Column) -> Column:
        lines = F.split(p, "\n")
        named = lines[0].startswith("**")
        rest = F.when(named, F.slice(lines, 2, F.size(lines))).otherwise(lines)
        return F.struct(
            F.when(named, F.substring(lines[0], F.lit(3), F.length(lines[0]) - 4)).otherwise("").alias("caption"), cells(rest[0]).alias("headers"),
            F.transform(F.slice(rest, 3, F.size(rest)), cells).alias("rows"),
        )

    is_table = lambda p: p.rlike(r"^(\*\*[^\n]*\*\*\n)?\| [^\n]*\|\n\| ---")
    return F.struct(
        F.transform(F.filter(parts, lambda p: ~is_table(p)), read).cast(f"array<{BLOCK}>").alias("blocks"),
        F.transform(F.filter(parts, is_table), table).cast(f"array<{TABLE}>").alias("tables"),
    )


def encode_json(text: Column, blocks: Column, tables: Column) -> Column:
    """One object with the text, the blocks and the tables; fields that are null are left out."""
    return F.to_json(F.struct(F.lit(1).alias("v"), text.alias("text"), blocks.alias("blocks"), tables.alias("tables")))


def decode_json(surface: Column) -> Column:
    return F.from_json(surface, VIEW)


#: The registry: forms by name. ``markdown`` hands the text on as it is, which tells no blocks; ``external`` is known and not built.
CODECS: dict[str, Codec] = {
    "markdown": Codec(lambda text, blocks, tables: text, None),
    "compact": Codec(encode_compact, decode_compact),
    "json": Codec(encode_json, decode_json),
    "external": Codec(None, None),
}
DEFAULT = "markdown"


def selected(asked: Column) -> Column:
    """(codec, failure) for the name that is asked for; without a name the default. A failure never falls back to it."""
    name = F.trim(F.coalesce(asked, F.lit("")))
    able = [k for k, c in CODECS.items() if c.encode]
    return F.struct(
        F.when(name == "", DEFAULT).when(name.isin(*able), name).alias("codec"),
        F.when((name == "") | name.isin(*able), None).when(name.isin(*CODECS), CANNOT_ENCODE).otherwise(UNSUPPORTED).alias("failure"),
    )


def encoded(asked: Column, text: Column, blocks: Column, tables: Column) -> Column:
    """The surface in the form that is asked for, null if there is none."""
    out = F.lit(None).cast("string")
    for name, codec in CODECS.items():
        if codec.encode:
            out = F.when(selected(asked)["codec"] == name, codec.encode(text, blocks, tables)).otherwise(out)
    return out


def page_views(nodes: DataFrame) -> DataFrame:
    """One row a page: page_id, text (markdown), blocks and tables, all and whole, as the forms take them; page_id is unique."""
    block = F.struct("pos", F.struct("type", "level", "text").alias("b"))
    blocks = P.page_blocks(nodes, None, None, None).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("blocks"))
    table = F.struct("pos", F.struct("caption", "headers", "rows").alias("t"))
    tables = P.page_tables(nodes, None, None, None, None).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(table)), lambda x: x["t"]).alias("tables"))
    text = P.page_markdown(nodes).select("page_id", F.col("markdown").alias("text"))
    return text.join(blocks, "page_id", "left").join(tables, "page_id", "left").select(
        "page_id", "text", F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")).alias("blocks"),
        F.coalesce("tables", F.array().cast(f"array<{TABLE}>")).alias("tables"),
    )
