"""Sections of markdown: index, ranking for a question, chunks. One pass over a document's lines, in Arrow tasks.

A section's parent and its anchor's number depend on all headings before it, so this is one linear scan a document
and not an explode with windows, which would send every line through a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
_EXPLICIT = re.compile(r"\s*\{#([^}]+)\}\s*$")
_LINK = re.compile(r"\[[^\]]*\]\([^)]*\)")
_TECHNICAL = re.compile(r"[^\W_]+(?:[._-][^\W_]+)*")
CONNECTORS = (" is any ", " is a ", " is an ", " refers to ", " is defined as ")
#: Characters of a body that ranking looks at, and before a connector in which its subject stands.
PROBE, SUBJECT = 2048, 48


def normal(text: str, form: str = "NFKC") -> str:
    kept = (c if c.isalnum() or c in "_-." else " " for c in unicodedata.normalize(form, text).lower())
    return " ".join("".join(kept).split())


def section_index(markdown: str | None, form: str = "NFKC", unnamed: str = "section-{}", blank: str | None = None) -> list[dict]:
    """Sections in order; text before the first heading is one of level 0.

    ``form``: of Unicode, in which headings become anchors; ``unnamed``: the anchor of a heading without letters and digits, by its
    number; ``blank``: characters that bodies do not begin or end with, all white space with None.
    """
    lines = (markdown or "").split("\n")
    heads = [(i, m) for i, m in ((i, _HEADING.match(line.rstrip("\r"))) for i, line in enumerate(lines)) if m]
    out: list[dict] = []

    def add(level, heading, anchors, parent, body):
        density = min(1.0, sum(len(x) for x in _LINK.findall(body)) / len(body)) if body else 0.0
        title = normal(heading)
        index_like = "contents" in title or title == "index" or title.endswith(" index") or density >= 0.35
        out.append({
            "ordinal": len(out), "level": level, "heading": heading, "anchors": anchors, "parent": parent,
            "link_density": round(density, 4), "index_like": index_like, "body": body,
        })

    lead = "\n".join(lines[: heads[0][0]] if heads else lines).strip(blank)
    if lead:
        add(0, "Document", ["document"], -1, lead)
    seen: dict[str, int] = {}
    open_: list[tuple[int, int]] = []
    for k, (at, m) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        level, heading = len(m[1]), m[2].strip()
        own = _EXPLICIT.search(heading)
        explicit = own[1].strip().lstrip("#").lower() if own else None
        heading = heading[: own.start()].rstrip() if own else heading
        base = explicit or normal(heading, form).replace(" ", "-") or unnamed.format(k + 1)
        seen[base] = seen.get(base, 0) + 1
        synthetic = base if seen[base] == 1 else f"{base}-{seen[base]}"
        while open_ and open_[-1][0] >= level:
            open_.pop()
        parent = open_[-1][1] if open_ else -1
        open_.append((level, len(out)))
        add(level, heading, [synthetic] if explicit in (None, synthetic) else [explicit, synthetic], parent, "\n".join(lines[at + 1 : end]).strip(blank))
    return out


def _has(text: str, term: str) -> bool:
    return term in text or (len(term) > 4 and term.endswith("s") and term[:-1] in text)


def rank_sections(sections: list[dict], query: str, fragment: str | None = None) -> list[dict]:
    """Each section's score and the reasons for it, best first."""
    query = (query or fragment or "").strip()
    asked = normal(query)
    terms = list(dict.fromkeys(t.lower() for t in _TECHNICAL.findall(query)))
    ranked = []
    for s in sections:
        title, probe = normal(s["heading"]), s["body"][:PROBE]
        body, lower = normal(probe), probe.lower()
        in_title, in_body = sum(_has(title, t) for t in terms), sum(_has(body, t) for t in terms)
        defined = any(
            any(_has(normal(lower[max(0, m.start() - SUBJECT) : m.start()]), t) for t in terms)
            for c in CONNECTORS
            for m in re.finditer(re.escape(c), lower)
        )
        parts = [
            ("exact_fragment", 10_000 * (fragment is not None and fragment in s["anchors"])),
            ("exact_anchor", 4_000 * (bool(asked) and asked in s["anchors"])),
            ("exact_heading", 2_500 * (bool(asked) and title == asked)),
            (f"heading_terms:{in_title}/{len(terms)}", 350 * in_title),
            ("heading_coverage", 700 * (0 < in_title == len(terms))),
            (f"nearby_body_terms:{in_body}/{len(terms)}", 45 * in_body),
            ("nearby_phrase", 160 * (bool(asked) and asked in body)),
            ("definitional_answer", (900 + min(300, 50 * s["level"])) * defined),
        ]
        score = sum(p for _, p in parts)
        reasons = [r for r, p in parts if p]
        if score > 0 and len(s["body"]) >= 32 and s["link_density"] < 0.35:
            score, reasons = score + 80, [*reasons, "answer_body"]
        if s["index_like"]:
            score, reasons = score - 3_000, [*reasons, "index_penalty"]
        ranked.append({**s, "score": score, "reasons": reasons})
    return sorted(ranked, key=lambda s: (-s["score"], s["ordinal"]))


def select_section(sections: list[dict], query: str, fragment: str | None = None) -> dict:
    """The winning section with hit, weak or miss and its confidence."""
    ranked = rank_sections(sections, query, fragment)
    if not ranked or ranked[0]["score"] <= 0:
        return {"status": "miss", "confidence": 0.0, "ordinal": None, "anchor": None, "score": ranked[0]["score"] if ranked else 0}
    top = ranked[0]
    sure = (fragment is not None and fragment in top["anchors"]) or {"exact_anchor", "exact_heading", "heading_coverage"} & set(top["reasons"])
    return {
        "status": "hit" if sure else "weak", "confidence": 0.95 if sure else 0.55, "ordinal": top["ordinal"],
        "anchor": top["anchors"][0], "score": top["score"],
    }


def answer_unit(section: dict) -> str | None:
    """The least that answers: heading, first prose, first list, code or table with its short label."""
    blocks = [b.strip() for b in section["body"].replace("\r\n", "\n").split("\n\n") if b.strip()]
    if not blocks:
        return None

    def structured(b):
        return b.lstrip().startswith(("- ", "* ", "```", "|"))

    at = next((i for i, b in enumerate(blocks) if structured(b)), None)
    parts = [f"{'#' * max(1, section['level'])} {section['heading']}", next((b for b in blocks if not structured(b)), "")]
    if at is not None:
        parts += [blocks[at - 1]] if at and len(blocks[at - 1]) <= 160 else []
        parts.append(blocks[at])
    return "\n\n".join(dict.fromkeys(p for p in parts if p))


def chunks(markdown: str | None, size: int = 2000) -> list[dict]:
    """Pieces that start at headings or once ``size`` characters are full, each with its trail of headings."""
    out: list[dict] = []
    held: list[str] = []
    trail: list[str | None] = []
    length = 0

    def close():
        nonlocal held, length
        if held:
            out.append({"text": "\n".join(held), "headers": [h for h in trail if h]})
        held, length = [], 0

    for line in re.split(r"\r?\n", markdown or ""):
        m = re.match(r"(#{1,6})\s+(.+)$", line)
        if m:
            close()
            level = len(m[1])
            trail[level - 1 :] = [None] * (level - 1 - len(trail)) + [m[2].strip()]
        held.append(line)
        length += len(line) + 1
        if length >= size:
            close()
    close()
    return out


_SECTION = pa.struct([
    ("ordinal", pa.int32()), ("level", pa.int32()), ("heading", pa.string()), ("anchors", pa.list_(pa.string())),
    ("parent", pa.int32()), ("link_density", pa.float64()), ("index_like", pa.bool_()), ("body", pa.string()),
])
_SELECTED = pa.struct([
    ("status", pa.string()), ("confidence", pa.float64()), ("ordinal", pa.int32()), ("anchor", pa.string()), ("score", pa.int32()),
])
_CHUNK = pa.struct([("text", pa.string()), ("headers", pa.list_(pa.string()))])


#: Rows whose results a task holds at once: a batch of Spark has up to 10,000.
ROWS_AT_ONCE = 128


def _per_row(df: DataFrame, column: str, function, kind: pa.DataType, name: str, schema: str) -> DataFrame:
    """``df`` with ``name`` = function(text of ``column``) in place of ``column``."""
    kept = [c for c in df.columns if c != column]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = batch.column(batch.schema.get_field_index(column))
                out = pa.array([function(t.as_py()) for t in texts], kind)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(c)) for c in kept], out], names=[*kept, name]
                )

    lead = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.mapInArrow(apply, f"{lead}{name} {schema}")


_SECTION_SQL = "struct<ordinal: int, level: int, heading: string, anchors: array<string>, parent: int, link_density: double, index_like: boolean, body: string>"


def with_sections(df: DataFrame, column: str, **options) -> DataFrame:
    """``options`` as in :func:`section_index`."""
    return _per_row(df, column, lambda t: section_index(t, **options), pa.list_(_SECTION), "sections", f"array<{_SECTION_SQL}>")


def with_selection(df: DataFrame, column: str, query: str, fragment: str | None = None) -> DataFrame:
    return _per_row(
        df, column, lambda t: select_section(section_index(t), query, fragment), _SELECTED, "selected",
        "struct<status: string, confidence: double, ordinal: int, anchor: string, score: int>",
    )


def with_chunks(df: DataFrame, column: str, size: int = 2000) -> DataFrame:
    return _per_row(df, column, lambda t: chunks(t, size), pa.list_(_CHUNK), "chunks", "array<struct<text: string, headers: array<string>>>")


def content_selectors(sections, selectors: list[str]):
    """Bodies of the sections a list of selectors picks: ``# heading`` prefixes or substrings, the first match of each."""
    picked = F.array()
    for s in selectors:
        want = s.lstrip("#").strip().lower()
        low = F.transform(sections, lambda x: F.lower(x["heading"]))
        at = F.array_position(F.transform(low, lambda h: h.startswith(want) if s.startswith("#") else h.contains(want)), True)
        picked = F.array_union(picked.cast("array<bigint>"), F.when(at > 0, F.array(at)).otherwise(F.array().cast("array<bigint>")))
    return F.array_sort(picked)
