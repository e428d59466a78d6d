"""Markdown under a budget: pruning paragraphs by relevance, cutting safely, fields by selectors."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.html import Node, build_tree, squeeze
from .sections import ROWS_AT_ONCE, section_index, select_section

# Lines that are never content, thresholds, marks of what was left out.
DROPPED_LINES = (
    r"help improve mdn|view this page on github|learn how to contribute|this page was last modified|mdn contributors"
    r"|report a problem with this content|ads via carbon|carbonads|was this helpful|edit this page on github|^on this page$"
    r"|^community$|become a sponsor|^sponsor$|\bdiscord\b|\bbluesky\b|^menu\s*on this page|menuon this page"
    r"|^[-*]\s+\[(Discord|Bluesky|GitHub|X)\]|^community\b.{0,30}$"
)
SNIP_TAIL = "\n\n<!-- SNIP: tail (reason: head_safe) -->"
SNIP_MIDDLE = "\n\n<!-- SNIP: middle (reason: budget_exceeded) -->\n\n"
LEVEL_WEIGHT = {1: 1.2, 2: 1.1, 3: 1.0, 4: 0.9, 5: 0.8, 6: 0.7}

_WIDE = re.compile("[一-鿿㐀-䶿぀-ヿ가-힣豈-﫿]")
_WORD = re.compile(r"[^\W_]{3,}")
_LINK = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)")


def prune_lines(markdown: Column) -> Column:
    """Markdown without empty links, lines of page furniture and runs of blank lines."""
    bare = F.regexp_replace(F.coalesce(markdown, F.lit("")), r"(?<!!)\[\s*\]\([^)\s]*\)", "")
    kept = F.filter(F.split(bare, "\n"), lambda x: ~F.trim(x).rlike("(?i)" + DROPPED_LINES))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def cost(c: str) -> float:
    return 0.25 if c <= "\x7f" else 1.0 if _WIDE.match(c) or c > "￿" else 0.5


def estimate(text: str | None) -> int:
    if not text:
        return 0
    if text.isascii():
        return max(1, math.ceil(len(text) / 4))
    return max(1, math.ceil(sum(map(cost, text))))


def fit(text: str, tokens: int) -> int:
    """Characters of the longest prefix within ``tokens``."""
    if text.isascii():
        return min(len(text), 4 * max(0, tokens))
    total = 0.0
    for i, c in enumerate(text):
        total += cost(c)
        if total > tokens:
            return i
    return len(text)


def safe_cut(text: str, at: int) -> int:
    """A place at or before ``at`` that ends a line, else a word, and splits no markdown link."""
    at = min(len(text), max(1, at))
    if at == len(text):
        return at
    line = text.rfind("\n", 0, at)
    word = max(text.rfind(" ", 0, at), line)
    at = line if line > at // 2 else word if word > 0 else at
    opened = text.rfind("[", max(0, at - 240), at)
    if opened >= 0 and (m := _LINK.match(text, opened)) and m.end() > at:
        at = opened
    return max(at, 1)


def head(text: str, tokens: int) -> str:
    most = fit(text, max(1, tokens - estimate(SNIP_TAIL)))
    return text if len(text) <= most else text[: safe_cut(text, most)].rstrip() + SNIP_TAIL


def sandwich(text: str, tokens: int) -> str:
    """The start and the end of a text; the middle is left out."""
    room = max(1, tokens - estimate(SNIP_MIDDLE))
    first = safe_cut(text, fit(text, max(1, int(room * 0.55))))
    back = text[::-1]
    start = len(text) - fit(back, int(room * 0.40))
    line = text.find("\n", start, start + 240)
    start = line + 1 if line >= 0 else start
    opened = text.rfind("[", max(0, start - 240), start)
    if opened >= 0 and (m := _LINK.match(text, opened)) and m.end() > start:
        start = m.end()
    return text[:first].rstrip() + SNIP_MIDDLE + text[start:].lstrip("\n") if start > first else head(text, tokens)


def budgeted(text: str | None, tokens: int, query: str | None = None) -> tuple[str, str | None]:
    """(text, strategy) within a budget: as it is, its section that answers, its two ends, or its head."""
    text = text or ""
    if estimate(text) <= tokens:
        return text, None
    if not query:
        return head(text, tokens), "head_safe"
    sections = section_index(text)
    chosen = select_section(sections, query)
    if chosen["status"] == "miss":
        return sandwich(text, tokens), "sandwich"
    s = sections[chosen["ordinal"]]
    own = (f"{'#' * s['level']} {s['heading']}\n" if s["level"] else "") + s["body"]
    return own if estimate(own) <= tokens else head(own, tokens), "focus_window"


def blocks_of_markdown(markdown: str) -> list[tuple[str, str]]:
    """(kind, text): headings, code fences whole, paragraphs between blank lines."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    fence = False

    def close(kind):
        if held:
            out.append((kind, "\n".join(held)))
            held.clear()

    for line in markdown.split("\n"):
        if line.lstrip().startswith("```"):
            if not fence:
                close("paragraph")
            held.append(line)
            if fence:
                close("code")
            fence = not fence
        elif fence:
            held.append(line)
        elif re.match(r"#{1,6}\s", line):
            close("paragraph")
            out.append(("heading", line))
        elif not line.strip():
            close("paragraph")
        else:
            held.append(line)
    close("code" if fence else "paragraph")
    return out


def prune_paragraphs(markdown: str | None, query: str | None = None) -> str:
    """Markdown without the paragraphs that bear on neither the question nor the headings.

    Scored by BM25 against the question's words, or those of the headings; the first paragraph of a section stays
    when nothing is asked; a heading goes with its last paragraph. What has two paragraphs or fewer stays whole.
    """
    blocks = blocks_of_markdown(markdown or "")
    paragraphs = [t for k, t in blocks if k == "paragraph"]
    if len(paragraphs) <= 2:
        return markdown or ""
    tokens = [set(_WORD.findall(p.lower())) for p in paragraphs]
    lengths = [max(1, len(_WORD.findall(p.lower()))) for p in paragraphs]
    mean, n = sum(lengths) / len(lengths), len(paragraphs)
    source = query or " ".join(t for k, t in blocks if k == "heading")
    terms = set(_WORD.findall(source.lower()))
    df = {t: sum(t in x for x in tokens) for t in terms}
    least = 0.06 if query else 0.12
    kept: list[tuple[str, str, bool]] = []
    at, level, lead = 0, 0, False
    for kind, text in blocks:
        if kind == "heading":
            level, lead = len(text) - len(text.lstrip("#")), True
            kept.append((kind, text, False))
            continue
        if kind == "code":
            kept.append((kind, text, True))
            continue
        own, size, at = tokens[at], lengths[at], at + 1
        score = sum(
            math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (text.count(t) * 2.2) / (text.count(t) + 1.2 * (0.25 + 0.75 * size / mean))
            for t in own & terms
        ) * LEVEL_WEIGHT.get(level, 1.0)
        lower = text.lower()
        furniture = any(b in lower for b in T.BOILERPLATE_TERMS) or any(p in lower for p in T.SEO_PHRASES)
        first, lead = lead and not query, False
        if not furniture and (first or (size >= 6 and score >= least)):
            kept.append((kind, text, True))
    out = [t for i, (k, t, body) in enumerate(kept) if body or any(b for _, _, b in _section_after(kept, i))]
    return "\n\n".join(out) if len(out) >= 2 else (markdown or "")


def _section_after(kept, i):
    for x in kept[i + 1 :]:
        if x[0] == "heading":
            return
        yield x


# fields by selectors: tag, #id, .class, [attr], [attr=value], descendants and children


_STEP = re.compile(r"([a-z0-9]+|\*)?((?:[#.][\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\])*)", re.I)


def _fits(node: Node, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m or (m[1] and m[1] not in ("*", node.tag)):
        return False
    for test in re.findall(r"[#.][\w-]+|\[[^\]]+\]", m[2] or ""):
        if test[0] == "#":
            ok = node.attrs.get("id") == test[1:]
        elif test[0] == ".":
            ok = test[1:] in node.attrs.get("class", "").split()
        else:
            name, _, value = test[1:-1].partition("=")
            ok = name in node.attrs and (not value or node.attrs[name] == value.strip("\"'"))
        if not ok:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    steps = re.sub(r"\s*>\s*", " >", selector.strip()).split()

    def above(node: Node, k: int, direct: bool) -> bool:
        if k < 0:
            return True
        step, up = steps[k].lstrip(">"), node.parent
        while up:
            if _fits(up, step) and above(up, k - 1, steps[k].startswith(">")):
                return True
            if direct:
                return False
            up = up.parent
        return False

    return [n for n in root.walk() if _fits(n, steps[-1].lstrip(">")) and above(n, len(steps) - 2, steps[-1].startswith(">"))]


def extract_fields(html: str | None, spec: dict[str, dict]) -> dict[str, str | None]:
    """Values of named fields: ``selector`` with ``attr`` (text, or an attribute), ``regex`` or ``const``; ``multiple``
    joins by ``; ``; ``divide`` scales a number."""
    root, out = build_tree(html), {}
    for name, f in spec.items():
        if "const" in f:
            values = [str(f["const"])]
        elif "regex" in f:
            values = [m.group(m.lastindex and 1 or 0) for m in re.finditer(f["regex"], html or "")]
        else:
            attr = f.get("attr", "text")
            values = [squeeze(n.text() if attr == "text" else n.attrs.get(attr)) for n in select(root, f["selector"])]
        values = [v for v in values if v]
        if f.get("divide") and values:
            numbers = [re.search(r"-?\d+(?:\.\d+)?", v.replace(",", "")) for v in values]
            values = [f"{float(m[0]) / f['divide']:g}" for m in numbers if m]
        out[name] = ("; ".join(values) if f.get("multiple") else values[0]) if values else None
    return out


def per_text(df: DataFrame, column: str, name: str, function, kind: pa.DataType, schema: str) -> DataFrame:
    """``df`` with ``name`` = function(value of ``column``), one row at a time in Arrow batches."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                values = pa.array([function(v.as_py()) for v in batch.column(batch.schema.get_field_index(column))], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    lead = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    return df.mapInArrow(apply, f"{lead}{name} {schema}")
