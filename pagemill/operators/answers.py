"""What of a page must stay for a question: its defining paragraph, its answer unit, and whether they did stay.

The defining paragraph is found by column expressions over an array of paragraphs; cuts that depend on all that was
kept so far run a document at a time in Arrow tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .compile import estimate, head
from .sections import answer_unit, section_index, select_section

# Connectors of a definition, and weights and limits that results depend on.
DEFINES = (" is any ", " is a ", " is an ", " is the ", " are the ", " refers to ", " is defined as ")
BEFORE = 40
LEAST_MARKDOWN = 128
SENTENCE, PROBE = 16, 80


def focus_terms(focus: str) -> list[str]:
    """The distinct words of a question that are long enough to be defined."""
    return [w for w in dict.fromkeys(re.findall(r"[^\W_]{3,}", focus.lower())) if len(w) >= 4]


def _loose(text: Column, term: str) -> Column:
    hit = text.contains(term)
    return hit | text.contains(term[:-1]) if len(term) > 4 and term.endswith("s") else hit


def _subject(lower: Column, terms: list[str]) -> Column:
    """Whether one of ``terms`` stands right before a connector, wherever that occurs."""
    out = F.lit(False)
    for connector in DEFINES:
        parts = F.split(lower, re.escape(connector), -1)
        before = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _window(parts, connector))
        for term in terms:
            out = out | F.exists(before, _names(term))
    return out


def _window(parts: Column, connector: str):
    return lambda _, k: F.right(F.array_join(F.slice(parts, F.lit(1), k + 1), connector), F.lit(BEFORE))


def _names(term: str):
    return lambda w: _loose(w, term)


def anchor_paragraph(markdown: Column, focus: str) -> Column:
    """(score, text) of the paragraph that defines what is asked: 2 for each term, 5 more if a term is its subject.

    The best, the first of equals; null if none both defines something and holds a term.
    """
    terms = focus_terms(focus)
    if not terms:
        return F.lit(None).cast("struct<score: int, text: string>")
    paragraphs = F.filter(F.transform(F.split(markdown, "\n\n"), lambda x: F.trim(x)), lambda p: p != "")

    def judge(p):
        lower = F.lower(p)
        hits = sum((F.when(_loose(lower, t), 1).otherwise(0) for t in terms), F.lit(0))
        score = F.when(T.contains_any(lower, DEFINES) & (hits > 0), hits * 2 + F.when(_subject(lower, terms), 5).otherwise(0))
        return F.struct(score.alias("score"), p.alias("text"))

    judged = F.filter(F.transform(paragraphs, judge), lambda s: s["score"].isNotNull())
    return F.aggregate(
        judged, F.lit(None).cast("struct<score: int, text: string>"),
        lambda best, s: F.when(best.isNull() | (s["score"] > best["score"]), s).otherwise(best),
    )


def keep_anchor(compiled: str | None, anchor: str | None, tokens: int) -> str:
    """``compiled`` text within ``tokens``, with ``anchor`` before it unless its first sentence is there."""
    body = compiled or ""

    def within(text, limit):
        return text if estimate(text) <= limit else head(text, limit)

    first = ""
    if anchor:
        dot = anchor.find(". ")
        first = anchor[: dot if dot >= SENTENCE else min(len(anchor), PROBE)]
    if not anchor or (len(first) >= SENTENCE and first.lower() in body.lower()):
        return within(body, tokens)
    if not body.strip():
        return within(anchor, tokens)
    whole = f"{anchor}\n\n{body}"
    if estimate(whole) <= tokens:
        return whole
    room = max(48, tokens - estimate(anchor) - 4)
    return within(f"{anchor}\n\n{within(body, room)}", tokens)


def paragraphs_of(text: str) -> list[str]:
    return [b.strip() for b in text.replace("\r\n", "\n").split("\n\n") if b.strip()]


def bears_on(text: str, focus: str) -> bool:
    """The phrase asked for, or two thirds of its words (all of two or fewer), by their stems."""
    low = text.lower()
    if len(focus.strip()) >= 4 and focus.strip().lower() in low:
        return True
    terms = list(dict.fromkeys(re.findall(r"[^\W_]{3,}", focus.lower())))
    words = set(re.findall(r"[^\W_]{3,}", low))

    def same(a, b):
        n = min(len(a), len(b))
        stem = max(5, -(-n * 7 // 10))
        return a == b or (n >= 4 and a[:n] == b[:n]) or (n >= stem and a[:stem] == b[:stem])

    hits = sum(any(same(w, x) for w in words for x in group) for group in T.expand_terms(terms))
    return bool(terms) and (hits == len(terms) or (len(terms) >= 3 and hits >= max(2, -(-2 * len(terms) // 3))))


def block_weight(block: str, focus: str) -> int:
    """How well a block answers: code little, a match of the question more, the shape of a definition most."""
    if block.startswith("```"):
        return 0 if focus_terms(focus) else 3
    low = block.lower()
    shape = 10 if " is any " in low else 6 if " is a " in low or " is an " in low else 5 if " refers to " in low or " is defined as " in low else 0
    return 6 * bears_on(block, focus) + shape


def focus_cut(section: str | None, tokens: int, focus: str) -> str:
    """A section within ``tokens``: its answer unit first, then the other blocks that fit, the best first."""
    text = section or ""
    if not text.strip() or tokens <= 0:
        return ""
    if estimate(text) <= tokens:
        return text
    index = section_index(text)
    unit = answer_unit(index[0]) if index else None

    def filled(kept, blocks):
        for block in sorted(blocks, key=lambda b: -block_weight(b, focus)):
            if estimate("\n\n".join([*kept, block])) <= tokens:
                kept = [*kept, block]
        return kept

    if unit and estimate(unit) <= tokens:
        protected = paragraphs_of(unit)
        return "\n\n".join(filled(protected, [b for b in paragraphs_of(text) if b not in protected]))
    blocks = paragraphs_of(text)
    headings = [b for b in blocks if b.startswith("#")]
    kept = filled(headings, [b for b in blocks if not b.startswith("#")])
    return "\n\n".join(kept) if len(kept) > len(headings) else head(text, tokens)


def completeness(source: str | None, compiled: str | None, focus: str | None, truncated: bool) -> dict:
    """Whether the compiled text still answers: focus (hit, weak, miss, not_requested), completeness, reason, tokens to ask for."""
    partly = "partial" if truncated else "complete"
    if not (focus or "").strip():
        return {"focus": "not_requested", "completeness": partly, "reason": None, "suggested": None}
    sections = section_index(source)
    chosen = select_section(sections, focus)
    if chosen["ordinal"] is None:
        return {"focus": "miss", "completeness": "incomplete", "reason": "source_missing", "suggested": None}
    unit = answer_unit(sections[chosen["ordinal"]])
    held = unit is not None and all(b in (compiled or "") for b in paragraphs_of(unit) if not b.startswith("#"))
    if not held:
        suggested = None if unit is None else max(LEAST_MARKDOWN, estimate(unit) + 32)
        return {"focus": chosen["status"], "completeness": "incomplete", "reason": "focus_body_truncated", "suggested": suggested}
    return {"focus": chosen["status"], "completeness": partly, "reason": "context_truncated" if truncated else None, "suggested": None}
