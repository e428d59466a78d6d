"""Whether blocks support a claim: retrieval by BM25, then a small grammar of "X is a Y" and "X uses Y"."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Heads of types that exclude each other.
SOFTWARE = frozenset("library module framework package api toolkit runtime".split())
STORES = frozenset("database db sql engine rdbms orm datastore store".split())

_IS = re.compile(r"(.+?)\s+is\s+(?:(?:a|an|the)\s+)?(.+)")
_USES = re.compile(r"(.+?)\s+(?:uses|using|utilizes|utilise|utilising)\s+(.+)")
_COPULA = re.compile(r"\b(?:is|are|was|were)\b(\s+not\b)?")
_USE = re.compile(r"\b(?:uses|using|utilizes|utilise|utilising)\b")
_NOT_USE = re.compile(r"\b(?:(?:does|do)\s+not\s+use|never\s+uses?)\b")
RANK = {"contradicted": 3, "supported": 2, "related": 1, "unknown": 0}


def plain(text: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9/]+", " ", text.lower()).split())


def parse_claim(claim: str) -> tuple[str, str, str] | None:
    """(kind, subject, object), or null for any other sentence."""
    for kind, shape in (("is", _IS), ("uses", _USES)):
        if m := shape.fullmatch(plain(claim)):
            return kind, m[1], m[2]
    return None


def _holds(text: str, phrase: str) -> bool:
    return f" {phrase} " in f" {text} "


def _covers(window: str, words: list[str], share: float) -> bool:
    words = [w for w in words if len(w) >= 3]
    return bool(words) and sum(w in window for w in words) >= share * len(words)


def judge_block(claim: tuple[str, str, str], block: str) -> str:
    kind, subject, obj = claim
    text, words = plain(block), obj.replace("/", " ").split()
    if not _holds(text, subject):
        return "related" if _holds(text, obj) else "unknown"
    verdicts = set()

    def near(m, reach):
        return subject in text[max(0, m.start() - 80) : m.start()], text[m.end() : m.end() + reach]

    if kind == "is":
        for m in _COPULA.finditer(text):
            close, window = near(m, 120)
            said = _holds(window, obj) or _covers(window, words, 0.6)
            if m[1]:
                verdicts.add("contradicted" if close and said else "related")
                continue
            if said and subject in text[: m.start()]:
                verdicts.add("supported")
            heads = set(window[:80].split())
            mine, theirs = set(words), (bool(heads & STORES), bool(heads & SOFTWARE))
            if close and ((mine & STORES and theirs == (False, True)) or (mine & SOFTWARE and theirs == (True, False))):
                verdicts.add("type_conflict")
        if "contradicted" not in verdicts and "supported" not in verdicts and "type_conflict" in verdicts:
            verdicts.add("contradicted")
    else:
        for m in _NOT_USE.finditer(text):
            close, window = near(m, 100)
            if close and _holds(window, obj):
                verdicts.add("contradicted")
        for m in _USE.finditer(text):
            close, window = near(m, 100)
            denied = re.search(r"\b(?:not|never)\b", text[max(0, m.start() - 12) : m.start()])
            if close and not denied and (_holds(window, obj) or _covers(window, words, 1.0)):
                verdicts.add("supported")
    return next((v for v in ("contradicted", "supported") if v in verdicts), "related")


def claim_status(claim: str, blocks: list[str], complete: bool = True) -> str:
    """contradicted, supported, unsupported or unknown; the worst of the blocks decides."""
    if not blocks:
        return "unsupported" if complete else "unknown"
    parsed = parse_claim(claim)
    if not parsed:
        return "unknown"
    worst = max((judge_block(parsed, b) for b in blocks if b and b.strip()), key=RANK.get, default="unknown")
    return worst if worst in ("contradicted", "supported") else "unsupported"


def with_status(df: DataFrame, claim: str, blocks: str) -> DataFrame:
    """``df`` with ``status`` of the column ``claim`` against the array column ``blocks``."""
    kept = df.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            claims, texts = batch.column(at(claim)).to_pylist(), batch.column(at(blocks)).to_pylist()
            status = [claim_status(c or "", b or []) for c, b in zip(claims, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.string())], names=[*kept, "status"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(judge, schema + ", status string")


def summarize(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("claims"), *[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "contradicted", "unsupported", "unknown")]
    )
