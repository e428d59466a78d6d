"""Repeated lines and sentences, found by the digests of normalised units.

Every line with a word is a unit, and so is every sentence of ``min_words`` words within a line: lines are cut after ``.``, ``!``
or ``?`` before white space, since a repeated passage can start amid a line. A line that is one such sentence is one unit.
With ``paragraphs``, so are runs of several lines without an empty one; as a repeated paragraph's lines all occur
earlier, lines alone find it too. A unit is normalised to its lower-case words. The digests are grouped over all documents;
the earliest occurrence (by document id, then place) stays, every other one is removed. As an option, ``min_passage``
removes only those in a passage: a run of neighbouring units that all occur earlier, of so many words or more together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, row_uid, whole_row

#: Fewest words of a sentence within a line; shorter ones are left to the line.
MIN_WORDS = 4
SENTENCE, LINE, PARAGRAPH = range(3)
_UNIT = re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|(?=\n)|\Z)")
_WORD = re.compile(r"\w+")
_LINE = re.compile(r"[^\n]+")
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)+")


def units(text: str | None, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit of at least ``min_words`` words; code points, end exclusive."""
    for m in _UNIT.finditer(text or ""):
        unit = m[0]
        if len(unit) < 2 * min_words - 1:
            continue
        seq = _WORD.findall(unit.lower())
        if len(seq) >= min_words:
            start = m.start() + len(unit) - len(unit.lstrip())
            yield start, m.start() + len(unit.rstrip()), len(seq), _digest(seq)


def _digest(seq: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(seq).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _whole(m: re.Match, seq: list[str]) -> tuple[int, int, int, bytes]:
    body = m[0]
    return m.start() + len(body) - len(body.lstrip()), m.start() + len(body.rstrip()), len(seq), _digest(seq)


def line_units(text: str | None, min_words: int) -> Iterator[tuple[int, tuple[int, int, int, bytes]]]:
    """Line number and unit of each line with a word, but for those that are one sentence of ``min_words`` words and nothing else."""
    for k, m in enumerate(_LINE.finditer(text or "")):
        seq = _WORD.findall(m[0].lower())
        if seq and (len(seq) < min_words or len(seq) > max(len(_WORD.findall(u[0].lower())) for u in _UNIT.finditer(m[0]))):
            yield k, _whole(m, seq)


def paragraph_units(text: str | None) -> Iterator[tuple[int, tuple[int, int, int, bytes]]]:
    """Number and unit of each paragraph that has words in more than one line."""
    for k, m in enumerate(_PARAGRAPH.finditer(text or "")):
        seq = _WORD.findall(m[0].lower())
        if seq and len(seq) > max(len(_WORD.findall(line.lower())) for line in m[0].split("\n")):
            yield k, _whole(m, seq)


def unit_table(
    df: DataFrame, id_col: str, text_col: str, min_words: int, lines: bool = False, paragraphs: bool = False, uid: str | None = None,
) -> DataFrame:
    """(id, uid, level, place, start, end, words, digest) of all units, materialised; ``uid`` is the row's, drawn
    here or read from the column so named; ``level`` says whether the unit is a sentence, a line or a paragraph."""

    def cut_text(text: str | None) -> list[dict]:
        found = [(SENTENCE, k, u) for k, u in enumerate(units(text, min_words))]
        if lines:
            found += [(LINE, k, u) for k, u in line_units(text, min_words)]
        if paragraphs:
            found += [(PARAGRAPH, k, u) for k, u in paragraph_units(text)]
        return [{"level": x, "place": k, "start": s, "end": e, "words": n, "digest": d} for x, k, (s, e, n, d) in found]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut_text(t.as_py()) for t in batch.column(1)]
            kind = pa.struct([("level", pa.int32()), ("place", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int32()), ("digest", pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], names=["id", "units"])

    ids = F.struct(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{uid}`") if uid else F.lit(None).cast("bigint")).alias("uid"))
    lean = df.select(ids.alias("ids"), F.col(f"`{text_col}`"))
    schema = f"id {lean.schema[0].dataType.simpleString()}, units array<struct<level: int, place: int, start: bigint, end: bigint, words: int, digest: binary>>"
    return materialize(
        lean.mapInArrow(cut, schema).select("id.id", (F.col("id.uid") if uid else row_uid()).alias("uid"), "units")
        .select("id", "uid", F.explode("units").alias("u")).select("id", "uid", "u.*"),
        "units",
    )


def repeated_units(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
    min_passage: int = 1, lines: bool = True, paragraphs: bool = False,
) -> DataFrame:
    """One row per removed unit: doc_id, start, end, words, keep_doc_id, keep_start, passage_words.

    ``start`` and ``end`` are code points of the original text; ``keep_doc_id`` and ``keep_start`` say where the
    earliest occurrence stands, in the same document perhaps. Null ids come last; of rows that share an id, one is
    earlier. Null and empty texts have no units. Repeated rows are copies and lose all units but the first row's. An
    empty frame gives an empty one. Other columns are not read. A removed line stands beside its own removed sentences,
    and a paragraph beside its lines, so spans can overlap; ``passage_words`` counts neighbours of the same kind.
    """
    return _repeats(unit_table(df, id_col, text_col, min_words, lines, paragraphs), min_passage).drop("uid")


def _repeats(table: DataFrame, min_passage: int) -> DataFrame:
    """:func:`repeated_units` of a unit table, with ``uid``."""
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "uid", "start")
    # one row for each digest and task goes into the shuffle, however often a unit occurs; the result is written, so
    # that it is no part of the join's stage and Spark can split a hot digest over tasks
    earliest = materialize(
        table.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
        .select("digest", "first"),
        "earliest",
    )
    later = (F.col("uid") != F.col("first.uid")) | (F.col("start") != F.col("first.start"))
    repeats = table.join(earliest.hint("merge"), "digest").filter(later)
    # places of a run ascend by one; a window holds the units of one document
    run = F.col("place") - F.row_number().over(Window.partitionBy("uid", "level").orderBy("place"))
    words = F.sum("words").over(Window.partitionBy("uid", "level", "run"))
    return repeats.withColumn("run", run).withColumn("passage_words", words).filter(F.col("passage_words") >= min_passage).select(
        "uid", F.col("id").alias("doc_id"), "start", "end", "words", F.col("first.id").alias("keep_doc_id"),
        F.col("first.start").alias("keep_start"), "passage_words",
    )


def cut_out(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without ``spans``; a line that loses all it has goes with its line end."""
    if text is None or not spans:
        return text
    kept, at = [], 0
    for start, end in sorted(spans):
        kept.append(text[at:start])
        at = max(at, end)
    kept.append(text[at:])
    lines = "\0".join(kept).split("\n")
    clean = [line.replace("\0", "").strip(" ") if "\0" in line else line for line in lines]
    return "\n".join(c for c, line in zip(clean, lines, strict=True) if c or "\0" not in line)


def without_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_passage: int = 1,
    lines: bool = True, paragraphs: bool = False,
) -> DataFrame:
    """All rows and columns of ``df``, the text without its repeated units; a text made of them becomes empty.

    Rows are numbered and materialised first, so that rows that share an id keep their own spans apart.
    """
    whole = materialize(df.select(whole_row(df).alias("row"), row_uid().alias("uid")), "rows")
    table = unit_table(whole.select("uid", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text")), "id", "text", min_words, lines, paragraphs, "uid")
    spans = _repeats(table, min_passage).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kept = F.udf(lambda text, spans: cut_out(text, [tuple(s) for s in spans or ()]), "string")
    text = kept(F.col("row")[text_col], "spans")
    return whole.join(spans, "uid", "left").select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")


def op3_sentence_hash_dedup(spark, sf_dir):
    """Every later occurrence of a repeated line of the documents, of any length, and of a repeated sentence within one, with its original offsets and where the
    earliest occurrence stands."""
    return repeated_units(read_table(spark, sf_dir, "documents"))
