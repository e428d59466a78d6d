"""Defining paragraphs, focus-aware cuts and completeness of documents with headings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import compile as C
from ..registry import query, table
from .sections import headed
from .text import BLOCKS

FOCUS = "thattion closures"
TERMS = A.focus_terms(FOCUS)
#: Every sixth line defines something asked for, another one something else.
_LINE = "CASE pos % 6 WHEN 1 THEN 'A Closure is any thattion. ' || line WHEN 3 THEN line || ' a lamp is a thing, not thattion' WHEN 4 THEN line || ' thattion refers to closures' ELSE line END"


def _loose(x, t):
    return f"(contains({x}, '{t}')" + (f" OR contains({x}, '{t[:-1]}'))" if len(t) > 4 and t.endswith("s") else ")")


def _before(c):
    return f"list_transform(range(1, len(string_split(l, '{c}'))), lambda k: right(array_to_string(string_split(l, '{c}')[1:k], '{c}'), {A.BEFORE}))"


_SUBJECT = " OR ".join(f"len(list_filter({_before(c)}, lambda w: {' OR '.join(_loose('w', t) for t in TERMS)})) > 0" for c in A.DEFINES)
_HITS = " + ".join(f"CASE WHEN {_loose('l', t)} THEN 1 ELSE 0 END" for t in TERMS)


@query("anchor_paragraph", f"""
WITH a AS (SELECT doc_id, pos, trim({_LINE}) AS p FROM {BLOCKS}), b AS (SELECT *, lower(p) AS l FROM a WHERE p <> ''),
c AS (SELECT doc_id, pos, p, ({_HITS}) * 2 + CASE WHEN {_SUBJECT} THEN 5 ELSE 0 END AS score FROM b WHERE ({" OR ".join(f"contains(l, '{c}')" for c in A.DEFINES)}) AND ({_HITS}) > 0),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM c)
SELECT doc_id, CAST(score AS INTEGER) AS score, sha256(p) AS digest FROM d WHERE k = 1
""")
def anchor_paragraph(spark, sf_dir):
    """The paragraph of each document that best defines what is asked."""
    line = lambda x, i: (
        F.when(i % 6 == 1, F.concat(F.lit("A Closure is any thattion. "), x)).when(i % 6 == 3, F.concat(x, F.lit(" a lamp is a thing, not thattion")))
        .when(i % 6 == 4, F.concat(x, F.lit(" thattion refers to closures"))).otherwise(x)
    )
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    md = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    return docs.select("doc_id", A.anchor_paragraph(md, FOCUS).alias("a")).filter("a is not null").select("doc_id", "a.score", F.sha2("a.text", 256).alias("digest"))


@query("focus_cut")
def focus_cut(spark, sf_dir):
    """Documents cut to 120 tokens around a question; greedy over all that was kept, so golden tests check it."""
    df = headed(spark, sf_dir).withColumn("md", F.replace("md", F.lit("\n"), F.lit("\n\n")))
    df = C.per_text(df, "md", "cut", lambda t: A.focus_cut(t, 120, "that tion thing"), pa.string(), "string")
    return df.select("doc_id", F.length("md").alias("before"), F.length("cut").alias("after"), F.sha2("cut", 256).alias("digest"))


@query("completeness")
def completeness(spark, sf_dir):
    """Whether what a budget of 200 tokens leaves of each document still answers."""
    kind = pa.struct([("focus", pa.string()), ("completeness", pa.string()), ("reason", pa.string()), ("suggested", pa.int32())])
    df = headed(spark, sf_dir).withColumn("md", F.replace("md", F.lit("\n"), F.lit("\n\n")))

    def judge(t):
        cut, strategy = C.budgeted(t, 200)
        return A.completeness(t, cut, "that tion thing", strategy is not None)

    out = C.per_text(df, "md", "c", judge, kind, "struct<focus: string, completeness: string, reason: string, suggested: int>")
    return out.select("doc_id", "c.*")
