"""Exact duplicates by distributed MSD radix partitioning: no digest decides equality.

Documents are split by successive digits, a digit being the next run of bytes of the normalised text. After each split
a document alone in its group leaves as unique; a group whose texts ended inside the digit is a class of equal texts;
the other groups are split again by the next digit, each twice as wide as the one before, so that the splits of a text
are logarithmic in its length. A split is an aggregation by (group, digit), which combines on the map side however large a
group is; its result is written, then joined back to the rows. As the written side is no part of the join's stage, Spark
splits a hot digit over tasks (AQE). Only the first split sees all documents. It counts their first bytes by a number, and
only tells the documents whose number is their own from the others: two digits of one number stay together until the next
split parts them, so it decides no equality. No body is moved for it while the shared numbers are few enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialize, read_table, row_uid, whole_row

#: Bytes of the first digit, and how many times wider each further one is.
FIRST_DIGIT = 128
WIDER = 2


def normalized(text: Column) -> Column:
    """A null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def split_rows(df: DataFrame, id_col: str, text_col: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): the materialised rows with a ``__uid``, and (``__uid``, ``__class``) of those not unique.

    ``rows`` has ``__row`` (the whole row, if ``carry``), ``__id``, ``__sha`` (if not) and ``__alone`` (true: unique after the
    first split).
    """
    body = F.encode(normalized(F.col(f"`{text_col}`")), "UTF-8")
    number = F.xxhash64(F.substring(body, 1, FIRST_DIGIT))
    row, sha = (whole_row(df), F.lit(None).cast("string")) if carry else (F.lit(None).cast("int"), F.sha2(body, 256))
    source = df.select(
        row.alias("__row"), F.col(f"`{id_col}`").alias("__id"), sha.alias("__sha"), body.alias("__body"), number.alias("__digit")
    )
    shared = materialize(
        df.select(number.alias("__digit")).groupBy("__digit").agg(F.count("*").alias("__n")).filter("__n > 1")
        .select("__digit", F.lit(False).alias("__single")),
        "digits",
    )
    alone = F.col("__single").isNull()
    rows = materialize(
        source.join(few(shared), "__digit", "left").select(
            "__row", "__id", "__sha", alone.alias("__alone"),
            F.when(~alone, F.col("__body")).alias("__body"), row_uid().alias("__uid"),
        ),
        "radix",
    )
    discard(shared)
    active = rows.filter(~F.col("__alone")).select("__uid", F.lit(0).cast("bigint").alias("__group"), "__body")
    ended: list[DataFrame] = []
    width = FIRST_DIGIT * WIDER
    while True:
        digits = active.withColumn("__digit", F.substring("__body", 1, width))
        groups = materialize(
            digits.groupBy("__group", "__digit").agg(F.count("*").alias("__n"), F.min("__uid").alias("__next"))
            .filter("__n > 1").drop("__n"),
            "digits",
        )
        over = F.octet_length("__digit") < width
        rest = F.expr(f"substring(__body, {width + 1})")
        split = materialize(
            digits.join(groups.hint("merge"), ["__group", "__digit"]).select(
                "__uid", F.col("__next").alias("__group"), over.alias("__ended"), F.when(~over, rest).alias("__body")
            ),
            "radix",
        )
        ended.append(split.filter("__ended").select("__uid", F.col("__group").alias("__class")))
        active = split.filter("not __ended").select("__uid", "__group", "__body")
        if active.isEmpty():
            break
        width *= WIDER
    classes = ended[0]
    for more in ended[1:]:
        classes = classes.unionByName(more)
    return rows, classes


def _decided(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of classes (unique ones are left out), with what stays of each class."""
    first = F.struct(F.col("__id").isNull(), F.col("__id").alias("id"), F.col("__uid").alias("uid"))
    members = rows.filter(~F.col("__alone")).join(classes, "__uid", "left")
    sizes = materialize(
        rows.filter(~F.col("__alone")).select("__uid", "__id").join(classes, "__uid")
        .groupBy("__class").agg(F.count("*").alias("__size"), F.min(first).alias("__first")),
        "classes",
    )
    return members.join(sizes, "__class", "left").withColumns({
        "__size": F.coalesce("__size", F.lit(1).cast("bigint")),
        "__keep": F.when(F.col("__class").isNull(), F.col("__id")).otherwise(F.col("__first.id")),
        "__kept": F.col("__class").isNull() | (F.col("__first.uid") == F.col("__uid")),
    })


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays (nulls last; of rows that share the id, one). A null text equals
    an empty one. Repeated rows are copies. Texts of any length take a logarithmic number of splits. An empty frame
    gives an empty one. Other columns are not read.
    """
    rows, classes = split_rows(df, id_col, text_col, carry=False)
    unique = rows.filter("__alone").select(
        F.col("__id").alias("doc_id"), F.col("__id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256"),
    )
    grouped = _decided(rows.drop("__body"), classes).select(
        F.col("__id").alias("doc_id"), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"),
    )
    return unique.unionByName(grouped)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns as they were."""
    rows, classes = split_rows(df, id_col, text_col, carry=True)
    ids = rows.select("__uid", "__id", "__alone")
    copies = materialize(_decided(ids, classes).filter("not __kept").select("__uid"), "copies")
    return rows.join(few(copies), "__uid", "left_anti").select("__row.*")


def op5_radix_exact_dedup(spark, sf_dir):
    return exact_classes(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
