"""The outcome of reads: what was known of a page's access when it was read, and whether several attempts agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ordered as O

ASSESSMENT = "struct<disposition: string, confidence: double, codes: array<string>, action: string>"


def access_outcome(assessment: Column) -> Column:
    """(disposition, confidence, evidence_codes, recommended_action) as they are told; null without an assessment."""
    codes = F.coalesce(assessment["codes"], F.array().cast("array<string>"))
    told = F.struct(
        F.lower(assessment["disposition"]).alias("disposition"), T.round_even(assessment["confidence"], 2).alias("confidence"),
        codes.alias("evidence_codes"), assessment["action"].alias("recommended_action"),
    )
    return F.when(assessment.isNotNull(), told)


def focus_outcome(status: Column, query: Column, fragment: Column) -> Column:
    """``not_requested`` without a query and a fragment; else ``hit`` or ``weak`` as found, ``miss`` for anything else."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(query) & blank(fragment), "not_requested").when(F.lower(status).isin("hit", "weak"), F.lower(status)).otherwise("miss")


def completeness_outcome(status: Column) -> Column:
    """``complete``, ``partial`` or ``incomplete``; null where nothing was assessed."""
    return F.when(status.isNotNull(), F.when(F.lower(status).isin("complete", "partial"), F.lower(status)).otherwise("incomplete"))


def reads_with_access(reads: DataFrame, assessments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``reads`` (``key``, ``order``, ...) with ``access``: the last of ``assessments`` (``key``, ``order``, ``assessment``) at or before each.

    One table in the order of each key, so no read meets more than one assessment, and a long key lies in several tasks. Of
    equal times the assessment counts as before the read. A read without one has a null; null keys are a key of their own.
    """
    both = reads.withColumn("__read", F.lit(1)).unionByName(
        assessments.select(key, *order, "assessment").withColumn("__read", F.lit(0)), allowMissingColumns=True
    )
    sorted_by = [order[0], "__read", *order[1:]]
    known = O.with_last(O.in_parts(both, [key], sorted_by), [key], sorted_by, "assessment", "__known")
    return known.filter("__read = 1").withColumn("access", access_outcome(F.col("__known"))).select(*reads.columns, "access")


# Failures that are a wall, not a fault of the reader.
WALLS = ("captcha_or_challenge", "requires_login", "http_401", "http_403", "http_429", "anti_bot")


def crosscheck(attempts: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, start, end, attempts, ok, walls, verdict): attempts (key, ts, failure, fingerprint) cut into runs, and whether each agrees.

    A run ends when none of its key follows within ``gap``. ``walled``: nothing was read and something stood in the way; ``failed``:
    nothing was read; ``single``: one reading; ``agree`` or ``diverge``: several. Everything but the gap combines on the map side, so
    a run may be long. With ``late``, ``attempts`` may be a stream: a run is told once its watermark has passed it.
    """
    rows = attempts if late is None else attempts.withWatermark("ts", late)
    good = F.col("failure").isNull()
    runs = rows.groupBy("key", F.session_window("ts", gap).alias("run")).agg(
        F.count("*").alias("attempts"), F.count_if(good).alias("ok"), F.count_if(F.coalesce(F.col("failure").isin(*WALLS), F.lit(False))).alias("walls"),
        F.min(F.when(good, F.col("fingerprint"))).alias("least"), F.max(F.when(good, F.col("fingerprint"))).alias("most"),
    )
    verdict = (
        F.when((F.col("ok") == 0) & (F.col("walls") > 0), "walled").when(F.col("ok") == 0, "failed").when(F.col("ok") == 1, "single")
        .when(F.col("least").eqNullSafe(F.col("most")), "agree").otherwise("diverge")
    )
    return runs.select("key", F.col("run.start").alias("start"), F.col("run.end").alias("end"), "attempts", "ok", "walls", verdict.alias("verdict"))
