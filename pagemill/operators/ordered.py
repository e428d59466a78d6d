"""Values that run along the order of a key, without a task that holds all rows of one key.

Rows are dealt by ranges over (key, order), so a long key lies in several parts. Within a part a window does; what a part
needs of those before it is one row a part, and only for keys that lie in more than one: as many rows as there are parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

PART = "__part"


def in_parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` materialised by ranges over ``keys`` and ``order``, each row with its part. ``order`` tells the rows of a key apart."""
    return materialize(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "parts")


def _within(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, PART).orderBy(*order)


def _carried(parts: DataFrame, keys: list[str], end: Column, over) -> DataFrame:
    """``parts`` with ``__carry``: ``over`` of the ends of the parts before, for keys in several parts; else null."""
    group = Window.partitionBy(*keys)
    ends = parts.groupBy(*keys, PART).agg(end.alias("__end")).withColumn("__parts", F.count("*").over(group)).filter("__parts > 1")
    carry = over(F.col("__end")).over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    named = ends.withColumn("__carry", carry).select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col(PART).alias("__p"), "__carry")
    same = F.col(PART) == F.col("__p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return parts.join(F.broadcast(named), same, "left").drop("__p", *[f"__of_{k}" for k in keys])


def with_place(parts: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """A row's place in its key, from 0."""
    carried = _carried(parts, keys, F.count("*"), F.sum)
    place = F.row_number().over(_within(keys, order)) - 1 + F.coalesce(F.col("__carry"), F.lit(0))
    return carried.withColumn(name, place.cast("bigint")).drop("__carry")


def with_previous(parts: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The value of the row before, null in a key's first row."""
    kept = F.struct(F.col(value).alias("v"))  # a null value is one too
    carried = _carried(parts, keys, F.max_by(kept, F.struct(*order)), lambda end: F.last(end))
    own = F.lag(kept).over(_within(keys, order))
    return carried.withColumn(name, F.coalesce(own, F.col("__carry"))["v"]).drop("__carry")


def with_running_max(parts: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The greatest value up to the row."""
    carried = _carried(parts, keys, F.max(value), F.max)
    own = F.max(value).over(_within(keys, order))
    return carried.withColumn(name, F.greatest(own, F.col("__carry"))).drop("__carry")


def with_last(parts: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that is not null, up to the row itself: an as-of join of rows that have one with those that do not."""
    carried = _carried(parts, keys, F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))), lambda end: F.last(end, ignorenulls=True))
    own = F.last(value, ignorenulls=True).over(_within(keys, order))
    return carried.withColumn(name, F.coalesce(own, F.col("__carry"))).drop("__carry")


def sums(parts: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """(keys, ``name``): the sum of doubles in order, part by part, so that its last digits do not depend on how rows met."""
    upto = parts.withColumn("__sum", F.sum(value).over(_within(keys, order)))
    ends = upto.groupBy(*keys, PART).agg(F.max_by("__sum", F.struct(*order)).alias("end"))
    of_key = F.array_sort(F.collect_list(F.struct(F.col(PART), F.col("end"))))
    return ends.groupBy(*keys).agg(F.aggregate(of_key, F.lit(0.0), lambda a, x: a + x["end"]).alias(name))
