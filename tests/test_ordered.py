"""Values along the order of a key against plain windows, with one key that lies in many parts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    keys = ["hot"] * 400 + [None] * 60 + [f"k{r.randrange(40)}" for _ in range(200)]
    r.shuffle(keys)
    data = [(k, "x" if i % 9 else None, i, r.choice([None, r.randrange(100)])) for i, k in enumerate(keys)]
    return spark.createDataFrame(data, "k string, t string, i int, v int").repartition(5)


def parts_of(spark, rows, keys):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return O.in_parts(rows, keys, ["i"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("keys", [["k"], ["k", "t"]])
def test_against_windows(spark, rows, keys):
    parts = parts_of(spark, rows, keys)
    assert parts.filter("k = 'hot'").select(O.PART).distinct().count() > 5
    w = Window.partitionBy(*keys).orderBy("i")
    want = {tuple(r) for r in rows.select("i", F.row_number().over(w) - 1, F.lag("v").over(w), F.max("v").over(w), F.last("v", True).over(w)).collect()}
    out = O.with_running_max(O.with_previous(O.with_place(parts, keys, ["i"], "n"), keys, ["i"], "v", "p"), keys, ["i"], "v", "m")
    out = O.with_last(out, keys, ["i"], "v", "l")
    assert {tuple(r) for r in out.select("i", "n", "p", "m", "l").collect()} == want
    assert out.count() == rows.count()


def test_empty(spark, rows):
    parts = O.in_parts(rows.limit(0), ["k"], ["i"])
    assert O.with_previous(O.with_place(parts, ["k"], ["i"], "n"), ["k"], ["i"], "v", "p").count() == 0
