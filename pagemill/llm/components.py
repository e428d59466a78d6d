"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its least node.

    Each round takes the least label among the neighbours and then the label's own label, so a path of n nodes needs
    about log n rounds. Labels are written each round; nothing but a count comes to the driver.
    """
    both = materialize(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .union(edges.select("b", "a")).filter("u <> v").distinct(),
        "links",
    )
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")), "labels")
    last = labels
    while True:
        near = (
            both.join(labels.withColumnRenamed("u", "v"), "v")
            .groupBy("u").agg(F.min("label").alias("near"))
        )
        least = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("u").alias("low"), F.col("label").alias("far"))
        step = materialize(
            least.join(jump, "low", "left").select("u", "old", F.least("low", F.coalesce("far", "low")).alias("label")),
            "labels",
        )
        discard(last)
        last, labels = step, step.select("u", "label")
        if step.filter("old <> label").isEmpty():
            discard(both)
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
