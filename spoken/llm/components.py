"""Connected components by minimum labels and pointer jumping, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the smallest node that links reach.

    Every round joins edges with labels (a sort-merge join, so that adaptive execution splits hubs), takes the smallest label
    per node with partial aggregation and follows it once more. Only the number of changed labels reaches the driver.
    """
    both = cut(few(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()))
    labels = cut(few(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).withColumn("comp", F.least("node", "comp"))))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        step = cut(few(step.join(jump, "to", "left").select("node", "old", F.least("to", "far").alias("comp"))))
        labels = step.select("node", "comp")
        if not step.filter("comp <> old").limit(1).count():
            return labels
