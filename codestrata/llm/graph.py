"""Connected components of a table of links, in rounds of joins; labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b); label: the smallest node of its component.

    Each round a node takes the smallest label around and its label's own, and hands the smallest label around on to
    its old label (FastSV), so whole trees of labels hook onto others: rounds grow with the logarithm of a chain's length.
    Labels only fall, and none falling means that all links join equal labels.
    """
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        far = labels.join(jump, "label").select("node", "label", "far")
        around = both.join(far.select(F.col("node").alias("b"), "far"), "b").groupBy("a").agg(F.min("far").alias("near")).withColumnRenamed("a", "node")
        step = stored(far.join(around, "node").select("node", "label", F.least("label", "far", "near").alias("least"), "near"))
        hooks = step.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        new = stored(step.join(hooks, "node", "left").select("node", F.col("label").alias("old"), F.least("least", F.coalesce("hook", "least")).alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").limit(1).count() == 0:
            return labels
