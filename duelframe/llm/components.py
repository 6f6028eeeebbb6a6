"""Connected components of a distributed edge list by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelframe.session import materialised


def components(edges: DataFrame) -> DataFrame:
    """(``v``, ``root``) for every vertex of (``a``, ``b``): the least vertex of its component.

    In each round a vertex takes the least label among itself and its neighbours, then the
    label of that label; when nothing changes, all neighbours agree. Every round is written
    to the shared folder. Sums over a vertex with many neighbours are combined before the
    shuffle, and nothing but a count comes to the driver.
    """
    both = materialised(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = materialised(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        least = both.join(labels.select(F.col("v").alias("b"), F.col("root").alias("_l")), "b").groupBy(F.col("a").alias("v")).agg(F.min("_l").alias("_m"))
        lowered = labels.join(least, "v").select("v", F.least("root", "_m").alias("_p"), F.col("root").alias("_old"))
        jump = lowered.select(F.col("v").alias("_p"), F.col("_p").alias("_pp"))
        step = materialised(lowered.join(jump, "_p").select("v", F.col("_pp").alias("root"), (F.col("_pp") < F.col("_old")).alias("_moved")))
        labels = step.select("v", "root")
        if step.where("_moved").isEmpty():
            return labels
