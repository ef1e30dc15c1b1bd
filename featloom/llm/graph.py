"""Connected components of a link table, without the driver seeing a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of every node of `links` (a, b: any ordered type).

    Labels start at the nodes themselves. In each round a node takes the smallest label next to it, then the
    label of its label; what changes halves the way to the smallest node, so rounds are few. Every round is
    written, and the loop ends when no label changes.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                  "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("near"))
                    .select(F.col("a").alias("node"), F.least("a", "near").alias("root")), "labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near")))
        taken = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = taken.select(F.col("node").alias("parent"), F.col("root").alias("parent_root"))
        moved = staged(taken.join(up, F.col("root") == F.col("parent"))
                       .select("node", "old", F.least("root", "parent_root").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("old <> root").isEmpty():
            return labels
