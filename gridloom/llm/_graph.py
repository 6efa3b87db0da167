"""Connected components of a table of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import few_rows, materialise, release


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes of links (a, b): root is the least node reachable.

    Each round every node takes the least label around it and then the label of its label, so
    rounds grow with the logarithm of a component's width for paths of labels. Labels are written
    after each round.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("to"), "root"), "to").groupBy("node").agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # the old label, too, learns of the better one
        hook = low.where("root < was").groupBy(F.col("was").alias("node")).agg(F.min("root").alias("hook"))
        low = low.join(hook, "node", "left").select("node", "was", F.least("root", F.coalesce("hook", "root")).alias("root"))
        up = low.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = materialise(low.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), "was"), "labels")
        done = few_rows(new.where("root <> was"), 0)
        release(labels)
        labels = new.select("node", "root")
        if done:
            return labels
    raise RuntimeError("labels have not settled")
