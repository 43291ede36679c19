"""Connected components of a link table, by rounds of least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a long, b long) -> (node, component): component is the least node that can be reached.

    Each round takes the least label among a node's neighbours and then the label of that label, so the
    number of rounds follows the logarithm of a component's breadth in practice. Labels are written to the
    shared folder each round. Null ends are ignored; an empty table gives an empty result.
    """
    both = links.where("a is not null and b is not null and a <> b")
    both = scratch.save("edges", both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save("labels0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        seen = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        seen = scratch.save(f"seen{turn}", seen)
        ahead = seen.select(F.col("node").alias("next"), F.col("next").alias("ahead"))
        after = seen.join(ahead, "next").select("node", F.least("next", "ahead").alias("label"), "old")
        after = scratch.save(f"labels{turn}", after)
        scratch.drop(f"seen{turn}", f"labels{turn - 1}")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            scratch.drop("edges")
            return labels.select("node", F.col("label").alias("component"))
