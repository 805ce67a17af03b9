"""Connected components of a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import drop_path, written, written_at


def components(links: DataFrame) -> DataFrame:
    """links (a, b), in either direction, repeats allowed, to (node, label): label is the smallest node that node
    can reach. Nodes without links are not listed; an empty table gives an empty table.

    Each round hooks a node's label under the smallest label next to it, then jumps to the label's label, until
    nothing changes; labels only ever get smaller, so that point comes. The label table has one row for each node, so a
    node with many links weighs on one side of each join only, where adaptive execution can split it, and sums by node
    are combined before they are shuffled. Every round is written to the shared folder, and the files of the round
    before are dropped."""
    spark = links.sparkSession
    a, b = F.col("a"), F.col("b")
    both = links.filter(a != b).select(a.alias("u"), b.alias("v")).unionByName(links.filter(a != b).select(b.alias("u"), a.alias("v")))
    both, links_path = written_at(both.distinct(), "component-links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")), "component-labels")
    if labels.isEmpty():
        return labels
    last = None
    while True:
        near = both.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        hooked, hooked_path = written_at(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "component-hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved, path = written_at(hooked.join(jump, "label").select("node", F.least("label", "jump").alias("label"), "was"), "component-labels")
        drop_path(spark, hooked_path)
        if last:
            drop_path(spark, last)
        labels, last = moved.select("node", "label"), path
        if moved.filter(F.col("label") != F.col("was")).isEmpty():
            drop_path(spark, links_path)
            return labels
