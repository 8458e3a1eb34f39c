"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlift.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node reachable.

    Each round takes the smallest label of a node and its neighbours, then
    the label of that label (pointer jumping), so long chains halve.  Every
    round's labels are written to the shared folder, which cuts the lineage;
    nothing but the number of changes reaches the driver.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where("a <> b").distinct(), "graph")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                         .select("node", F.least("node", "near").alias("comp")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        nxt = materialize(step.join(jump, "new", "left")
                          .select("node", F.least("new", "far").alias("comp"),
                                  (F.least("new", "far") != F.col("comp")).alias("moved")), "labels")
        if not nxt.where("moved").limit(1).count():
            return labels
        labels = nxt.select("node", "comp")
