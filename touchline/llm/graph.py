"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.plans.materialize import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): each node of ``edges`` (a, b) with the smallest node that it reaches.

    Each round a node takes the smallest label around it and then that label's own label, so paths halve; rounds end when no
    label changes. Labels are written each round. NULL nodes are left out; no edges give no rows.
    """
    both = edges.where("a is not null and b is not null")
    both = materialize(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "m").alias("mid"), F.col("comp").alias("old"))
        hop = labels.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
        stepped = materialize(near.join(hop, "mid").select("node", F.least("mid", "top").alias("comp"), "old"), "labels")
        moved = stepped.where("comp <> old").limit(1).count()
        labels = stepped.select("node", "comp")
        if not moved:
            return labels
