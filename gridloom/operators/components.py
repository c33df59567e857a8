"""Connected components of an undirected graph by label propagation with shortcuts."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import dropped, scratch_dir, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Each round every node takes the smallest label among its neighbours and
    itself, then the label of its label, so chains shrink by half or more; rounds
    go on until no label changes.  The labels are written to shared storage each
    round and the ones before are deleted; nothing is collected.
    """
    spark = edges.sparkSession
    path = scratch_dir(spark)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{path}/edges")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")), f"{path}/labels0")
    for k in count(1):
        near = both.join(labels.select(F.col("node").alias("y"), F.col("component").alias("near")), "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        took = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        # a root that learns of a smaller label through any member hands it to the whole tree
        best = took.groupBy(F.col("old").alias("component")).agg(F.min("component").alias("best"))
        hop = took.join(best.select(F.col("component").alias("mid"), "best"), F.col("component") == F.col("mid"), "left")
        hop = hop.select("node", "old", F.least("component", F.coalesce("best", "component")).alias("component"))
        new = written(hop, f"{path}/labels{k}")
        dropped(spark, f"{path}/labels{k - 1}")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
