"""Connected components of an edge table, by pointer jumping on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm._common import written


def connected(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root for every node of an edge: root is its component's least node.

    Each round every node takes the least label among its own, its neighbours' and its label's own label;
    a node's label only falls, and stays a node of the same component. Self-loops are allowed. The number
    of rounds grows with the logarithm of a component's width in practice; each is two shuffles of thin rows.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = labels.join(told, "node").withColumn("low", F.least("root", "near")).join(up, "root", "left")
        step = step.select("node", F.least("low", "above").alias("new"), (F.least("low", "above") < F.col("root")).alias("moved"), "root")
        # what a root has learnt from one of its nodes reaches all of its nodes
        pulled = step.groupBy("root").agg(F.min("new").alias("pulled"))
        after = written(step.join(pulled, "root").select("node", F.least("new", "pulled").alias("root"), (F.col("pulled") < F.col("root")).alias("moved")), "labels")
        if not after.where("moved").limit(1).count():
            return after.select("node", "root")
        labels = after.select("node", "root")
