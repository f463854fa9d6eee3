"""Connected components of an edge table, by labels and pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, shuffle_width, workers_find_package


class Forest:
    """Union-find over numbers 0..n-1; the root is the smallest of its tree."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def _local_forest(batches):
    """Replaces the edges of each batch by one edge from every node to the root of its tree."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i).to_numpy()) for i in (0, 1))
        if not len(a):
            continue
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            forest.union(i, j)
        root = np.array([forest.find(i) for i in range(len(nodes))])
        keep = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of the edges (a long, b long); the label is the component's smallest node.

    Each round takes the smallest label among neighbours and then the label's own label,
    so the number of rounds grows with the logarithm of the longest path.  Rounds are
    written to the shared folder.  Edges may repeat, be loops, or be empty.
    """
    spark = edges.sparkSession
    workers_find_package(spark)
    slim = materialise(edges.select("a", "b").mapInArrow(_local_forest, "a long, b long").distinct(), "cc-edges")
    slim = materialise(slim.repartition(max(1, shuffle_width(spark) // 4)).mapInArrow(_local_forest, "a long, b long").distinct(), "cc-edges")
    both = slim.union(slim.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        step = materialise(
            lower.join(jump, lower["label"] == jump["at"], "left").select("node", "was", F.least("label", "beyond").alias("label")), "cc-labels"
        )
        changed = step.filter("label <> was").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
