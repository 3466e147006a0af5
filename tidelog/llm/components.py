"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import staged


def local_stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label (smallest member) of each of n nodes under the links a[i]-b[i]."""
    label = np.arange(n)
    while a.size:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    return label


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for each node of edges(a, b) whose root, the smallest node of its component, is another node.

    Self-links and repeated links change nothing; no edges give no rows. Each round writes its edges as a table; joins on the
    smallest neighbour have one row per node on one side, so adaptive execution can split a hub's rows.
    """
    cur = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), name)
    seen = None
    while True:
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if state == seen or state[0] == 0:
            return cur.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = state
        both = cur.unionByName(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("n")).select(F.col("v").alias("c"), F.least("n", "v").alias("m"))
        large = both.join(low, F.col("v") == F.col("c")).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), "m")
        small = large.join(down, F.col("v") == F.col("c")).select(F.explode(F.array(F.col("v"), F.col("u"))).alias("v"), F.col("m").alias("u"))
        cur = staged(small.filter("v <> u").distinct(), name)
