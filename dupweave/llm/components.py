"""Connected components of an edge table, without a vertex or an edge on the driver.

Each round every vertex takes the least vertex of its closed neighbourhood as parent, parents take their
parents, and edges are drawn between the parents; loops and repeats go. Vertices are hashes, so their order
is random and the number of vertices falls by a constant factor a round. Rounds are cut by checkpoint() in the
shared folder; labels come from following the rounds' parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (vertex, component) for each vertex of an edge; the component is its least vertex.

    Loops count as vertices of their own; nulls are dropped; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    rest = edges.select("a", "b").dropna()
    labels = None
    while True:
        both = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("least")).select("vertex", F.least("vertex", "least").alias("parent"))
        up = parents.select(F.col("vertex").alias("v2"), F.col("parent").alias("p2"))
        parents = parents.join(up, F.col("parent") == F.col("v2")).select("vertex", F.col("p2").alias("parent")).checkpoint()
        if labels is None:
            labels = parents.select("vertex", F.col("parent").alias("component"))
        else:
            labels = labels.join(parents.select(F.col("vertex").alias("v2"), "parent"), F.col("component") == F.col("v2"), "left").select("vertex", F.coalesce("parent", "component").alias("component"))
        of = lambda side: parents.select(F.col("vertex").alias(side), F.col("parent").alias(f"{side}_parent"))
        rest = rest.join(of("a"), "a").join(of("b"), "b").select(F.col("a_parent").alias("a"), F.col("b_parent").alias("b")).filter("a <> b").distinct().checkpoint()
        if rest.isEmpty():
            return labels
