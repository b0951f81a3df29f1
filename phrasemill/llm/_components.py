"""Connected components of a graph in a table, by contraction.

Every round each node points to the smallest of itself and its neighbours; pointers are doubled until all
of them end at a root, so that a chain of any length is one round of about log2(length) doublings; then
edges are rewritten to the roots. Roots that still have edges are smaller than all around them, so at most
half of the nodes are left after a round. Nothing but a flag reaches the driver. Hubs are no bottleneck:
minima are aggregated map-side, and the joins are plain equi-joins whose skewed partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, written


def _doubled(parents: DataFrame) -> tuple[DataFrame, int]:
    """``node`` and its ``parent``, all parents roots, and the number of doublings."""
    steps = 0
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))
        after = written(jumped, "parents")
        discard(parents)
        parents, steps = after, steps + 1
        if after.where("moved").isEmpty():
            return parents, steps


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for all nodes of the edges ``a``, ``b``.

    Edges from a node to itself, and repeated edges, count for nothing; an empty table gives no rows."""
    both = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    live = written(both, "edges")
    labels = None
    while not live.isEmpty():
        arcs = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = arcs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parents, _ = _doubled(written(lows.select("node", F.least("node", "low").alias("parent")), "parents"))
        if labels is None:
            after = written(parents.select("node", F.col("parent").alias("root")), "labels")
        else:
            step = parents.select(F.col("node").alias("root"), "parent")
            after = written(labels.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "labels")
            discard(labels)
        labels = after
        pa = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = live.join(pa, "a").join(pb, "b").where("pa <> pb")
        after = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(live)
        discard(parents)
        live = after
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return labels
