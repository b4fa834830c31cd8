"""Connected components: within a tile in numpy, and across all tiles by joins on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the sets of ``i`` and ``j`` in ``parent``, where every entry points at the least member of its set."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): each id of ``edges`` (a long, b long) with the least id that it reaches.

    Alternates two steps until nothing changes, about log(n) times: every node's larger neighbours are linked to the
    node's least neighbour, then every node's smaller neighbours are. A node that is the least of its neighbours keeps its
    edges, so the centre of a large star is looked up by no join; minima are combined before they are shuffled.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(
        edges.where(a != b).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("low")).distinct(), "cc-edges"
    )
    state = None
    while True:
        # larger neighbours: (big, low) becomes (big, least neighbour of low), if low has a smaller one
        least = edges.groupBy(F.col("big").alias("node")).agg(F.min("low").alias("least"))
        large = edges.join(least, edges.low == least.node, "left").select("big", F.coalesce("least", "low").alias("low"))
        # smaller neighbours: all of a node's edges go to its least one
        least = large.groupBy(F.col("big").alias("node")).agg(F.min("low").alias("least"))
        turned = large.join(least, large.big == least.node).where(F.col("low") != F.col("least"))
        small = turned.select(F.col("low").alias("big"), F.col("least").alias("low")).union(least.select("node", "least"))
        before, edges = edges, materialize(small.distinct(), "cc-edges")
        discard(edges.sparkSession, before._written_at)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("big", "low").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("low").alias("id")).distinct()
    return edges.select(F.col("big").alias("id"), F.col("low").alias("component_id")).union(roots.select("id", "id"))
