"""Connected components: spanning forests within a task, star contraction across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import persisted

MOST_ROUNDS = 60


def spanning_edges(edges: np.ndarray) -> np.ndarray:
    """Edges (node, smallest node of its component) that connect what the given ones connect."""
    if not len(edges):
        return edges
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    u, v = at[:, 0], at[:, 1]
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)  # hook the trees' roots
        np.minimum.at(new, label[v], low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
        if not len(u):
            break
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[inner], nodes[label[inner]]], axis=1)


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node of it) of every node on an edge (u, v).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes. Each step groups by node
    with partial minima and joins back, so a node with very many edges is never gathered in one task; each round is
    written to the shared folder, which cuts the lineage and survives lost executors.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    at = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    last = None
    for k in range(MOST_ROUNDS):
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        pairs = both(at)
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours move to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = persisted(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"stars{k}")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
