"""Connected components as joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.runtime import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns a, b); component is the least id reachable.

    Each round hooks every node to its least neighbour, follows the hooks to
    their roots by pointer doubling and keeps the edges between roots. The larger
    end of every edge has a hook, so a round at least halves the nodes. Hooks are
    a ``min`` combined on the map side, and the joins hold no row that needs its
    key's others, so a node with very many neighbours is split by AQE. Null ends
    and loops are left out; repeated edges make no difference.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    levels = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                          .select("node", F.least("node", "low").alias("root")))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("__next"))
            jumped = checkpoint(hook.join(up, "root").select("node", F.col("__next").alias("root"),
                                                             (F.col("__next") != F.col("root")).alias("moved")))
            done = jumped.where("moved").isEmpty()
            hook = jumped.select("node", "root")
            if done:
                break
        levels.append(hook)
        a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = checkpoint(edges.join(a, "a").join(b, "b").where("ra <> rb")
                           .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels[0]
    for level in levels[1:]:
        step = level.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        found = checkpoint(found.join(step, "root", "left").select("node", F.coalesce("__next", "root").alias("root")))
    return found.select("node", F.col("root").alias("component"))


def local_roots(links: np.ndarray) -> np.ndarray:
    """Least row index reachable from each row of a symmetric link matrix."""
    root = np.arange(len(links))
    open_rows = np.flatnonzero(links.any(axis=1))
    sub = links[np.ix_(open_rows, open_rows)]
    label = np.arange(len(open_rows))
    while len(label):
        low = np.minimum(label, np.where(sub, label[None, :], len(label)).min(axis=1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    root[open_rows] = open_rows[label]
    return root
